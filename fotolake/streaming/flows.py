"""Flows over arriving rows as Structured Streaming: file sources, watermarks, stateful processors with timers, foreachBatch.

The stateful flows take rows in order of their time: a row waits in its key's state until the watermark has passed it, then a
timer takes what is due. In batch the same step goes over sorted rows, so batch and stream give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from fotolake.functions.scalars import quality_score
from fotolake.operators.joins import apply_diff, folder_diff
from fotolake.storage import settled

#: What a stream with timers needs; set where the session has not chosen a store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def timed_store(spark: SparkSession) -> None:
    """Streams of this session keep their state in the store that transformWithState needs."""
    spark.conf.set(*STORE)


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """New parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(frame: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there now; a restart with the same checkpoint goes on where it ended."""
    return frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


class _Unseen(StatefulProcessor):
    """Keyed by path: hands on the rows of sizes and times that the path was not seen with."""

    def init(self, handle) -> None:
        self.seen = handle.getListState("seen", "size long, mtime long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.appendList([(int(r.size_), int(r.mtime)) for r in initialState.rename(columns={"size": "size_"}).itertuples()])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = {tuple(x) for x in self.seen.get()} if self.seen.exists() else set()
        for part in rows:
            fresh = []
            for at, one in enumerate(zip(part["size"].astype(int), part["mtime"].astype(int), strict=True)):
                if one not in seen:
                    seen.add(one)
                    fresh.append(at)
                    self.seen.appendValue((int(one[0]), int(one[1])))
            yield part.iloc[fresh]

    def close(self) -> None:
        pass


class _FirstOfContent(StatefulProcessor):
    """Keyed by sha256: the first row, by id, of the first batch that brings a content is added, all others are duplicates."""

    def init(self, handle) -> None:
        self.had = handle.getValueState("had", "had boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.had.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had, least, held = self.had.exists(), None, []
        for part in rows:
            held.append(part)
            least = part["id"].min() if least is None else min(least, part["id"].min())
        self.had.update((True,))
        for part in held:
            first = (part["id"] == least) & (not had)
            yield part.assign(status=first.map({True: "added", False: "duplicate"}))

    def close(self) -> None:
        pass


_LISTED = "id long, path string, size long, mtime long, sha256 string"


def import_stream(listing: DataFrame, now: int, settle_s: int = 15, seen: DataFrame | None = None) -> DataFrame:
    """id, path, size, mtime, sha256, status of listed files that are not empty, have rested and were not seen at this size and
    time: a stream whose state is keyed by path, then by content. seen (path, size, mtime, sha256, status) is where it starts."""
    timed_store(listing.sparkSession)
    ready = listing.where((F.col("size") > 0) & (F.col("mtime") <= now - settle_s)).select("id", "path", "size", "mtime", "sha256")
    start = seen.select("path", "size", "mtime").groupBy("path") if seen is not None else None
    fresh = ready.groupBy("path").transformWithStateInPandas(_Unseen(), _LISTED, "append", "none", start)
    had = seen.where("status = 'added'").select("sha256").distinct().groupBy("sha256") if seen is not None else None
    return fresh.groupBy("sha256").transformWithStateInPandas(_FirstOfContent(), _LISTED + ", status string", "append", "none", had)


def import_batch(listing: DataFrame, now: int, settle_s: int = 15, seen: DataFrame | None = None) -> DataFrame:
    """What import_stream() returns for a listing that comes at once, by joins. Of rows alike in path, size and time the least id
    counts; of equal contents that were not added before, the least id is added. A null size or time is not ready; contents
    without a hash are one content. ids differ."""
    ready = listing.where((F.col("size") > 0) & (F.col("mtime") <= now - settle_s)).groupBy("path", "size", "mtime").agg(F.min_by(F.struct("id", "sha256"), "id").alias("r"))
    fresh = ready.select("r.id", "path", "size", "mtime", "r.sha256")
    same = lambda a, b: F.col(f"f.{a}").eqNullSafe(F.col(f"{b}.{a}"))
    firsts = fresh
    if seen is not None:
        old = seen.select("path", "size", "mtime").distinct()
        fresh = fresh.alias("f").join(old.alias("o"), same("path", "o") & same("size", "o") & same("mtime", "o"), "left_anti")
        had = seen.where("status = 'added'").select("sha256").distinct()
        firsts = fresh.alias("f").join(had.alias("h"), same("sha256", "h"), "left_anti")
    # One row per content, counted before it is sent; the join back is by id.
    firsts = firsts.groupBy("sha256").agg(F.min("id").alias("id")).select("id", F.lit("added").alias("status"))
    return fresh.join(firsts, "id", "left").select("id", "path", "size", "mtime", "sha256", F.coalesce("status", F.lit("duplicate")).alias("status"))


def auto_import(listing: DataFrame, seen_path: str, out_path: str, checkpoint: str, now: int, settle_s: int = 15) -> StreamingQuery:
    """Imports what import_stream() finds; each file is marked seen whatever comes of it. Batches write their own part of both
    tables, so one that runs again replaces its output; none reads what earlier ones wrote. The stream's state has that, and
    starts from the baseline."""

    def batch(rows: DataFrame, number: int) -> None:
        done = settled(rows)
        done.select("path", "size", "mtime", "sha256", "status").write.mode("overwrite").parquet(f"{seen_path}/batch={number}")
        done.where("status = 'added'").select("id", "path", "sha256").write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    start = _table(listing.sparkSession, f"{seen_path}/batch=-1", "path string, size long, mtime long, sha256 string, status string")
    return run_available(import_stream(listing, now, settle_s, start), checkpoint, batch)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def baseline_rows(listing: DataFrame) -> DataFrame:
    """What a table of seen files holds of all that is there now: seen, and not added."""
    return listing.select("path", "size", "mtime", "sha256", F.lit("baseline").alias("status"))


def baseline(listing: DataFrame, seen_path: str) -> None:
    """Marks all that is there now as seen, before the first batch."""
    baseline_rows(listing).write.mode("overwrite").parquet(f"{seen_path}/batch=-1")


def folder_sync(listing: DataFrame, known: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Differences of each listing that arrives to what is known by then, as in folder_diff, one output per batch.

    A batch reads the version of the known files that the one before it wrote, the first one known, and writes its own: a
    move is reported once. A batch that runs again replaces its own output and version; older versions are not read.
    """
    path, schema = f"{out_path}-known", "path string, size long, mtime long, sha string, photo_id long"

    def batch(rows: DataFrame, number: int) -> None:
        before = known if number == 0 else rows.sparkSession.read.schema(schema).parquet(f"{path}/version={number - 1}")
        changes = settled(folder_diff(rows, before))
        apply_diff(before, rows, changes).write.mode("overwrite").parquet(f"{path}/version={number}")
        changes.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return run_available(listing, checkpoint, batch)


def incremental_score(photos: DataFrame, measures: DataFrame) -> DataFrame:
    """id, score of photos as they arrive: a stream joined with the table of measures."""
    side = measures.select(F.col("photo_id").alias("id"), "sharp", "luma", "p5", "p95", "clip_dark", "clip_white", "eyes_closed")
    score = quality_score(*map(F.col, ("sharp", "luma", "p5", "p95", "clip_dark", "clip_white", "eyes_closed", "width", "height")))
    return photos.select("id", "width", "height").join(side, "id").select("id", score.alias("score"))


def expired(photos: DataFrame, now: int, days: int = 60) -> DataFrame:
    """Trashed rows whose time is over; days are held within 1 to 3650."""
    return photos.where((F.col("trashed") == 1) & (F.col("trashed_at") < now - min(max(days, 1), 3650) * 86_400))


# -- rows of a key in order of time -------------------------------------------------------------------------------------


class Bursts:
    """Runs of shots: each at most window_s after the one before and at most bits different from it."""

    columns, schema, state = ["id", "phash", "score"], "source {key}, first_id long, n long, best long", "first long, n long, best long, score long, best_ms long, ms long, phash long"

    def __init__(self, window_s: int, bits: int, least: int):
        self.window_ms, self.bits, self.least = window_s * 1000, bits, least

    def step(self, state: tuple | None, ms: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        id_, phash, score = (int(x) for x in row)
        out = []
        if state is not None and (ms - state[5] > self.window_ms or ((phash ^ state[6]) & (2**64 - 1)).bit_count() > self.bits):
            state, out = None, self.end(state)
        if state is None:
            return (id_, 1, id_, score, ms, ms, phash), out
        first, n, best, top, best_ms = state[:5]
        if (score, -ms, -id_) > (top, -best_ms, -best):
            best, top, best_ms = id_, score, ms
        return (first, n + 1, best, top, best_ms, ms, phash), out

    def end(self, state: tuple) -> list[tuple]:
        return [state[:3]] if state[1] >= self.least else []

    def until(self, state: tuple) -> int:
        return state[5] + self.window_ms


class Throttle:
    """The same alert at most once in a span, and at once again after it was cleared."""

    columns, schema, state = ["at", "active"], "alert {key}, at long", "last long"

    def __init__(self, every_s: int):
        self.every_s = every_s

    def step(self, state: tuple | None, ms: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        at, active = int(row[0]), bool(row[1])
        if not active:
            return None, []
        if state is None or at - state[0] >= self.every_s:
            return (at,), [(at,)]
        return state, []

    def end(self, state: tuple) -> list[tuple]:
        return []

    def until(self, state: tuple) -> int:
        return (state[0] + self.every_s) * 1000


class Limit:
    """Only accepted events count against the limits of an hour and a day; a refused one is told the minutes to wait."""

    columns, schema, state = ["at"], "key {key}, at long, accepted boolean, wait_min long", "taken array<long>"
    HOUR, DAY = 3600, 86_400

    def __init__(self, per_hour: int, per_day: int):
        self.per_hour, self.per_day = per_hour, per_day

    def step(self, state: tuple | None, ms: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        at = int(row[0])
        taken = [t for t in (state[0] if state else []) if at - t < self.DAY]
        hour = [t for t in taken if at - t < self.HOUR]
        waits = [hour[-self.per_hour] + self.HOUR - at] if len(hour) >= self.per_hour else []
        waits += [taken[-self.per_day] + self.DAY - at] if len(taken) >= self.per_day else []
        if waits:
            return (taken,), [(at, False, max(waits) // 60 + 1)]
        return ([*taken, at],), [(at, True, 0)]

    def end(self, state: tuple) -> list[tuple]:
        return []

    def until(self, state: tuple) -> int:
        return ((state[0] or [0])[-1] + self.DAY) * 1000


class _InOrder(StatefulProcessor):
    """Feeds a key's rows to a step in order of time: they wait in list state until the watermark has passed them. An event-time
    timer takes what is due, and ends the state when nothing can depend on it any more."""

    def __init__(self, step: Any, key: str, kinds: str, names: list[str]):
        self.step, self.key, self.kinds, self.names = step, key, kinds, names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, " + self.kinds)
        self.state = handle.getValueState("state", self.step.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            ms = part["ts"].astype("datetime64[ms]").astype("int64")
            listed = [(int(m), *(x.item() if hasattr(x, "item") else x for x in r)) for m, r in zip(ms, part[self.step.columns].itertuples(index=False, name=None), strict=True)]
            self.waiting.appendList(listed)
            self.handle.registerTimer(min(r[0] for r in listed) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        state, out = (tuple(self.state.get()) if self.state.exists() else None), []
        for ms, *row in sorted(r for r in waiting if r[0] < mark):
            state, found = self.step.step(state, ms, tuple(row))
            out += found
        later = [r for r in waiting if r[0] >= mark]
        if state is not None and self.step.until(state) < mark:
            out += self.step.end(state)
            state = None
        self.waiting.put(later) if later else self.waiting.clear()
        self.state.update(state) if state is not None else self.state.clear()
        times = [min(r[0] for r in later) + 1] if later else []
        times += [max(self.step.until(state) + 1, mark + 1)] if state is not None else []
        if times:
            self.handle.registerTimer(min(times))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.names)

    def close(self) -> None:
        pass


def _sorted_rows(step: Any, key: str, names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The same step over rows sorted by key and time; of a key only its state is held."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, state, some = None, None, False
        for frame in frames:
            out: list[tuple] = []
            for k, ms, *row in frame[[key, "ms", *step.columns]].itertuples(index=False, name=None):
                if not some or k != mine:
                    out += [(mine, *r) for r in step.end(state)] if state is not None else []
                    mine, state, some = k, None, True
                state, found = step.step(state, int(ms), tuple(row))
                out += [(k, *r) for r in found]
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([(mine, *r) for r in step.end(state)], columns=names)

    return task


def in_order(rows: DataFrame, step: Any, key: str, delay: str) -> DataFrame:
    """Rows with key, ts (timestamp) and the step's columns, by key in order of time and of those columns; keys are not null."""
    kind = dict(rows.dtypes)[key]
    schema = step.schema.format(key=kind)
    names = [c.split()[0] for c in schema.split(", ")]
    if rows.isStreaming:
        timed_store(rows.sparkSession)
        kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in step.columns)
        marked = rows.select(key, "ts", *step.columns).withWatermark("ts", delay)
        return marked.groupBy(key).transformWithStateInPandas(_InOrder(step, key, kinds, names), schema, "append", "eventTime")
    timed = rows.select(key, F.unix_millis("ts").alias("ms"), *step.columns)
    return timed.repartition(key).sortWithinPartitions(key, "ms", *step.columns).mapInPandas(_sorted_rows(step, key, names), schema)


def stream_bursts(shots: DataFrame, window_s: int = 2, bits: int = 10, least: int = 3, delay: str = "10 minutes") -> DataFrame:
    """source, first_id, n, best of bursts as they close. shots has source, id, ts (timestamp), phash, score; the best shot has
    the highest score, the first one of equals. Shots that come late, within the delay, still find their place."""
    return in_order(shots, Bursts(window_s, bits, least), "source", delay)


def _timed(rows: DataFrame) -> DataFrame:
    return rows if "ts" in rows.columns else rows.withColumn("ts", F.timestamp_seconds("at"))


def alert_throttle(alerts: DataFrame, every_s: int = 12 * 3600, delay: str = "0 seconds") -> DataFrame:
    """alert, at of alerts that are shown: the same one at most once in a span, at once again after it was cleared. alerts has
    alert, at (seconds), active. Of reports of one second those that clear come first."""
    return in_order(_timed(alerts), Throttle(every_s), "alert", delay)


def rate_limit(events: DataFrame, per_hour: int = 10, per_day: int = 30, delay: str = "0 seconds") -> DataFrame:
    """key, at, accepted, wait_min: only accepted events count against the limits. events has key and at (seconds)."""
    return in_order(_timed(events), Limit(per_hour, per_day), "key", delay)


def live_counts(outcomes: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Outcomes (ts, status, bytes) by time window and status."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = outcomes.withWatermark("ts", delay) if outcomes.isStreaming else outcomes
    return rows.groupBy(span.alias("w"), "status").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "n", "bytes")


def dedup_stream(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first row of each content (sha256) within the watermark; a batch has one row per content."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sha256"]) if rows.isStreaming else rows.dropDuplicates(["sha256"])
