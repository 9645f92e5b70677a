"""Undo and redo as a log: entries with the values before and after, and commands that push, take back and repeat them.

A command is do, undo or redo. An undo takes back the last entry of its session that stands, at most depth of them in a row; a
redo repeats what the last undo took back; a new entry ends what could be repeated. The state of all rows follows from the log
alone: the last command that wrote a field decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.operators.mutations import before_image
from fotolake.operators.windows import numbered, prev_next, summed_before
from fotolake.storage import settled

#: Entries that can be taken back.
DEPTH = 100


def entry(photos: DataFrame, ids: DataFrame, fields: dict, session: int, seq: int) -> DataFrame:
    """(session, seq, id, field, before, after) as strings of what a patch changes: one row for each photo that it changes and
    each of its fields. A patch that changes nothing is no entry, so it has no rows."""
    image = before_image(photos, ids, fields)
    sides = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("before"), F.lit(None if v is None else v).cast(dict(photos.dtypes)[c]).cast("string").alias("after")) for c, v in fields.items()]
    return image.select(F.lit(session).cast("long").alias("session"), F.lit(seq).cast("long").alias("seq"), "id", F.explode(F.array(*sides)).alias("x")).select("session", "seq", "id", "x.*")


def _effects(depth: int):
    """How a session's commands move its stack: 1, -1, or 0 where there is nothing to take back or to repeat. Rows come sorted by
    session and order; of a session only two numbers are held: entries that stand, and those that could be repeated."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, stands, undone = None, 0, 0
        for frame in frames:
            moves = []
            for session, kind in zip(frame["session"], frame["kind"], strict=True):
                if session != mine:
                    mine, stands, undone = session, 0, 0
                move = 0
                if kind == "do":
                    stands, undone, move = min(stands + 1, depth), 0, 1
                elif kind == "undo" and stands:
                    stands, undone, move = stands - 1, undone + 1, -1
                elif kind == "redo" and undone:
                    stands, undone, move = stands + 1, undone - 1, 1
                moves.append(move)
            yield frame.assign(move=moves)

    return task


def resolved(commands: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(session, seq, kind, entry): the entry that each command pushes, takes back or repeats, by the seq of its do; commands that
    find nothing are left out. commands has session, seq (different within a session) and kind, none of them null.

    Levels of the stack are a running sum of moves. What an undo takes back is the last entry that was pushed to its level,
    what a redo repeats the last one pushed to the next: an as-of lookup by session and level.
    """
    rows = commands.select("session", "seq", "kind").where(F.col("kind").isin("do", "undo", "redo"))
    schema = f"session {dict(rows.dtypes)['session']}, seq {dict(rows.dtypes)['seq']}, kind string, move int"
    moves = rows.repartition("session").sortWithinPartitions("session", "seq").mapInPandas(_effects(depth), schema).where("move <> 0")
    placed = settled(numbered(moves, ["session", "seq"], "place"))
    levels = summed_before(placed, "place", F.col("move").cast("long"), "below", placed.count(), ("session",))
    level = F.when(F.col("kind") == "undo", F.col("below")).otherwise(F.col("below") + 1)
    found = prev_next(levels.withColumn("level", level).select("session", "level", "seq", "kind"), ["seq"], F.when(F.col("kind") == "do", F.col("seq")), "entry", ("session", "level"))
    return found.select("session", "seq", "kind", F.when(F.col("kind") == "do", F.col("seq")).otherwise(F.col("entry_prev")).alias("entry"))


def values_after(commands: DataFrame, entries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(id, field, value) after all commands, for what they wrote; seq orders the commands of all sessions."""
    steps = resolved(commands, depth).select("session", F.col("entry").alias("of"), F.col("seq").alias("at"), "kind")
    writes = entries.withColumnRenamed("seq", "of").join(steps, ["session", "of"])
    value = F.when(F.col("kind") == "undo", F.col("before")).otherwise(F.col("after"))
    last = writes.groupBy("id", "field").agg(F.max_by(F.struct(value.alias("value")), F.struct("at", "session"))["value"].alias("value"))
    return last.select("id", "field", "value")


def after_history(photos: DataFrame, commands: DataFrame, entries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """photos as they are after all commands; entries name columns of photos."""
    found = values_after(commands, entries, depth).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value").alias("v")))).alias("__now"))
    both = photos.join(found, "id", "left")
    # A value may be null; what was written is told by its key.
    new = lambda c: F.try_element_at("__now", F.lit(c))
    columns = [F.col(c) if c == "id" else F.when(new(c).isNotNull(), new(c)["value"].cast(kind)).otherwise(F.col(c)).alias(c) for c, kind in photos.dtypes]
    return both.select(*columns)
