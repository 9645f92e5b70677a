"""Conversation structure repair by weighted CYK interval parsing over spans of rows.

A conversation is well formed when the initials of its roles match (s?(ua)+)?. The repair grammar is in Chomsky normal form.
Its nonterminals are pairs of states of that pattern: N(p, q) derives the spans of rows whose repair leads from p to q.
Terminal rules are the edits of one row (keep, rerole, delete), binary rules are N(p, q) -> N(p, r) N(r, q), and insertions,
which derive an empty span, are closed over once for each row. A cell of a span holds the least (cost, audit) of each
nonterminal; cells are combined bottom-up by span length.

Least pairs of parts are parts of least pairs: audits of one span and nonterminal with one cost are never prefixes of each
other, since an insertion more costs 2 more, so what is less in a part is less in the whole.

Rows are numbered over ranges of all conversations. Spans of WINDOW rows get a full chart each; what such charts derive is
joined WINDOW spans at a time until a conversation is one span, so no conversation has to fit into a task. A nonterminal
fixes the states on both of its sides, so every split of a span gives the same cell; above the charts one split is enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.operators.windows import numbered

from .common import settled, tidy

#: Rows of a chart, and spans that are joined at a time.
WINDOW = 16
#: Costs of edits; a kept or rerole'd truncated row costs 1 more.
REROLE, DELETE, INSERT = 2, 3, 2

#: States: nothing yet, after system, after user, after assistant. Steps by initial.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
REACH = {0: (0, 1, 2, 3), 1: (1, 2, 3), 2: (2, 3), 3: (2, 3)}
NONTERMINALS = [(p, q) for p in REACH for q in REACH[p]]
RULES = [((p, q), (p, r), (r, q)) for p in REACH for r in REACH[p] for q in REACH[r]]

#: nonterminal -> (cost, audit)
Cell = dict[tuple[int, int], tuple[int, str]]


def better(cell: Cell, key: tuple[int, int], cost: int, audit: str) -> None:
    had = cell.get(key)
    if had is None or (cost, audit) < had:
        cell[key] = (cost, audit)


def joined(left: Cell, right: Cell, into: Cell | None = None) -> Cell:
    """The binary rules over two neighbouring spans."""
    out: Cell = {} if into is None else into
    for whole, first, second in RULES:
        if first in left and second in right:
            a, b = left[first], right[second]
            better(out, whole, a[0] + b[0], a[1] + b[1])
    return out


def _insertions() -> Cell:
    """What an empty span derives: any number of insertions, closed."""
    cell: Cell = {(p, p): (0, "") for p in REACH}
    single: Cell = {(p, q): (INSERT, "I") for (p, initial), q in STEPS.items() if initial != "s"}
    while True:
        more = joined(cell, single, dict(cell))
        if more == cell:
            return cell
        cell = more


EMPTY = _insertions()


@lru_cache(None)
def _row(code: str) -> Cell:
    """The cell of one row. Codes: x has to go; s, u, a, o are initials (o any other); capitals are truncated rows."""
    cell: Cell = {(p, p): (DELETE, "D") for p in REACH}
    if code != "x":
        extra = int(code.isupper())
        for (p, initial), q in STEPS.items():
            if initial == code.lower():
                better(cell, (p, q), extra, "K")
            if initial != "s":
                better(cell, (p, q), REROLE + extra, "R")
    return joined(joined(EMPTY, cell), EMPTY)


@lru_cache(1 << 14)
def parsed(codes: str) -> Cell:
    """CYK over a window of rows: the cell of the whole, by way of the cells of all spans and all their splits."""
    chart: dict[tuple[int, int], Cell] = {(i, i + 1): _row(c) for i, c in enumerate(codes)}
    for span in range(2, len(codes) + 1):
        for start in range(len(codes) - span + 1):
            cell: Cell = {}
            for split in range(start + 1, start + span):
                joined(chart[start, split], chart[split, start + span], cell)
            chart[start, start + span] = cell
    return chart[0, len(codes)]


def combined(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, pairs of equal length first."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


# -- rows ---------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(conv_id:turn) % 20 tells: 0 drops a row, 1 empties its text, 2
    removes its . ! and ?, 3 repeats it, 4 sets its role to user. Nulls of role and text, and in the key, are one space."""
    blank = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("harm", F.crc32(key) % 20).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("again")).drop("again")


def _key(conv_id: Column) -> Column:
    """Rows without conv_id are a conversation of their own; the key has no nulls, so it joins."""
    return F.coalesce(conv_id.cast("long").cast("string"), F.lit(" "))


def in_order(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, number: all rows numbered by conversation, turn (nulls first), role and text."""
    blank = F.lit(" ")
    rows = conversations.select(
        _key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    return settled(numbered(rows, ["conv", "turn", "role", "text"], "number"))


def judged(rows: DataFrame) -> DataFrame:
    """conv, turn, number, initial (s, u, a, or o for any other), fault (blank, duplicate, truncated or null).

    A duplicate is found by its number: the first row of each conversation, role and SHA-256 of the text is not one, so
    neither a conversation nor a text that everyone repeats is one task.
    """
    has = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ends = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    first = rows.where(has).groupBy("conv", "role", F.sha2("text", 256).alias("digest")).agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    slim = rows.select("conv", "turn", "number", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), has.alias("has"), ends.alias("ends"))
    fault = F.when(~F.col("has"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ends"), "truncated")
    return settled(slim.join(first, "number", "left").select("conv", "turn", "number", "initial", fault.alias("fault")))


# -- charts -------------------------------------------------------------------------------------------------------------

_CELLS = "array<struct<p: int, q: int, cost: bigint, audit: string>>"
_SPANS = f"conv string, span bigint, first bigint, cells {_CELLS}"


def _rows_of(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]


def _cell_of(rows: list[dict]) -> Cell:
    return {(r["p"], r["q"]): (r["cost"], r["audit"]) for r in rows}


_ARROW_CELLS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _spans(batch: pa.RecordBatch, cells: list[Cell]) -> pa.RecordBatch:
    columns = [batch.column(batch.schema.get_field_index(c)) for c in ("conv", "span", "first")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(map(_rows_of, cells), _ARROW_CELLS)], names=["conv", "span", "first", "cells"])


def _charts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _spans(batch, [parsed(c) for c in batch.column("codes").to_pylist()])


def _joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield _spans(one, [combined([_cell_of(s["cells"]) for s in one.column("parts")[0].as_py()])])


def _listed(spans: DataFrame, *keys: Column) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("span", "first", "cells")))
    grouped = spans.groupBy("conv", *keys).agg(parts.alias("parts"), F.min("first").alias("first"))
    if not keys:
        grouped = grouped.withColumn("span", F.lit(0).cast("long"))
    return grouped.select("conv", "span", "first", "parts").mapInArrow(_joins, _SPANS)


def parses(found: DataFrame) -> DataFrame:
    """conv, first (number of its first row), cost, audit: the cheapest repair of each conversation, the ASCII-least of equals.

    found is as judged() gives it. Audits name the edits in order: K keep, R rerole, D delete, I insert.
    """
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    windows = found.groupBy("conv", F.floor(F.col("number") / WINDOW).alias("span")).agg(
        F.min("number").alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", code.alias("code")))), lambda x: x["code"]), "").alias("codes"),
    )
    spans, done = settled(windows.mapInArrow(_charts, _SPANS)), []
    while True:
        counts = spans.groupBy("conv").agg(F.count("*").alias("n"))
        longer = counts.where(F.col("n") > WINDOW)
        if longer.isEmpty():
            done.append(spans)
            break
        # A conversation of few spans is joined at once, any other by neighbours; each of these lists is at most WINDOW long.
        done.append(spans.join(longer, "conv", "left_anti"))
        spans = settled(_listed(spans.join(longer, "conv", "left_semi"), F.floor(F.col("span") / WINDOW).alias("span")))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    whole = _listed(whole)
    final = F.array_min(F.transform(F.filter("cells", lambda c: (c["p"] == FINAL[0]) & c["q"].isin(*FINAL)), lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    return settled(whole.select("conv", "first", final.alias("best")).select("conv", "first", "best.cost", "best.audit"))


# -- repaired conversations ---------------------------------------------------------------------------------------------

_EDITS = "conv string, place bigint, number bigint, edit string, new_role string"
#: Edits that leave a task at a time.
CHUNK = 1 << 16


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits as one row for each row that stays or comes. Places alternate between user and assistant, after a system row
    where the number of rows is odd."""
    names = ["conv", "place", "number", "edit", "new_role"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows: list[tuple] = []
        for conv, number, audit in zip(*(batch.column(c).to_pylist() for c in ("conv", "first", "audit")), strict=True):
            odd, place = (len(audit) - audit.count("D")) % 2, 0
            for edit in audit:
                if edit != "D":
                    rows.append((conv, place, None if edit == "I" else number, edit, None if edit == "K" else ("user", "assistant")[(place - odd) % 2]))
                    place += 1
                number += edit != "I"
                if len(rows) >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv, place (from 0), edit (K, R or I), role, text of the conversations after the edits of parses(); rows as in_order() gives them."""
    edits = found.mapInArrow(_edits, _EDITS).join(rows.select("number", "role", "text"), "number", "left")
    return edits.select("conv", "place", "edit", F.coalesce("new_role", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: every conversation after its cheapest repair.

    conversations has conv_id, turn, role and text; other columns are ignored. Nulls of role and text are one space, which
    makes a row blank or of no known role; rows without conv_id are one conversation, null turns come first. Rows of one
    turn are taken by role and text; equal ones are duplicates of each other. A conversation whose rows all go is not in the
    result. An empty table gives no rows.
    """
    rows = in_order(conversations)
    return repaired(rows, parses(judged(rows))).select(F.expr("try_cast(conv as bigint)").alias("conv_id"), "place", "edit", "role", "text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines as they stream by, ordered by conversation and place; no conversation is held."""
    conv, digest = None, None
    for batch in batches:
        out: list[tuple[str, str]] = []
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text")), strict=True):
            if c != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=["conv", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])


def repair_report(conversations: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row per conv_id of originals (else of conversations): gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, and n_rows, those before the repair.

    Cases are handled as in repair(). gaps counts turns that are missing between the least and the greatest; illegal counts
    neighbouring rows whose initials are not su, ua or au. Conversations without rows have zeros, an empty audit and the hash
    of the empty string. An empty table gives no rows. A SHA-256 is sequential: each conversation's lines pass one task, as a
    stream.
    """
    rows = in_order(conversations)
    found = judged(rows)
    best = parses(found)
    # The last row of each window is seen from the next one too, so pairs across windows count in one of them.
    window = F.floor(F.col("number") / WINDOW)
    seen = F.when(F.col("number") % WINDOW == WINDOW - 1, F.array(window, window + 1)).otherwise(F.array(window))
    strings = found.select("conv", "number", "initial", F.explode(seen).alias("span")).groupBy("conv", "span").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "initial"))), lambda x: x["initial"]), "").alias("initials")
    )
    pairs = F.when(F.length("initials") > 1, F.sequence(F.lit(1), F.length("initials") - 1)).otherwise(F.array().cast("array<int>"))
    wrong = F.size(F.filter(pairs, lambda i: ~F.col("initials").substr(i, F.lit(2)).isin("su", "ua", "au")))
    illegal = strings.groupBy("conv").agg(F.sum(wrong).alias("illegal"))
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    faults = found.groupBy("conv").agg(F.count("*").alias("n_rows"), count("blank"), count("duplicate"), count("truncated"))
    turns = found.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    lines = repaired(rows, best)
    with tidy(rows.sparkSession):
        digests = settled(lines.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_digests, "conv string, repaired_sha256 string"))
    every = (conversations if originals is None else originals).select(_key(F.col("conv_id")).alias("conv")).distinct()
    for side in (turns, faults, illegal, best.drop("first"), digests):
        every = every.join(side, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.select(
        F.expr("try_cast(conv as bigint)").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"), zero("n_rows"),
    )
