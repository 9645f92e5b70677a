"""Like hashes, compared in tasks: rows that may be alike are dealt to one group, and numpy compares a group in memory.

Only the rows travel, each once or a few times; what an index of a hash would explode a row into stays inside its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.functions.scalars import BANDS, hash_band
from fotolake.storage import settled

#: Rows of a cell that one task compares with each other; fuller cells are dealt to several tasks.
CROWD = 65_536
#: Cells up to which rows that ask a neighbouring cell are asked whether it is there before they travel.
FEW_CELLS = 100_000
#: Pairs of hashes that are compared at once.
AT_ONCE = 1 << 20
#: Different hashes with one value of a band, beyond which they are dealt by a second band.
FULL_BAND = 2_000_000
#: What a row is in its group: it can be found, it asks, it lies in the cell itself.
POINT, ASKS, OWN = 1, 2, 4


def tasks_of(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator, keys: int) -> Iterator:
    """Record batches sorted by their first columns, the keys, cut anew so that no group of equal keys is parted."""
    import pyarrow as pa

    def joined(parts: list) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in columns)
        cuts = np.flatnonzero(new)
        last = tuple(c[-1] for c in columns)
        if len(cuts):
            cut = int(cuts[-1])
            if held or cut:
                yield joined([*held, batch.slice(0, cut)] if cut else held)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield joined(held)


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for c in keys:
        new[1:] |= c[1:] != c[:-1]
    return new


def pairs_within(group: np.ndarray, role: np.ndarray, phash: np.ndarray, ids: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asking row, found row) with hashes within bits, for rows by ascending group; two rows of the cell itself meet once."""
    asks, points = np.flatnonzero(role & ASKS), np.flatnonzero(role & POINT)
    n = np.bincount(group[points], minlength=int(group[-1]) + 1)
    begin = np.cumsum(n) - n
    found = n[group[asks]]
    at = 0
    ends = np.cumsum(found)
    while at < len(asks):
        # As many asking rows as make AT_ONCE pairs, one at least.
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")), at + 1)
        if group[asks[at]] == group[asks[to - 1]]:
            # One group: a product, without an index for each pair.
            own = points[begin[group[asks[at]]] :][: found[at]]
            hit = np.flatnonzero(np.bitwise_count(phash[asks[at:to], None] ^ phash[own]) <= bits)
            a, b = (asks[at:to][hit // len(own)], own[hit % len(own)]) if len(own) else (hit, hit)
        else:
            a = np.repeat(asks[at:to], found[at:to])
            first = np.repeat(begin[group[asks[at:to]]] - (ends[at:to] - found[at:to]), found[at:to])
            b = points[first + np.arange(ends[to - 1] - len(a), ends[to - 1])]
            near = np.bitwise_count(phash[a] ^ phash[b]) <= bits
            a, b = a[near], b[near]
        once = (role[a] & OWN == 0) | (ids[a] < ids[b])
        if once.any():
            yield a[once], b[once]
        at = to


def alike_in_cells(own: DataFrame, asks: DataFrame, bits: int, crowd: int = CROWD) -> DataFrame:
    """(same, p, q) whose hashes differ in at most so many bits: q of a cell's own rows (cell, phash, id, p) and p of those or, with
    same false, of the rows that ask for its cell from outside. Each two own rows are listed once; their ids are different."""
    counts = settled(own.groupBy("cell").agg(F.count("*").alias("n")))
    if counts.count() <= FEW_CELLS:
        asks = asks.join(F.broadcast(counts.select("cell")), "cell", "left_semi")
    columns = ["cell", "phash", "id", "p"]
    rows = own.select(*columns, F.lit(True).alias("own")).unionByName(asks.select(*columns, F.lit(False).alias("own")))
    full = counts.where(F.col("n") > crowd).select("cell", F.ceil(F.col("n") / crowd).alias("blocks"))  # one row per crowd rows at most
    deal = lambda at, role: F.struct(F.lit(at).cast("long").alias("deal"), F.lit(role).cast("int").alias("role"))
    alone = F.when(F.col("own"), F.lit(POINT | ASKS | OWN)).otherwise(F.lit(ASKS)).alias("role")
    if full.isEmpty():
        dealt = rows.select("cell", F.lit(0).cast("long").alias("deal"), alone, "phash", "id", "p")
    else:
        # Any block of a full cell's rows meets any block of those that ask.
        n, k = F.col("blocks"), F.pmod(F.xxhash64("id"), F.col("blocks"))
        blocks = F.sequence(F.lit(0).cast("long"), n - 1)
        asking = F.transform(blocks, lambda i: deal(i * n + k, F.when(F.col("own"), ASKS | OWN).otherwise(ASKS)))
        found = F.filter(F.transform(blocks, lambda i: deal(k * n + i, POINT | OWN)), lambda _: F.col("own"))
        one = F.array(deal(0, F.when(F.col("own"), POINT | ASKS | OWN).otherwise(ASKS)))
        ways = F.when(n.isNull(), one).otherwise(F.concat(asking, found))
        dealt = rows.join(F.broadcast(full), "cell", "left").select("cell", F.explode(ways).alias("way"), "phash", "id", "p").select("cell", "way.deal", "way.role", "phash", "id", "p")

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in whole_groups(batches, 2):
            cell, at, role, phash, ids = (batch.column(i).to_numpy() for i in range(5))
            group = np.cumsum(_starts(cell, at)) - 1
            p = batch.column(5)
            for a, b in pairs_within(group, role, phash.view(np.uint64), ids, bits):
                yield pa.RecordBatch.from_arrays([pa.array(role[a] & OWN > 0), p.take(pa.array(a)), p.take(pa.array(b))], names=["same", "p", "q"])

    kind = dict(own.dtypes)["p"]
    return dealt.repartition(tasks_of(own), "cell", "deal").sortWithinPartitions("cell", "deal").mapInArrow(task, f"same boolean, p {kind}, q {kind}")


def copies_within(hashes: np.ndarray, leads: tuple[int, ...], agree: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of different hashes that agree in bands leads for which these are the first of the agree bands they agree in."""
    mask = [np.uint64((1 << BANDS[b + 1]) - (1 << BANDS[b])) for b in range(len(BANDS) - 1)]
    for rest in combinations(range(leads[-1] + 1, len(mask)), agree - len(leads)):
        chosen = (*leads, *rest)
        # Pairs that agree in a band before the last one that is not chosen meet under another choice.
        others = [mask[b] for b in range(chosen[-1]) if b not in chosen]
        keys = hashes & np.uint64(sum(int(mask[b]) for b in rest))
        by = np.argsort(keys, kind="stable")
        keys, h = keys[by], hashes[by]
        at, step = np.flatnonzero(keys[1:] == keys[:-1]), 1
        while len(at):
            x = h[at] ^ h[at + step]
            fresh = np.ones(len(at), bool)
            for m in others:
                fresh &= x & m != 0
            if fresh.any():
                yield by[at[fresh]], by[at[fresh] + step]
            step += 1
            at = at[at + step < len(keys)]
            at = at[keys[at + step] == keys[at]]


def copies(first: DataFrame, most: int) -> DataFrame:
    """(a, b), each once: rows (a, phash) of different hashes that differ in at most most bits.

    Two such hashes agree in at least 7 - most of the seven bands. The first of these is one of the first most + 1, so a row
    goes to so many groups; the other bands are looked at there.
    """
    agree = len(BANDS) - 1 - most
    value = lambda b: F.lit(b * 1024).cast("long") + hash_band(F.col("phash"), b)
    rows = first.select("a", "phash", F.explode(F.array(*[value(b) for b in range(most + 1)])).alias("lead"))
    full = [r["lead"] for r in rows.groupBy("lead").count().where(F.col("count") > FULL_BAND).collect()]  # 1,024 a band at most
    second = F.lit(0).cast("long")
    if full and agree > 1:
        values = F.array(*[value(b) for b in range(len(BANDS) - 1)])
        after = F.filter(values, lambda v: (v >= (F.floor(F.col("lead") / 1024) + 1) * 1024) & (v < (len(BANDS) + 1 - agree) * 1024))
        second = F.explode(F.when(F.col("lead").isin(full), after).otherwise(F.array(second)))
    rows = rows.select("lead", second.alias("second"), "phash", "a")

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in whole_groups(batches, 2):
            lead, second, phash, a = (batch.column(i).to_numpy() for i in range(4))
            cuts = np.append(np.flatnonzero(_starts(lead, second)), len(lead))
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e - s < 2:
                    continue
                leads = (int(lead[s]) // 1024, int(second[s]) // 1024) if second[s] else (int(lead[s]) // 1024,)
                h, ids = phash[s:e].view(np.uint64), a[s:e]
                for i, j in copies_within(h, leads, agree):
                    near = np.bitwise_count(h[i] ^ h[j]) <= most
                    if near.any():
                        i, j = ids[i[near]], ids[j[near]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    return rows.repartition(tasks_of(first), "lead", "second").sortWithinPartitions("lead", "second").mapInArrow(task, "a long, b long")
