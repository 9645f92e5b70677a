"""Mixing sources to target weights by a low-discrepancy source schedule, in DataFrame operations only.

The mix is a sequence of slots of equal size in words. Slot i takes the golden-ratio point frac((i + 1/2) * phi), which
is mapped through the cumulative target shares to a source; the slots of a source are ranked, and slot r of a source
takes words [r * block, (r + 1) * block) of that source's shuffled documents laid end to end, starting over when they
are used up. A source therefore gets its share in every stretch of the mix, not only over the whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settled, text_of

#: Words of a slot, weights in turn, most passes over a source, hash ranges of a source, cells of the point axis.
BLOCK_WORDS = 512
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
RANGES = 4096
CELLS = 1024
GOLDEN = (math.sqrt(5) - 1) / 2


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of the whole text (null: 0)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
    )


def target_table(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """One row per source: source_size, weight, target, quota (whole words the mix takes), low and high of its share.

    Water is poured by weight: sources are ordered by cap / weight, and a source is full when the level that the rest
    would get reaches its cap. That is the fixed point of resharing the excess until no source is above its cap.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on: these windows see as many rows as there are sources.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1))
    filling = Window.orderBy(
        (F.col("source_size") * most / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    )
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.select(
        "source",
        "source_size",
        "weight",
        (F.col("source_size") * most).alias("cap"),
        (F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("heavy"),
    ).withColumn("full", F.col("left") * F.col("weight") > F.col("cap") * F.col("heavy"))
    first_free = Window.partitionBy(F.lit(1))
    level = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("k"), F.col("source").isNull(), F.col("source"), F.col("left"), F.col("heavy")))).over(first_free)
    settled_ = levels.withColumn("level", level).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("full"), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * F.col("level.left") / F.col("level.heavy"))
        .alias("target"),
    )
    shares = Window.orderBy(F.col("source").asc_nulls_last())
    reach = F.sum("target").over(shares.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("target").over(shares.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        settled_.withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * most))
        .withColumn("high", F.when(total > 0, reach / total).otherwise(F.lit(0.0)))
        .withColumn("low", F.coalesce(F.lag("high").over(shares), F.lit(0.0)))
        .withColumn("high", F.when(F.lead("source_size").over(shares).isNull(), F.lit(1.0)).otherwise(F.col("high")))
    )


def _key(source: Column) -> Column:
    """A join key that tells a null source from every string."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, key, rank: which source each slot draws from, and that source's how-manieth slot it is.

    Each source gets ceil(quota / block) slots. Points beyond that are passed over, and the few that the sequence
    leaves out (its discrepancy, logarithmic in the number of slots) follow at the end.
    """
    spark = targets.sparkSession
    sources = targets.where("quota > 0").select(
        _key(F.col("source")).alias("key"), "low", "high", F.ceil(F.col("quota") / block).cast("long").alias("need")
    )
    n_slots = sources.agg(F.coalesce(F.sum("need"), F.lit(0)).alias("n")).first()["n"]
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), F.pmod((F.col("id") + 0.5) * F.lit(GOLDEN), F.lit(1.0)).alias("u")
    )
    # Equal cells of the axis turn the range join into an equi-join; points fall evenly into cells.
    spread = sources.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))))
    )
    drawn = (
        points.withColumn("cell", F.floor(F.col("u") * CELLS))
        .join(spread, "cell")
        .where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        .select("slot", "key", "need")
    )
    # Rank within a source in two steps, so that a source with a third of all slots is not one task.
    part = F.floor(F.col("slot") / 65536)
    drawn = drawn.withColumn("part", part)
    counts = drawn.groupBy("key", "part").agg(F.count("*").alias("n"))
    ahead = counts.select(
        "key",
        "part",
        (F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).alias("ahead"),
    )
    local = F.row_number().over(Window.partitionBy("key", "part").orderBy("slot")) - 1
    ranked = (
        drawn.withColumn("local", local)
        .join(ahead, ["key", "part"])
        .select("slot", "key", (F.col("local") + F.col("ahead")).alias("rank"), "need")
        .where("rank < need")
        .select("slot", "key", "rank")
    )
    given = counts.groupBy("key").agg(F.sum("n").alias("given"))
    missing = (
        sources.join(given, "key", "left")
        .withColumn("given", F.coalesce(F.col("given"), F.lit(0)))
        .where("given < need")
        .select("key", F.explode(F.sequence(F.col("given"), F.col("need") - 1)).alias("rank"))
        .select((F.lit(n_slots) + F.xxhash64("key", "rank").bitwiseAND(F.lit(2**40 - 1))).alias("slot"), "key", "rank")
    )
    return ranked.unionByName(missing)


def streams(sizes: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, key, start, source_size, quota: where a document begins in its source's shuffled stream.

    The order is that of md5(seed, doc_id). Running totals are taken within hash ranges and then over ranges, so a
    source of any size is spread over RANGES windows.
    """
    shuffled = sizes.select(
        "doc_id", "size", _key(F.col("source")).alias("key"), F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("lot")
    ).withColumn("range", F.conv(F.substring("lot", 1, 3), 16, 10).cast("int"))
    within = Window.partitionBy("key", "range").orderBy("lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranges = shuffled.groupBy("key", "range").agg(F.sum("size").alias("words"))
    ahead = ranges.select(
        "key", "range", (F.sum("words").over(Window.partitionBy("key").orderBy("range")) - F.col("words")).alias("ahead")
    ).join(targets.select(_key(F.col("source")).alias("key"), "source_size", "target", "quota"), "key")
    return (
        shuffled.withColumn("local", F.sum("size").over(within) - F.col("size"))
        .join(ahead, ["key", "range"])
        .select("doc_id", "size", "key", (F.col("local") + F.col("ahead")).alias("start"), "source_size", "target", "quota")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """The mix itself: slot, rank, source key, doc_id, pass, first word and number of words of each piece.

    docs has doc_id, source and text. Empty documents take no part; a null source is a source of its own, ordered
    last; repeated rows are documents of their own. An empty table gives an empty mix.
    """
    sizes = settled(sized(docs))
    targets = settled(target_table(sizes, weights))
    return _pieces(streams(sizes, targets, seed), block).join(schedule(targets, block), ["key", "rank"])


def _pieces(laid: DataFrame, block: int) -> DataFrame:
    """Cuts each document's runs through the stream at slot borders: key, rank, doc_id, size, pass, first, words."""
    # A source is passed over at most MOST_PASSES times; the last pass stops at the quota.
    runs = (
        laid.where("size > 0 and quota > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("source_size")).cast("int"))))
        .withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size"))
        .withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota")))
        .where("begin < end")
    )
    return runs.withColumn(
        "rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)))
    ).select(
        "key",
        "rank",
        "doc_id",
        "size",
        "start",
        "pass",
        (F.greatest(F.col("begin"), F.col("rank") * block) - F.col("begin")).alias("first"),
        (F.least(F.col("end"), (F.col("rank") + 1) * block) - F.greatest(F.col("begin"), F.col("rank") * block)).alias("words"),
    )


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's) and taken (words over all slots)."""
    sizes = settled(sized(docs))
    targets = settled(target_table(sizes, weights))
    laid = streams(sizes, targets, seed)
    scheduled = (
        _pieces(laid, block)
        .join(schedule(targets, block), ["key", "rank"])
        .groupBy("key", "start", "size")
        .agg(F.sum("words").alias("taken"))
    )
    # Non-empty documents of a source never begin at the same word, so start tells even repeated rows apart.
    return (
        laid.join(scheduled, ["key", "start", "size"], "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs repeated as the mix asks: a document taken for k times its size comes k times, rounded up, at most thrice.

    A row keeps all its columns. Whole documents are repeated because later stages read whole texts.
    """
    times = mix_report(docs, weights).where("taken > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times"))
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(times, F.col("row.doc_id").eqNullSafe(F.col("id"))).select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")
