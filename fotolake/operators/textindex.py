"""Text search, in one scan over the texts for a list of needles, or by postings of texts that are searched again and again.

A scan knows a needle by its longest run of signs between wildcards (scan.py); texts do not travel, and nothing is written.
Postings lead from each three signs to the rows that hold them: a needle is looked up by its rarest three signs, and only rows
that have these are compared with the whole needle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.operators.scan import Finder
from fotolake.operators.windows import ranked
from fotolake.storage import apart, settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3
#: Rows of a part of a posting list; a sign run that most rows have is so many parts.
PART = 65_536
#: Needles that one scan looks for, and that a task knows; more of them take as many scans.
AT_ONCE = 250_000


def folded(text: Column) -> Column:
    """ASCII letters in lower case; all others stay."""
    return F.translate(text, UPPER, LOWER)


def grams(text: Column) -> Column:
    """The different runs of GRAM signs in a text; its signs are parted once, so the work grows with its length."""
    signs = F.split(text, "")
    last = F.size(signs) - GRAM

    def run(i: Column, parts: Column) -> Column:
        return F.concat(*[F.get(parts, i + j) for j in range(GRAM)])

    runs = F.transform(F.array(signs), lambda parts: F.transform(F.sequence(F.lit(0), F.size(parts) - GRAM), lambda i: run(i, parts)))
    return F.when(last >= 0, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def postings(texts: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(gram, part, id), sorted by gram within files, and (gram, n, parts): the index of texts (id, text), in the shared folder.
    With wanted (gram) it has the lists of those alone."""
    pairs = texts.where("text is not null").select("id", F.explode(grams(folded(F.col("text")))).alias("gram"))
    if wanted is not None:
        pairs = settled(pairs.join(wanted, "gram", "left_semi"))
    counts = settled(pairs.groupBy("gram").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    # Long lists are cut by a hash of the row, so no list is one task.
    common = counts.where("parts > 1").select("gram", "parts")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    lists = pairs.join(common, "gram", "left").select("gram", part.alias("part"), "id")
    return settled(lists.repartition("gram", "part").sortWithinPartitions("gram", "part")), counts


def pattern(needle: Column) -> Column:
    """A needle as a regular expression: % stands for anything, _ for one sign, all else for itself."""
    quoted = F.regexp_replace(folded(needle), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("(?s)"), F.replace(F.replace(quoted, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit(".")))


def runs_of(needles: DataFrame) -> DataFrame:
    """(needle_id, gram): the different three signs in a row of needles (needle_id, needle)."""
    runs = F.filter(F.split(folded(F.col("needle")), "[%_]"), lambda r: F.length(r) >= GRAM)
    return needles.select("needle_id", F.explode(F.array_distinct(F.flatten(F.transform(runs, grams)))).alias("gram"))


def candidates(index: tuple[DataFrame, DataFrame], needles: DataFrame) -> DataFrame:
    """(needle_id, id): the rows in which needles (needle_id, needle) can be, by the rarest three signs of each."""
    lists, counts = index
    wanted = runs_of(needles)
    # A run that no row has is the rarest of all: it has no list, so its needle is nowhere.
    rarest = wanted.join(counts, "gram", "left").groupBy("needle_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "parts"))["gram"].alias("gram"))
    asked = rarest.join(counts.select("gram", "parts"), "gram").select("needle_id", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return asked.join(lists, ["gram", "part"]).select("needle_id", "id")


def search(texts: DataFrame, needles: DataFrame, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(needle_id, id): texts (id, text) that hold a needle (needle_id, needle) anywhere, ASCII case ignored, % and _ as wildcards.

    Ids and needle_ids are different. Null texts and needles match nothing; an empty needle matches every text that is one.
    """
    if index:
        return looked_up(texts, needles, index)
    asked = settled(needles.where("needle is not null").select(F.col("needle_id").alias("asks"), "needle"))
    scans = -(-asked.count() // AT_ONCE) or 1
    found = [scanned(texts, asked.where(F.pmod(F.xxhash64("asks"), F.lit(scans)) == i)) for i in range(scans)]
    return reduce(DataFrame.unionByName, found)


def scanned(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(needle_id, id) by one scan over the texts, for needles (asks, needle) that fit into a task."""
    rows = asked.toArrow()  # AT_ONCE rows or so
    finder = Finder(rows.column("asks").to_numpy(), rows.column("needle").to_pylist())
    sent = texts.sparkSession.sparkContext.broadcast(finder)

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            for rows, sizes, asks in sent.value.held(batch.column(1).to_pylist()):
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(asks))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), lists], names=["id", "asks"])

    kinds = dict(texts.dtypes)["id"], dict(asked.dtypes)["asks"]
    # As bytes: what is no proper text is read here as a regular expression would read it.
    met = texts.where("text is not null").select("id", F.col("text").cast("binary").alias("text")).mapInArrow(task, f"id {kinds[0]}, asks array<{kinds[1]}>")
    return met.select(F.explode("asks").alias("needle_id"), "id")


def looked_up(texts: DataFrame, needles: DataFrame, index: tuple[DataFrame, DataFrame]) -> DataFrame:
    """search() by an index of all texts. Needles too short for it meet all texts in blocks of a scan."""
    # Letters of texts are turned once; needles that are the same but for case are one.
    plain = settled(texts.where("text is not null").select("id", folded(F.col("text")).alias("text")))
    asked = settled(needles.where("needle is not null").select(F.col("needle_id").alias("asks"), folded(F.col("needle")).alias("needle")))
    different = settled(asked.groupBy("needle").agg(F.min("asks").alias("needle_id")).withColumn("pattern", pattern(F.col("needle"))))
    long_enough = F.exists(F.split(F.col("needle"), "[%_]"), lambda r: F.length(r) >= GRAM)
    long, short = different.where(long_enough), different.where(~long_enough)
    met = candidates(index, long).join(long.select("needle_id", "pattern"), "needle_id").join(apart(plain), "id")
    found = met.where(F.regexp_like("text", F.col("pattern"))).select("needle_id", "id")
    if not short.isEmpty():
        blocks = ranked(short.withColumn("k", F.lit(0)), ["k"], ["needle_id"], "n").groupBy(F.floor(F.col("n") / 256).alias("block")).agg(F.collect_list(F.struct("needle_id", "pattern")).alias("asked"))
        every = plain.join(blocks.select("asked"))
        held = F.filter("asked", lambda x: F.regexp_like(F.col("text"), x["pattern"]))
        found = found.unionByName(every.select("id", F.explode(F.transform(held, lambda x: x["needle_id"])).alias("needle_id")).select("needle_id", "id"))
    owners = asked.join(different.select("needle", "needle_id"), "needle").select("needle_id", "asks")
    return found.join(owners, "needle_id").select(F.col("asks").alias("needle_id"), "id")
