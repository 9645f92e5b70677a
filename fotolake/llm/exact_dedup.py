"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies are combined three times, always by digest AND full normalised text, so a digest collision never merges two texts:
in the map tasks (the partial aggregate), in salted groups (SALTS of them, by a hash of the doc_id) and globally over one
winner per salt. No list of members is ever built: rows find their group's winner again by digest and salt, so a group of
copies is spread over SALTS tasks in every shuffle. Should a digest stand for two texts, its rows are joined by full text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, settled, text_of

#: Parts over which the rows of one group are spread.
SALTS = 64


def with_digest(docs: DataFrame) -> DataFrame:
    """Adds body (text with each run of white space as one space) and text_sha256 to doc_id."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_replace(text_of(), SPACE_RUN, " ").alias("body"),
    ).withColumn("text_sha256", F.sha2("body", 256))


def _salt(doc_id: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int")


def groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """text_sha256, body, keep_id, group_size, salts (those that the group's rows have): one row per group of equal texts."""
    parts = with_digest(docs).groupBy("text_sha256", "body", _salt("doc_id", salts).alias("salt")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return parts.groupBy("text_sha256", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    docs has doc_id and text; other columns are ignored, whatever their names. Null and empty text form one group.
    The smallest doc_id of a group stays; when its row is repeated, one of the repeats stays. A row without doc_id is
    never preferred: keep_id is null only when the whole group has none. Rows without doc_id share a salt. An empty table
    gives no rows.
    """
    found = groups(docs, salts)
    slim = settled(found.drop("body"))
    rows = with_digest(docs).withColumn("salt", _salt("doc_id", salts))
    keys = ["text_sha256", "salt"]
    if slim.groupBy("text_sha256").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows, winners = rows.drop("body"), slim
    else:
        winners, keys = found, [*keys, "body"]
    joined = rows.join(winners.withColumn("salt", F.explode("salts")).drop("salts"), keys)
    again = F.row_number().over(Window.partitionBy(*keys, "doc_id").orderBy("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (again == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; repeats of a kept row go too.

    What goes is left out by doc_id and digest, so texts move once at most.
    """
    judged = settled(exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.some("kept").alias("kept"), F.count("*").alias("times")))
    own = F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), SPACE_RUN, " "), 256)

    def of(pairs: DataFrame, how: str) -> DataFrame:
        side = pairs.select(F.col("doc_id").alias("pair_id"), F.col("text_sha256").alias("pair_sha"))
        return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["pair_id"]) & (own == side["pair_sha"]), how)

    repeated = judged.where("kept and times > 1")
    if repeated.isEmpty():
        return of(judged.where("not kept"), "left_anti")
    one = of(repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    # Repeats whose texts differ in white space only.
    place = F.row_number().over(Window.partitionBy("doc_id", F.sha2(F.regexp_replace(text_of(), SPACE_RUN, " "), 256)).orderBy("text"))
    one = one.select(F.struct("*").alias("row"), place.alias("place")).where("place = 1").select("row.*")
    return of(judged.where("not kept or times > 1"), "left_anti").unionByName(one)
