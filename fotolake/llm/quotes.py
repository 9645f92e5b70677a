"""Quotation linking: messages of a conversation are linked to the earlier ones that they quote, in DataFrame operations.

A line's quote level is the number of '>' at its start. Neighbouring lines of one level form a passage. The normalised
passage (lower case, single spaces, no quote signs) is hashed and looked up among the passages that earlier messages of
the conversation wrote themselves: their whole text, their paragraphs and their lines. The latest earlier message that
has it is the original; a passage found nowhere is tried line by line. Lookups are as-of windows over the turns, cut into
blocks of BLOCK turns with what the blocks before hold carried over, so neither a long conversation nor a passage that
everyone quotes is one task, and no pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.operators.windows import numbered

from .common import settled, text_of

#: Turns of a block.
BLOCK = 512
QUOTE = r"^[ \t]{0,3}((?:>[ \t]?)+)"
#: Lines that announce a quotation; they go with it when a quoted line follows.
ANNOUNCES = r"(?i)^\s*(on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and part: rows of one conv_id and turn are told apart by part."""
    one = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text_of().alias("text")
    )
    return one.withColumn("part", F.xxhash64("role", "text"))


def _lines(found: DataFrame) -> DataFrame:
    """One row per line: level, and body without quote signs."""
    lines = found.select("conv_id", "turn", "part", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    sign = F.regexp_extract("raw", QUOTE, 1)
    return lines.withColumn("level", F.length(F.regexp_replace(sign, "[^>]", ""))).withColumn(
        "body", F.when(F.col("level") > 0, F.regexp_replace("raw", QUOTE, "")).otherwise(F.col("raw"))
    )


def passages(lines: DataFrame) -> DataFrame:
    """conv_id, turn, part, first (line), level, bodies: neighbouring lines of one level, per message."""
    order = Window.partitionBy("conv_id", "turn", "part").orderBy("line")
    new = F.coalesce((F.lag("level").over(order) != F.col("level")).cast("int"), F.lit(1))
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("conv_id", "turn", "part", "run", "level").agg(
        F.min("line").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]).alias("bodies")
    )


def latest_before(asked: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """asked with origin: the largest turn below its own in have (keys, turn), or null. Ties have no part in it."""
    block = F.floor(F.col("turn") / BLOCK)
    offers = have.select(*keys, "turn").distinct().withColumn("block", block)
    ends = offers.groupBy(*keys, "block").agg(F.max("turn").alias("end"))
    marks = asked.select(*keys, "turn").distinct().withColumn("block", block)
    blocks = ends.select(*keys, "block", "end").unionByName(marks.select(*keys, "block").withColumn("end", F.lit(None).cast("long")))
    blocks = blocks.groupBy(*keys, "block").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "block", F.max("end").over(earlier).alias("carried"))
    both = offers.withColumn("offer", F.col("turn")).unionByName(marks.withColumn("offer", F.lit(None).cast("long")))
    both = both.groupBy(*keys, "block", "turn").agg(F.max("offer").alias("offer"))
    near = Window.partitionBy(*keys, "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.max("offer").over(near)).join(carried, [*keys, "block"])
    found = found.select(*keys, "turn", F.coalesce("near", "carried").alias("origin")).where("origin is not null")
    return asked.join(found, [*keys, "turn"], "left")


def link_quotes(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, n_quoted, n_linked, deepest, reply_to, branch, position, text.

    text is the message without its quotations. reply_to is the turn that its first linked passage of the lowest level
    quotes, else the turn before in the conversation. A message that does not reply to the turn before opens a branch,
    named by its turn; others stay in the branch of the turn before; branch 0, or the least turn if that is negative, opens
    a conversation. Quoted lines without anything behind the signs are no passage. position numbers the
    messages of a conversation from 0, branch by branch and by turn within, so a reply never comes before what it
    answers. conversations has conv_id, turn, role and text; other columns are ignored. Null text counts as empty, equal
    rows are one message, different ones of one turn share their reply_to and branch rules and follow each other by
    role and text. Rows without conv_id or turn come back without links. An empty table gives no rows.
    """
    every = messages(conversations).distinct()
    placed = every.where("conv_id is not null and turn is not null")
    quoting = placed.where(F.col("text").rlike("(?m)" + QUOTE))
    lines = _lines(quoting)
    parts = settled(passages(lines))
    following = F.lead("level").over(Window.partitionBy("conv_id", "turn", "part").orderBy("line"))
    announced = (F.col("level") == 0) & F.col("body").rlike(ANNOUNCES) & (F.coalesce(following, F.lit(0)) > 0)
    own_lines = lines.withColumn("out", announced).where("level = 0 and not out")
    own = own_lines.groupBy("conv_id", "turn", "part").agg(
        F.trim(F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n"), r"\n{3,}", "\n\n")).alias("own")
    )
    # What messages wrote themselves: without quotes that is the text; it matters only where its conversation quotes.
    asks = settled(_asked(parts))
    where = quoting.select("conv_id").distinct()
    written = (
        placed.join(where, "conv_id", "left_semi")
        .join(own, ["conv_id", "turn", "part"], "left")
        .withColumn("own", F.when(F.col("text").rlike("(?m)" + QUOTE), F.coalesce("own", F.lit(""))).otherwise(F.col("text")))
    )
    offers = written.select(
        "conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n")))).alias("passage")
    ).select("conv_id", "turn", normalised(F.col("passage")).alias("passage")).where("passage <> ''").select("conv_id", "turn", F.xxhash64("passage").alias("hash"), F.sha1("passage").alias("digest"))
    found = latest_before(asks, offers, ["conv_id", "hash", "digest"])
    # The passage as a whole decides; where it has no original, the latest one of its lines does.
    by_passage = found.groupBy("conv_id", "turn", "part", "run").agg(
        F.min("level").alias("level"), F.min("first").alias("first"), F.max(F.when(F.col("whole"), F.col("origin"))).alias("whole"), F.max("origin").alias("some")
    ).withColumn("origin", F.coalesce("whole", "some"))
    linked = by_passage.groupBy("conv_id", "turn", "part").agg(
        F.count("*").alias("n_quoted"),
        F.count("origin").alias("n_linked"),
        F.max("level").alias("deepest"),
        F.min(F.when(F.col("origin").isNotNull(), F.struct("level", "first", "origin")))["origin"].alias("quoted_turn"),
    )
    full = (
        placed.join(linked, ["conv_id", "turn", "part"], "left")
        .join(own, ["conv_id", "turn", "part"], "left")
        .select(
            "conv_id", "turn", "part", "role",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_quoted", "n_linked", "deepest")],
            "quoted_turn",
            F.when(F.col("text").rlike("(?m)" + QUOTE), F.coalesce("own", F.lit(""))).otherwise(F.col("text")).alias("text"),
        )
    )
    ordered = _ordered(settled(full))
    lost = every.where("conv_id is null or turn is null").select(
        "conv_id", "turn", "role", *[F.lit(0).cast("long").alias(c) for c in ("n_quoted", "n_linked", "deepest")],
        *[F.lit(None).cast("long").alias(c) for c in ("reply_to", "branch", "position")], "text",
    )
    return ordered.unionByName(lost)


def _asked(parts: DataFrame) -> DataFrame:
    """Hashes of quoted passages, whole and by line; what holds nothing but quote signs asks for nothing."""
    quoted = parts.where("level > 0").select(
        "conv_id", "turn", "part", "run", "level", "first",
        F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.array_join("bodies", "\n").alias("s"))), F.transform("bodies", lambda b: F.struct(F.lit(False).alias("whole"), b.alias("s"))))).alias("x"),
    )
    text = normalised(F.col("x.s"))
    return quoted.select("conv_id", "turn", "part", "run", "level", "first", F.col("x.whole").alias("whole"), F.xxhash64(text).alias("hash"), F.sha1(text).alias("digest"), F.length(text).alias("size")).where("size > 0").drop("size")


def _ordered(full: DataFrame) -> DataFrame:
    """Adds reply_to, branch and position."""
    turns = full.groupBy("conv_id", "turn").agg(F.max("quoted_turn").alias("quoted"))
    turns = latest_before(turns, turns, ["conv_id"]).withColumnRenamed("origin", "before")
    turns = turns.withColumn("reply_to", F.coalesce("quoted", "before"))
    turns = settled(turns.withColumn("opens", F.col("before").isNotNull() & (F.col("reply_to") != F.col("before"))))
    opened = turns.where("opens").select("conv_id", "turn")
    inside = latest_before(turns.select("conv_id", "turn", "reply_to", "opens"), opened, ["conv_id"])
    # Where turns are negative, the branch that opens a conversation is its least one.
    least = turns.where("turn < 0").groupBy("conv_id").agg(F.min("turn").alias("least"))
    inside = inside.join(least, "conv_id", "left")
    branches = inside.select("conv_id", "turn", "reply_to", F.when(F.col("opens"), F.col("turn")).otherwise(F.coalesce("origin", "least", F.lit(0))).alias("branch"))
    # All messages are numbered in one order over ranges of it, so a conversation may be longer than any task.
    rows = settled(numbered(full.join(branches, ["conv_id", "turn"]), ["conv_id", "branch", "turn", "role", "text", "part"], "number"))
    first = rows.groupBy("conv_id").agg(F.min("number").alias("first"))
    return rows.join(first, "conv_id").select(
        "conv_id", "turn", "role", "n_quoted", "n_linked", "deepest", "reply_to", "branch", (F.col("number") - F.col("first")).cast("long").alias("position"), "text"
    )
