"""The registered queries of the corpus operators, over whole tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_repair as _repair
from . import exact_dedup as _exact
from . import licences as _licences
from . import lm_score as _lm
from . import mixing as _mixing
from . import ngram_join as _ngram
from . import packing as _packing
from . import quality as _quality
from . import quotes as _quotes
from . import spelling as _spelling
from . import suffix_dedup as _suffix
from . import token_counts as _counts
from . import toxicity as _toxicity
from .common import table, tokenizer
from .licences_sql import OP13_SQL
from .repair_sql import OP11_SQL
from .spelling_sql import OP12_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.packing_report(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = min(doc_id) over g as kept, text_sha256
from t window g as (partition by text_sha256)
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix_report(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
with sizes as (
  select doc_id, coalesce(source, chr(0)) as source, source is null as lost,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
src as (select source, lost, sum(size)::bigint as source_size from sizes group by all),
weighed as (
  select *, [1, 2, 3][((row_number() over (order by lost, source) - 1) % 3 + 1)::int]::bigint as weight from src),
levels as (
  select source, lost, source_size, weight, 3 * source_size as cap,
    (sum(source_size) over () - 3 * coalesce(sum(source_size) over b, 0))::bigint as rest,
    (sum(weight) over () - coalesce(sum(weight) over b, 0))::bigint as heavy
  from weighed
  window b as (order by source_size * 3 / weight, lost, source rows between unbounded preceding and 1 preceding)),
level as (
  select rest, heavy from levels where rest * weight <= cap * heavy order by cap / weight, lost, source limit 1),
targets as (
  select l.source, l.lost, source_size,
    case when l.rest * weight > cap * l.heavy then cap::double else (weight * v.rest) / v.heavy end as target
  from levels l cross join level v),
quotas as (select *, least(round(target)::bigint, 3 * source_size) as quota from targets),
laid as (
  select doc_id, size, source_size, target, quota,
    (sum(size) over (partition by source, lost order by md5('mix:' || doc_id), doc_id, size
      rows between unbounded preceding and current row) - size)::bigint as start
  from sizes join quotas using (source, lost))
select doc_id, size, source_size, target,
  case when size = 0 then 0 else
    size * (quota // source_size) + greatest(0, least(size, quota % source_size - start)) end::bigint as taken
from laid
"""

def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.quality(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffix.repeats_report(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with raw as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (
  select doc_id, p, substr(h, 2 * p + 1, 100) as w
  from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as p from raw)),
least as (select w, min(doc_id) as least from windows group by w),
gone as (select distinct doc_id, p from windows join least using (w) where least < doc_id),
bytes as (select doc_id, substr(h, 2 * p + 1, 2) as byte, p from (select doc_id, h, unnest(range(0, len(h) // 2)) as p from raw)),
judged as (
  select b.doc_id, b.p, byte, last_value(g.p ignore nulls) over (partition by b.doc_id order by b.p) >= b.p - 49 as out
  from bytes b left join gone g on g.doc_id = b.doc_id and g.p = b.p),
runs as (
  select doc_id, p, byte, coalesce(out, false) as out,
    coalesce(out, false) and not coalesce(lag(out) over (partition by doc_id order by p), false) as starts
  from judged)
select r.doc_id, len(h)::bigint // 2 as n_bytes, count(*) filter (out) as n_removed, count(*) filter (starts) as n_spans,
  sha256(unhex(coalesce(string_agg(byte, '' order by p) filter (not out), ''))) as kept_sha256
from raw r left join runs using (doc_id) group by r.doc_id, h
"""


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes.link_quotes(table(spark, sf_dir, "conversations"))


def quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking over conversations in which two of three messages quote the one before the last."""
    told = table(spark, sf_dir, "conversations")
    before = told.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("quoted"))
    quoting = F.concat(F.lit("> "), F.regexp_replace("quoted", "\n", "\n> "), F.lit("\n\n"), F.col("text"))
    text = F.when(F.col("quoted").isNotNull() & (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) > 0), quoting).otherwise(F.col("text"))
    return _quotes.link_quotes(told.join(before, ["conv_id", "turn"], "left").withColumn("text", text).drop("quoted"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm.lm_scores(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram.jaccard_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from words),
items as (select doc_id, unnest(s) as x from sets),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (
  select a, b from shared join sets p on p.doc_id = a join sets q on q.doc_id = b
  where 100 * n >= 90 * (len(p.s) + len(q.s) - n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as node, doc_id as root from sets
  union select b, root from reach join both_ways on node = a)
select doc_id, len(s)::bigint as n_shingles, root as component_id
from sets join (select node, min(root) as root from reach group by node) on node = doc_id
"""


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations")
    return _repair.repair_report(_repair.damaged(told), told)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelling.spelling_report(table(spark, sf_dir, "documents"))


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licences.licence_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op13_licences": op13_licences,
    "op12_spelling": op12_spelling,
    "op11_chat_repair": op11_chat_repair,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op2_quote_links": op2_quote_links,
    "quoted_threads": quoted_threads,
    "op9_lm_score": op9_lm_score,
    "op10_ngram_join": op10_ngram_join,
    "op1_packing": op1_packing,
    "op4_token_counts": op4_token_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op5_mixing": op5_mixing,
}
SQL: dict[str, str] = {
    "op13_licences": OP13_SQL,
    "op12_spelling": OP12_SQL,
    "op11_chat_repair": OP11_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op10_ngram_join": OP10_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op5_mixing": OP5_SQL,
}
