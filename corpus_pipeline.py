"""A training corpus from raw documents in five stages: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and what the stage before it kept; all but the last return the columns of documents.
A row's decision holds for the whole row: rejected and copied documents go, the mixture repeats or drops documents, and
packing cuts what is left into sequences.

All stages take an empty table to an empty one, keep columns of any other name and their values as they are, count null texts as
empty, and treat null doc_id, lang and source as values; what each does with nulls, repeats and long texts stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fotolake.llm import exact_dedup, mixing, ngram_join, packing, quality
from fotolake.llm.common import settled, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's perplexity band reject go; so do null and empty texts, which have too
    few words. Each row is judged by its own text, with or without a doc_id; repeated rows stay or go together. Whole texts
    count, however long."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after white space is normalised, the one with the smallest doc_id stays; of repeated rows one
    stays. A text that only rows without doc_id have loses all of them but one."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest doc_id stays. Null and
    empty texts are linked with nothing and stay, as rows without doc_id do; rows of one doc_id are one document."""
    return ngram_join.keep_first(docs, k=5, num=4, den=5)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought near their target weights: documents come as often as the mix takes them, whole. A null source is one
    of its own; texts without words are never taken."""
    return mixing.take_mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a long text is cut, an empty one is its end sign alone."""
    return packing.packing_report(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("mixing", source_mixture),
    ("packing", packed_sequences),
]

#: The perplexity model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the documents are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settled(docs)
    return docs
