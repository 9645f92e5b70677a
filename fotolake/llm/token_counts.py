"""Token counts of whole texts by rank-synchronous array merging (see merging.py), without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import CachedWordCounts

#: Tokens above which a document is over the limit, and texts whose new words are merged together.
LIMIT = 2048
TEXTS = 512


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    docs has doc_id and text; other columns are ignored. Null counts as empty: no bytes, no tokens. Nothing is cut off,
    repeated rows are counted each, and an empty table gives no rows.
    """

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = CachedWordCounts(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                n = pa.array(counter.counts(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
        F.octet_length(text_of()).cast("long").alias("n_bytes"),
    )
    counted = rows.mapInArrow(task, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
