"""What the corpus operators share: the meaning of white space, table access and the shared working folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.storage import fresh_path, settled, shared_folder, tidy

__all__ = ["SPACE_RUN", "WORD", "fresh_path", "frugal", "settled", "shared_folder", "table", "text_of", "tidy", "tokenizer"]

#: White space is space, tab, LF, VT, FF and CR; everything else belongs to a word.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def frugal(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """task, and what it has freed goes back to the system as it ends: the worker, which is kept for later tasks, waits with
    little memory."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        handed_back()

    return run


def handed_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)
