"""Working tables: intermediate results that later rounds read again lie in the folder that all executors share, until the
session ends."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session on one machine without that setting gets a local folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _local_folders:
        _local_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-fotolake-")
    return _local_folders[app]


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written there goes when the driver's JVM ends, as results may be read until then;
    a driver that is killed leaves it."""
    path = f"{shared_folder(spark)}/fotolake-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    # A file system marks only what exists.
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def settled(frame: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it back; what lies at path already gives way to it."""
    spark = frame.sparkSession
    path = path or fresh_path(spark)
    with tidy(spark):
        frame.write.option("compression", "zstd").mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def apart(frame: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: rows of both sides meet by a shuffle and a sort, never by a broadcast.

    Spark reckons a file's rows by its compressed bytes and takes exploded rows for no more than those they come from, so it
    would send tables of any size through the driver.
    """
    return frame.hint("merge")
