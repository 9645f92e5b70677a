"""All registered queries of the catalog engine, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = ("search", "reports", "groups", "flows", "imports")


def queries() -> dict[str, Query]:
    return {k: v for f in FAMILIES for k, v in import_module(f"fotolake.plans.{f}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for f in FAMILIES for k, v in import_module(f"fotolake.plans.{f}").SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_night"](spark, sf_dir)
