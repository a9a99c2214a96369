"""Registered analyses over the driver's tables, each with a DuckDB oracle.

Every entry reads whole tables from ``sf_dir`` (or data Spark derives from
them). Computed columns are aliased identically on both sides and money sums
are rounded so order-dependent last bits of double addition do not matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn

    return deco


# import the query modules so their registrations run
from . import queries_core, queries_more, queries_rows, queries_stats  # noqa: E402,F401
