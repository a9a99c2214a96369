"""Tables derived by rule from the driver's tables (dirty inputs for the
quality and cleaning analyses)."""

from __future__ import annotations

from pyspark.sql import functions as F


def load(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_events(spark, sf):
    """Events with missing values made by rule from the table itself."""
    ev = load(spark, sf, "events")
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.when(F.col("event_type") == "error", F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("string")).otherwise(F.col("props")).alias("props"),
    )
