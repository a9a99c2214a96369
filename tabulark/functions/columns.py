"""Column naming, resolution and type classes.

Names may contain dots and spaces (``user.name``), so every reference is
backtick-quoted; ``F.col("a.b")`` would mean struct access."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def q(name: str) -> Column:
    """Column by literal name (dots/spaces safe)."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dt: T.DataType) -> bool:
    """Numeric, booleans excluded (the reference excludes them from numeric stats)."""
    return isinstance(dt, NUMERIC_TYPES)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, TEMPORAL_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType)]


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns that can be rendered as a string cell (no arrays/maps/structs)."""
    return [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    ]


def _squash(name: str) -> str:
    return re.sub(r"[\s_]+", "", name.lower())


def resolve(df: DataFrame, name: str) -> str:
    """Exact, then case-insensitive, then ignoring spaces/underscores."""
    cols = df.columns
    if name in cols:
        return name
    low = [c for c in cols if c.lower() == name.lower()]
    if low:
        return low[0]
    sq = [c for c in cols if _squash(c) == _squash(name)]
    if sq:
        return sq[0]
    raise KeyError(f"unknown column {name!r}; have {cols}")


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN, a value in Spark, as null: missing."""
    c = q(name)
    return F.when(~F.isnan(c), c) if isinstance(dtype_of(df, name), (T.FloatType, T.DoubleType)) else c


def present(df: DataFrame, name: str) -> Column:
    """Whether the column holds a value: neither null nor NaN."""
    c = q(name)
    floating = isinstance(dtype_of(df, name), (T.FloatType, T.DoubleType))
    return c.isNotNull() & ~F.isnan(c) if floating else c.isNotNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN made null in every floating column."""
    return df.select(*[value(df, c).alias(c) for c in df.columns])
