"""Relationships between columns.

All pairs come from one pass that keeps a co-moment matrix per partition (see
``functions.comoments``), never from a loop over column pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, resolve
from ..functions.comoments import pair_moments
from ..functions.ordering import long_values
from ..functions.stats import cv_expr, kurt_expr, skew_expr


def _pairs(cols: Sequence[str], diagonal: bool = False):
    for i, a in enumerate(cols):
        for b in cols[i if diagonal else i + 1:]:
            yield a, b


def _corr(digits: int):
    """r of a pair's co-moments; null where a side is constant."""
    return F.round(F.when(F.col("n") >= 2, F.try_divide("c", F.nullif(F.sqrt("m2_left") * F.sqrt("m2_right"), F.lit(0.0)))), digits).alias("corr")


def correlation(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Pearson r for every column pair (pairwise-complete), long form
    ``(left, right, corr, n)``; null where a side is constant."""
    cols = list(cols) if cols else numeric_columns(df)
    pairs = list(_pairs(cols))
    if not pairs:
        raise ValueError("need at least two numeric columns")
    return pair_moments(df, cols, cols, pairs).select("left", "right", _corr(digits), "n")


def top_correlations(df: DataFrame, k: int = 3, min_abs: float = 0.0, cols: Sequence[str] | None = None) -> DataFrame:
    """A10: strongest pairs by |r| (High >= 0.6, Moderate >= 0.3), names break ties."""
    c = correlation(df, cols).where(F.col("corr").isNotNull() & (F.abs("corr") >= min_abs))
    top = c.orderBy(F.abs("corr").desc(), "left", "right").limit(k)
    return top.select(
        "left",
        "right",
        "corr",
        "n",
        F.when(F.abs("corr") >= 0.6, "High").when(F.abs("corr") >= 0.3, "Moderate").otherwise("Weak").alias("strength"),
    )


def correlate_with(df: DataFrame, target: str, cols: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """R of every numeric feature with ``target`` ``(feature, corr, n)``."""
    target = resolve(df, target)
    feats = [c for c in (cols or numeric_columns(df)) if c != target]
    found = pair_moments(df, feats, [target], [(f, target) for f in feats])
    return found.select(F.col("left").alias("feature"), _corr(digits), "n")


def covariance(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Sample covariance for every pair including the diagonal (variance);
    null for fewer than two complete rows."""
    cols = list(cols) if cols else numeric_columns(df)
    found = pair_moments(df, cols, cols, list(_pairs(cols, diagonal=True)))
    cov = F.when(F.col("n") >= 2, F.try_divide("c", F.col("n") - 1))
    return found.select("left", "right", F.round(cov, digits).alias("cov"))


def moments(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, coefficient of variation."""
    cols = list(cols) if cols else numeric_columns(df)
    long = long_values(df, cols)
    return long.groupBy("column").agg(
        F.count("v").alias("n"),
        F.round(skew_expr(F.col("v")), digits).alias("skewness"),
        F.round(kurt_expr(F.col("v")), digits).alias("kurtosis"),
        F.round(cv_expr(F.col("v")), digits).alias("cv"),
    )
