"""Aggregate expressions with the reference's (pandas) statistical conventions.

All are plain Spark aggregate expressions, so they run as partial/final
aggregates inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew_expr(c: Column) -> Column:
    """Bias-corrected skewness G1 (pandas / DuckDB); null for n<3 or constant."""
    x = c.cast("double")
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * g1)


def kurt_expr(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas / DuckDB); null for n<4 or constant."""
    x = c.cast("double")
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def cv_expr(c: Column) -> Column:
    """Coefficient of variation: sample std / |mean|; null when mean is 0."""
    x = c.cast("double")
    m = F.avg(x)
    return F.try_divide(F.stddev_samp(x), F.when(F.abs(m) > 0, F.abs(m)))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null (ANSI-safe)."""
    return F.try_divide(a, F.when(b != 0, b))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + t * d, 1.0 + t / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function for 0 <= x <= 1."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    # the fraction converges fast on this side; the other one mirrors it
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def p_value_t(t: float, df: float) -> float:
    """Two-sided probability of a t statistic."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def p_value_f(f: float, df1: float, df2: float) -> float:
    """Upper probability of an F statistic."""
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))
