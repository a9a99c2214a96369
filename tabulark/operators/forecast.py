"""Forecasts over resampled series.

Raw rows are reduced by Spark to one row per (series, bucket) first (W8), so
the fitting only ever sees calendar-sized series, many series at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q, resolve
from ..functions.coerce import number
from ..functions.ordering import join_null_safe
from .windows import as_timestamp, resample, resolve_freq

Z95 = 1.96


def _shift(period: Column, freq: str, h: Column) -> Column:
    if freq == "MS":
        return F.add_months(period, h)
    if freq == "W":
        return F.date_add(period, h * 7)
    return F.date_add(period, h)


def _eligible(df: DataFrame, date: str, value: str, keys: Sequence[str], min_rows: int) -> DataFrame:
    kc = [q(k) for k in keys]
    base = df.select(*kc, as_timestamp(df, date).alias("t"), number(df, value).alias("y")).where(
        F.col("t").isNotNull() & F.col("y").isNotNull()
    )
    return base.groupBy(*kc).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_rows).drop("_rows")


def forecast_linear(
    df: DataFrame, date: str, value: str, periods: int = 12, freq: str = "auto", keys: Sequence[str] = (), min_rows: int = 5, min_buckets: int = 3
) -> DataFrame:
    """OLS trend on bucket index with a 95% band of +-1.96 * population
    std of residuals. Rows ``(keys..., period, value, lower_95, upper_95, kind)``
    where kind is ``historical`` or ``forecast``; values rounded to 2 dp."""
    date, value = resolve(df, date), resolve(df, value)
    keys = [resolve(df, k) for k in keys]
    freq = resolve_freq(df, date, freq)
    out_keys = list(keys)
    if not keys:
        # a single series is keyed by a constant, so every step below is an
        # equi-join on the series key (the per-series side is one row)
        df, keys = df.withColumn("_series", F.lit(0)), ["_series"]
    kc = [q(k) for k in keys]
    series = resample(df, date, value, freq, keys)
    w = Window.partitionBy(*kc).orderBy("period")
    s = series.withColumn("_t", (F.row_number().over(w) - 1).cast("double"))
    fit = s.groupBy(*kc).agg(
        F.count(F.lit(1)).alias("_n"),
        F.regr_slope("value", "_t").alias("_b"),
        F.regr_intercept("value", "_t").alias("_a"),
        F.max("period").alias("_last"),
    ).where(F.col("_n") >= min_buckets)
    fit = join_null_safe(fit, _eligible(df, date, value, keys, min_rows), keys)
    sj = join_null_safe(s, fit, keys)
    resid = sj.groupBy(*kc).agg(F.stddev_pop(F.col("value") - (F.col("_a") + F.col("_b") * F.col("_t"))).alias("_sd"))
    fit = join_null_safe(fit, resid, keys)
    hist = sj.select(
        *kc, "period", F.round("value", 2).alias("value"), F.lit(None).cast("double").alias("lower_95"),
        F.lit(None).cast("double").alias("upper_95"), F.lit("historical").alias("kind"),
    )
    fut = fit.select(*kc, "_n", "_a", "_b", "_sd", "_last", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("_h"))
    yhat = F.col("_a") + F.col("_b") * (F.col("_n") - 1 + F.col("_h"))
    fc = fut.select(
        *kc,
        _shift(F.col("_last"), freq, F.col("_h")).alias("period"),
        F.round(yhat, 2).alias("value"),
        F.round(yhat - Z95 * F.col("_sd"), 2).alias("lower_95"),
        F.round(yhat + Z95 * F.col("_sd"), 2).alias("upper_95"),
        F.lit("forecast").alias("kind"),
    )
    out = hist.unionByName(fc)
    return out if out_keys else out.drop("_series")


def forecast_metrics(fc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Growth of the last forecast over the last historical value (1 dp);
    upward > 2%, downward < -2%, else flat. One row per series."""
    kc = [q(k) for k in keys]
    s = fc.groupBy(*kc).agg(
        F.max_by(F.when(F.col("kind") == "historical", F.col("value")), F.when(F.col("kind") == "historical", F.col("period"))).alias("last_historical_value"),
        F.max_by(F.when(F.col("kind") == "forecast", F.col("value")), F.when(F.col("kind") == "forecast", F.col("period"))).alias("projected_final_value"),
    )
    g = F.round(
        (F.col("projected_final_value") - F.col("last_historical_value"))
        / F.greatest(F.lit(1e-5), F.abs("last_historical_value")) * 100,
        1,
    )
    return s.select(
        *kc, "last_historical_value", "projected_final_value", g.alias("growth_rate_pct"),
        F.when(g > 2.0, "upward").when(g < -2.0, "downward").otherwise("flat").alias("trend_direction"),
    )


# ---- M13: additive-trend exponential smoothing -------------------------------

#: pairs of weights at which the search begins; the best few are refined
_GRID = np.linspace(0.05, 0.95, 19)
_STARTS = 8


def _holt_run(y: np.ndarray, a: np.ndarray, b: np.ndarray):
    """One recursion for arrays of weights (alpha, beta): last level, last
    trend, squared error of the one-step forecasts, its gradient (2, pairs)
    and the products of the forecasts' derivatives (2, 2, pairs)."""
    level, trend = np.full(a.shape, y[0]), np.full(a.shape, y[1] - y[0])
    d_level, d_trend = np.zeros((2, *a.shape)), np.zeros((2, *a.shape))
    sse, grad, square = np.zeros(a.shape), np.zeros((2, *a.shape)), np.zeros((2, 2, *a.shape))
    for x in y[1:]:
        forecast, slope = level + trend, d_level + d_trend
        e = x - forecast
        sse += e * e
        grad -= 2 * e * slope
        square += slope[:, None] * slope[None, :]
        # the derivative of the error is -slope
        level, d_level = forecast + a * e, slope * (1 - a)
        d_level[0] += e
        trend, d_trend = trend + a * b * e, d_trend - a * b * slope
        d_trend[0] += b * e
        d_trend[1] += a * e
    return level, trend, sse, grad, square


def _holt_fit(y: np.ndarray, steps: int = 60):
    """Weights in [0, 1] with the least squared error of one-step forecasts:
    the best pairs of a grid, refined at once by damped Gauss-Newton steps
    that are kept only where the error falls, so it is never above the
    grid's. Returns (alpha, beta, last level, last trend, squared error)."""
    a, b = (x.ravel() for x in np.meshgrid(_GRID, _GRID, indexing="ij"))
    best = np.argsort(_holt_run(y, a, b)[2], kind="stable")[:_STARTS]
    w = np.stack([a[best], b[best]])
    level, trend, sse, grad, square = _holt_run(y, *w)
    damp = np.full(_STARTS, 1e-3)
    for _ in range(steps):
        # a weight at its bound whose error falls only beyond it stays there
        free = ~(((w <= 0) & (grad > 0)) | ((w >= 1) & (grad < 0)))
        h = square * free[:, None] * free[None, :]
        g = np.where(free, grad, 0) / 2
        diag = np.stack([h[0, 0], h[1, 1]]) * (1 + damp) + ~free
        det = diag[0] * diag[1] - h[0, 1] ** 2
        det = np.where(det > 0, det, np.inf)
        move = np.stack([h[0, 1] * g[1] - diag[1] * g[0], h[0, 1] * g[0] - diag[0] * g[1]]) / det
        to = np.clip(w + move, 0, 1)
        if np.abs(to - w).max() < 1e-10:
            break
        new = _holt_run(y, *to)
        better = new[2] < sse
        w = np.where(better, to, w)
        level, trend, sse, grad, square = (np.where(better, n, o) for n, o in zip(new, (level, trend, sse, grad, square), strict=True))
        damp = np.where(better, np.maximum(damp / 5, 1e-9), np.minimum(damp * 4, 1e12))
    k = int(np.argmin(sse))
    return w[0, k], w[1, k], level[k], trend[k], sse[k]


def _holt_fitted(y: np.ndarray, a: float, b: float) -> np.ndarray:
    """One-step forecasts; the first value stands for itself."""
    level, trend, fitted = y[0], y[1] - y[0], y.copy()
    for i in range(1, len(y)):
        fitted[i] = level + trend
        e = y[i] - fitted[i]
        level, trend = fitted[i] + a * e, trend + a * b * e
    return fitted


def forecast_holt(
    df: DataFrame, date: str, value: str, periods: int = 12, freq: str = "auto", keys: Sequence[str] = (), min_buckets: int = 3
) -> DataFrame:
    """Holt's additive-trend smoothing per series via ``applyInPandas``
    on the bucketed series (one group = one calendar-sized series). Same
    output shape as M12. The two smoothing weights have the least squared
    error of one-step forecasts; the first two values set level and trend."""
    date, value = resolve(df, date), resolve(df, value)
    keys = [resolve(df, k) for k in keys]
    freq = resolve_freq(df, date, freq)
    series = resample(df, date, value, freq, keys)
    key_fields = [df.schema[k] for k in keys]
    out_schema = T.StructType(
        [*key_fields, T.StructField("period", T.DateType()), T.StructField("value", T.DoubleType()),
         T.StructField("lower_95", T.DoubleType()), T.StructField("upper_95", T.DoubleType()), T.StructField("kind", T.StringType())]
    )
    offset = {"MS": pd.DateOffset(months=1), "W": pd.DateOffset(weeks=1), "D": pd.DateOffset(days=1)}[freq]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        y = pdf["value"].to_numpy(dtype=float)
        if len(y) < min_buckets:
            return pd.DataFrame(columns=[f.name for f in out_schema.fields])
        a, b, level, tr, _ = _holt_fit(y)
        sd = float(np.std(y - _holt_fitted(y, a, b)))
        last = pd.Timestamp(pdf["period"].iloc[-1])
        fut = [(last + offset * h).date() for h in range(1, periods + 1)]
        yh = np.array([level + h * tr for h in range(1, periods + 1)])
        hist = pd.DataFrame({"period": pdf["period"].to_list(), "value": np.round(y, 2), "lower_95": np.nan, "upper_95": np.nan, "kind": "historical"})
        fc = pd.DataFrame({"period": fut, "value": np.round(yh, 2), "lower_95": np.round(yh - Z95 * sd, 2), "upper_95": np.round(yh + Z95 * sd, 2), "kind": "forecast"})
        res = pd.concat([hist, fc], ignore_index=True)
        for k in keys:
            res.insert(0, k, pdf[k].iloc[0])
        return res[[f.name for f in out_schema.fields]]

    if keys:
        return series.groupBy(*[q(k) for k in keys]).applyInPandas(fit, schema=out_schema)
    return series.withColumn("_series", F.lit(0)).groupBy("_series").applyInPandas(fit, schema=out_schema)
