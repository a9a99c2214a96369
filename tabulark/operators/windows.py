"""Trends, ordered analytics and resampling.

Windows run over *grouped* frames (one row per period or category), never
over raw rows. Per-period windows are bounded by the calendar, not the data;
per-category running sums use the range-partition plan in
``functions.ordering`` so a million categories never meet in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_temporal, q, resolve
from ..functions.coerce import number, to_timestamp_mixed
from ..functions.ordering import quantile_wide, with_running_sum
from ..functions.stats import safe_div
from .aggregate import period_col


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Temporal column as timestamp; text parsed with the F7 layouts."""
    if is_temporal(df.schema[name].dataType):
        return q(name).cast("timestamp_ntz")
    return to_timestamp_mixed(q(name)).cast("timestamp_ntz")


def trend(df: DataFrame, date: str, metric: str, digits: int = 2) -> DataFrame:
    """Total per distinct date; first vs latest total, delta, % change
    (0 when the first total is 0), direction. One row; none if < 2 rows."""
    date, metric = resolve(df, date), resolve(df, metric)
    base = df.select(as_timestamp(df, date).alias("t"), number(df, metric).alias("m")).where(
        F.col("t").isNotNull() & F.col("m").isNotNull()
    )
    g = base.groupBy("t").agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("rows"))
    s = g.agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("periods"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.min_by("total", "t").alias("first_value"),
        F.max_by("total", "t").alias("latest_value"),
    )
    delta = F.col("latest_value") - F.col("first_value")
    pct = F.when(F.col("first_value") != 0, delta / F.abs(F.col("first_value")) * 100).otherwise(F.lit(0.0))
    return s.where(F.col("rows") >= 2).select(
        F.lit(date).alias("time_column"),
        F.lit(metric).alias("metric"),
        F.date_format("first_t", "yyyy-MM-dd").alias("first_period"),
        F.date_format("last_t", "yyyy-MM-dd").alias("latest_period"),
        F.round("first_value", digits).alias("first_value"),
        F.round("latest_value", digits).alias("latest_value"),
        F.round(delta, digits).alias("delta"),
        F.round(pct, digits).alias("pct_change"),
        F.when(delta >= 0, "increased").otherwise("declined").alias("direction"),
        "periods",
    )


def _period_frame(df: DataFrame, date: str, metric: str, grain: str, keys: Sequence[str]) -> DataFrame:
    date, metric = resolve(df, date), resolve(df, metric)
    keys = [resolve(df, k) for k in keys]
    base = df.select(*[q(k) for k in keys], period_col(as_timestamp(df, date), grain).alias("period"), number(df, metric).alias("m"))
    base = base.where(F.col("period").isNotNull() & F.col("m").isNotNull())
    return base.groupBy(*[q(k) for k in keys], "period").agg(F.sum("m").alias("total"))


def period_growth(
    df: DataFrame, date: str, metric: str, grain: str = "month", lag: int = 1, keys: Sequence[str] = (), digits: int = 2
) -> DataFrame:
    """Period totals with the value ``lag`` periods earlier and % growth."""
    g = _period_frame(df, date, metric, grain, keys)
    w = Window.partitionBy(*[q(k) for k in keys]).orderBy("period") if keys else Window.orderBy("period")
    prev = F.lag("total", lag).over(w)
    return g.select(
        *[q(k) for k in keys],
        "period",
        F.round("total", digits).alias("total"),
        F.round(prev, digits).alias("previous"),
        F.round(safe_div((F.col("total") - prev) * 100.0, F.abs(prev)), digits).alias("growth_pct"),
    )


def running(
    df: DataFrame, date: str, metric: str, grain: str = "day", window: int = 7, keys: Sequence[str] = (), digits: int = 2,
    avg_digits: int = 4,
) -> DataFrame:
    """Cumulative total and ``window``-period moving average over period totals.

    The average keeps ``avg_digits`` decimals: an average of cent amounts can
    sit exactly on a half-cent, where engines round the binary double
    differently; for windows up to 7 no 4-decimal tie is possible."""
    g = _period_frame(df, date, metric, grain, keys)
    base = Window.partitionBy(*[q(k) for k in keys]).orderBy("period") if keys else Window.orderBy("period")
    cum = F.sum("total").over(base.rowsBetween(Window.unboundedPreceding, 0))
    mov = F.avg("total").over(base.rowsBetween(-(window - 1), 0))
    return g.select(
        *[q(k) for k in keys],
        "period",
        F.round("total", digits).alias("total"),
        F.round(cum, digits).alias("cumulative"),
        F.round(mov, avg_digits).alias("moving_avg"),
    )


def _category_totals(df: DataFrame, dim: str, metric: str) -> DataFrame:
    dim, metric = resolve(df, dim), resolve(df, metric)
    return (
        df.select(q(dim).cast("string").alias("label"), number(df, metric).alias("m"))
        .where(F.col("label").isNotNull() & F.col("m").isNotNull())
        .groupBy("label")
        .agg(F.sum("m").alias("total"))
    )


def top_bottom(df: DataFrame, dim: str, metric: str, k: int = 5, digits: int = 2) -> DataFrame:
    """Top-k and bottom-k categories by total (two distributed top-k sorts)."""
    g = _category_totals(df, dim, metric)
    top = g.orderBy(F.col("total").desc(), "label").limit(k).withColumn("side", F.lit("top"))
    bot = g.orderBy(F.col("total").asc(), "label").limit(k).withColumn("side", F.lit("bottom"))
    both = top.unionByName(bot)
    w = Window.partitionBy("side").orderBy(
        F.when(F.col("side") == "top", -F.col("total")).otherwise(F.col("total")), "label"
    )
    return both.select("side", F.row_number().over(w).alias("rank"), "label", F.round("total", digits).alias("total"))


def pareto(df: DataFrame, dim: str, metric: str, threshold: float = 0.8, digits: int = 4) -> DataFrame:
    """Smallest set of categories (largest first) whose share reaches ``threshold``."""
    g = _category_totals(df, dim, metric)
    grand = g.agg(F.sum("total")).scalar()
    order = [F.col("total").desc(), F.col("label").asc()]
    r = with_running_sum(g, order, "total", name="cum")
    share = safe_div(F.col("cum"), grand)
    prev_share = safe_div(F.col("cum") - F.col("total"), grand)
    return r.where(prev_share < threshold).select(
        "label", F.round("total", 2).alias("total"), F.round(share, digits).alias("cumulative_share")
    )


def zscore_outliers(df: DataFrame, col: str, k: float = 2.0, digits: int = 4) -> DataFrame:
    """Rows with |x - mean| / population std >= k (needs >= 3 values, std > 0)."""
    col = resolve(df, col)
    x = number(df, col)
    stats = df.select(x.alias("x")).where(F.col("x").isNotNull())
    mean = stats.agg(F.avg("x")).scalar()
    std = stats.agg(F.stddev_pop("x")).scalar()
    n = stats.agg(F.count(F.lit(1))).scalar()
    z = F.try_divide(x - mean, std)
    return df.where((n >= 3) & (std > 0) & x.isNotNull() & (F.abs(z) >= k)).withColumn("zscore", F.round(z, digits))


def zscore_summary(df: DataFrame, col: str, k: float = 2.0, digits: int = 4) -> DataFrame:
    """W6 summary: n, mean, population std, outlier count, min, max (one row)."""
    col = resolve(df, col)
    x = df.select(number(df, col).alias("x")).where(F.col("x").isNotNull())
    s = x.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    mean = x.agg(F.avg("x")).scalar()
    std = x.agg(F.stddev_pop("x")).scalar()
    outl = x.agg(F.count_if(F.abs(F.try_divide(F.col("x") - mean, std)) >= k)).scalar()
    return s.where((F.col("n") >= 3) & (F.col("std") > 0)).select(
        F.lit(col).alias("metric"), "n", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"),
        outl.alias("outliers"), F.round("min", digits).alias("min"), F.round("max", digits).alias("max"),
    )


def iqr_outliers(df: DataFrame, cols: Sequence[str], min_n: int = 8, digits: int = 4) -> DataFrame:
    """Per column, values beyond 1.5*IQR from the quartiles. Columns with
    fewer than ``min_n`` values or IQR = 0 are skipped (as in the reference)."""
    from ..functions.ordering import long_values

    cols = [resolve(df, c) for c in cols]
    long = long_values(df, cols)
    qs = quantile_wide(df, cols, [0.25, 0.75], names=["q1", "q3"])
    ns = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    # one row per column: a broadcast whose size is bounded by the schema
    st = qs.join(ns, "column").withColumn("iqr", F.col("q3") - F.col("q1"))
    st = st.where((F.col("n") >= min_n) & (F.col("iqr") != 0))
    st = st.withColumn("lower", F.col("q1") - 1.5 * F.col("iqr")).withColumn("upper", F.col("q3") + 1.5 * F.col("iqr"))
    hits = long.join(F.broadcast(st.select("column", "lower", "upper")), "column").groupBy("column").agg(
        F.count_if((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))).alias("outliers")
    )
    r = lambda c: F.round(c, digits).alias(c)
    return st.join(hits, "column", "left").select(
        "column", "n", r("q1"), r("q3"), r("iqr"), r("lower"), r("upper"), F.coalesce("outliers", F.lit(0)).alias("outliers")
    )


# ---- W8 resampling ---------------------------------------------------------

FREQS = ("D", "W", "MS")


def auto_freq(span_days: int) -> str:
    """Span > 730 days -> month starts, > 60 -> weeks, else days."""
    return "MS" if span_days > 730 else "W" if span_days > 60 else "D"


def bucket_col(ts: Column, freq: str) -> Column:
    """Bucket label as a date. D: the day; MS: month start; W: the Sunday
    ending the (Sunday, Sunday] bin, as in pandas' right-closed weeks."""
    if freq == "D":
        return F.to_date(ts)
    if freq == "MS":
        return F.to_date(F.date_trunc("month", ts))
    if freq == "W":
        day = F.date_trunc("day", ts)
        ceil_day = F.when(ts > day, F.date_add(F.to_date(day), 1)).otherwise(F.to_date(day))
        return F.date_add(F.to_date(F.date_trunc("week", ceil_day)), 6)
    raise ValueError(f"freq must be one of {FREQS}")


def _step(freq: str) -> Column:
    return {"D": F.expr("INTERVAL 1 DAY"), "W": F.expr("INTERVAL 7 DAYS"), "MS": F.expr("INTERVAL 1 MONTH")}[freq]


def resolve_freq(df: DataFrame, date: str, freq: str = "auto") -> str:
    """``auto`` needs the data's span: one small aggregate action."""
    if freq != "auto":
        return freq
    ts = as_timestamp(df, resolve(df, date))
    r = df.select(ts.alias("t")).agg(F.datediff(F.max("t"), F.min("t")).alias("d")).first()
    return auto_freq(int(r["d"] or 0))


def resample(df: DataFrame, date: str, value: str, freq: str = "auto", keys: Sequence[str] = ()) -> DataFrame:
    """Mean per bucket on a complete calendar, gaps linearly interpolated
    by position. ``(keys..., period, value, interpolated)``; each series'
    calendar spans its own first..last bucket."""
    date, value = resolve(df, date), resolve(df, value)
    keys = [resolve(df, k) for k in keys]
    freq = resolve_freq(df, date, freq)
    kc = [q(k) for k in keys]
    base = df.select(*kc, as_timestamp(df, date).alias("t"), number(df, value).alias("y")).where(
        F.col("t").isNotNull() & F.col("y").isNotNull()
    )
    means = base.groupBy(*kc, bucket_col(F.col("t"), freq).alias("period")).agg(F.avg("y").alias("y"))
    span = means.groupBy(*kc).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    cal = span.select(*kc, F.explode(F.sequence("lo", "hi", _step(freq))).alias("period"))
    from ..functions.ordering import join_null_safe

    full = join_null_safe(cal, means, [*keys, "period"], "left") if keys else cal.join(means, "period", "left")
    w = Window.partitionBy(*kc).orderBy("period")
    full = full.withColumn("_i", F.row_number().over(w))
    known_i = F.when(F.col("y").isNotNull(), F.col("_i"))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    full = full.select(
        *kc,
        "period",
        "y",
        "_i",
        F.last(F.col("y"), ignorenulls=True).over(back).alias("_py"),
        F.last(known_i, ignorenulls=True).over(back).alias("_pi"),
        F.first(F.col("y"), ignorenulls=True).over(fwd).alias("_ny"),
        F.first(known_i, ignorenulls=True).over(fwd).alias("_ni"),
    )
    interp = F.when(F.col("y").isNotNull(), F.col("y")).when(
        F.col("_ny").isNull(), F.col("_py")
    ).otherwise(F.col("_py") + (F.col("_ny") - F.col("_py")) * (F.col("_i") - F.col("_pi")) / (F.col("_ni") - F.col("_pi")))
    return full.select(*kc, "period", interp.alias("value"), F.col("y").isNull().alias("interpolated"))
