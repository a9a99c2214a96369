"""Grouped and scalar aggregates.

Every operator is one declarative plan: partial aggregation happens map-side,
the shuffle is keyed by the group columns, and totals that a ratio needs come
in as uncorrelated scalar subqueries (computed once, no cross join, no
single-task ``over ()`` window). Medians/quartiles use the distributed exact
quantile plan from ``functions.ordering``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, q, resolve, string_columns, value
from ..functions.coerce import number, to_timestamp_mixed
from ..functions.ordering import exact_quantiles, join_null_safe, long_values, quantile_wide, top_k_per_group
from ..functions.stats import p_value_f, p_value_t, safe_div
from .filters import apply_filters

GROUP_OPS = ("count", "count_distinct", "sum", "mean", "median", "min", "max", "percentage")


def _median_by(df: DataFrame, dims: Sequence[str], col: str, label: str) -> DataFrame:
    med = exact_quantiles(df, [col], [0.5], by=dims).select(*[q(d) for d in dims], F.col("value").alias(label))
    groups = df.select(*[q(d) for d in dims]).distinct()
    return join_null_safe(groups, med, list(dims), "left")


def group_agg(
    df: DataFrame,
    dim: str,
    op: str = "count",
    col: str | None = None,
    label: str = "value",
    filters: Sequence = (),
    on_error: str = "raise",
    dropna: bool = False,
) -> DataFrame:
    """A1: aggregate one measure by one dimension after ANDed filters.

    Null groups are kept (``dropna=False``) like the reference's plan executor.
    Sorted by the measure descending, dimension as tie-break."""
    if op not in GROUP_OPS:
        op = "count"
    base = apply_filters(df, filters, on_error=on_error) if filters else df
    dim = resolve(base, dim)
    if dropna:
        base = base.where(q(dim).isNotNull())
    c = value(base, resolve(base, col)) if col else None
    if op in ("count_distinct", "sum", "mean", "median", "min", "max") and c is None:
        op = "count"
    g = base.groupBy(q(dim))
    if op == "count":
        out = g.agg(F.count(F.lit(1)).alias(label))
    elif op == "count_distinct":
        out = g.agg(F.count_distinct(c).alias(label))
    elif op == "sum":
        out = g.agg(F.coalesce(F.sum(c), F.lit(0)).alias(label))
    elif op == "mean":
        out = g.agg(F.round(F.avg(c), 2).alias(label))
    elif op == "median":
        out = _median_by(base, [dim], resolve(base, col), label)
    elif op == "min":
        out = g.agg(F.min(c).alias(label))
    elif op == "max":
        out = g.agg(F.max(c).alias(label))
    else:  # percentage of rows
        total = base.agg(F.count(F.lit(1)).alias("n")).scalar()
        out = g.agg(F.round(F.count(F.lit(1)) * 100.0 / total, 1).alias(label))
    return out.orderBy(F.col(label).desc_nulls_last(), q(dim).asc_nulls_last())


SCALAR_OPS = ("count", "count_distinct", "sum", "mean", "median", "min", "max", "row_count", "nunique", "count_non_null")


def scalar_agg(df: DataFrame, op: str, col: str, filters: Sequence = (), label: str | None = None) -> DataFrame:
    """A2/A4: one value over the whole (filtered) table; unknown op -> sum.

    ``count``/``row_count`` count all rows (not non-null values), like the reference."""
    base = apply_filters(df, filters) if filters else df
    col = resolve(base, col)
    label = label or col
    x = value(base, col)
    if op in ("count", "row_count"):
        e = F.count(F.lit(1))
    elif op in ("count_distinct", "nunique"):
        e = F.count_distinct(x)
    elif op == "count_non_null":
        e = F.count(x)
    elif op == "mean":
        e = F.round(F.avg(x.cast("double")), 4)
    elif op == "median":
        return _scalar_median(base, col, label)
    elif op == "min":
        e = F.min(x).cast("double")
    elif op == "max":
        e = F.max(x).cast("double")
    else:
        e = F.coalesce(F.sum(x.cast("double")), F.lit(0.0))
    return base.agg(e.alias(label))


def _scalar_median(df: DataFrame, col: str, label: str) -> DataFrame:
    med = exact_quantiles(df, [col], [0.5]).agg(F.max("value").alias(label))
    return med


def shape(df: DataFrame) -> DataFrame:
    """A3: row and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))


def group_top(df: DataFrame, dim: str, col: str, agg: str = "sum", n: int = 15, label: str = "value") -> DataFrame:
    """Total or average of ``col`` by ``dim`` (null groups dropped), top ``n``."""
    dim, col = resolve(df, dim), resolve(df, col)
    x = number(df, col)
    e = F.avg(x) if agg in ("mean", "avg", "average") else F.coalesce(F.sum(x), F.lit(0.0))
    out = df.where(q(dim).isNotNull()).groupBy(q(dim)).agg(F.round(e, 4).alias(label))
    return out.orderBy(F.col(label).desc_nulls_last(), q(dim).asc()).limit(n)


def value_counts(df: DataFrame, col: str, n: int = 10, dropna: bool = True) -> DataFrame:
    """Most frequent values, count desc then value asc (a distributed top-k)."""
    col = resolve(df, col)
    base = df.where(q(col).isNotNull()) if dropna else df
    out = base.groupBy(q(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.col("count").desc(), F.col("value").asc_nulls_last()).limit(n)


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Count, mean, std, min, 25/50/75%, max per numeric column (long form)."""
    cols = list(cols) if cols else numeric_columns(df)
    long = long_values(df, cols)
    mom = long.groupBy("column").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    qs = quantile_wide(df, cols, [0.25, 0.5, 0.75], names=["p25", "p50", "p75"])
    out = mom.join(qs, "column", "left")
    r = lambda c: F.round(F.col(c), digits).alias(c)
    return out.select("column", "count", r("mean"), r("std"), r("min"), r("p25"), r("p50"), r("p75"), r("max"))


def share_of_total(df: DataFrame, dim: str, col: str, digits: int = 2) -> DataFrame:
    """Each category's total and its % of the grand total (null groups dropped)."""
    dim, col = resolve(df, dim), resolve(df, col)
    base = df.where(q(dim).isNotNull())
    g = base.groupBy(q(dim)).agg(F.coalesce(F.sum(number(df, col)), F.lit(0.0)).alias("total"))
    grand = base.agg(F.sum(number(df, col)).alias("t")).scalar()
    return g.select(
        q(dim), F.round("total", digits).alias("total"), F.round(safe_div(F.col("total") * 100.0, grand), digits).alias("share_pct")
    ).orderBy(F.col("total").desc(), q(dim))


def segment_driver(df: DataFrame, dim: str, metric: str, top: int = 5, digits: int = 2) -> DataFrame:
    """Leader / laggard / gap / leader share / top segments. One row; no
    row when fewer than two groups. Ties broken by the dimension value."""
    dim, metric = resolve(df, dim), resolve(df, metric)
    x = number(df, metric)
    g = (
        df.select(q(dim).cast("string").alias("label"), x.alias("m"))
        .where(F.col("label").isNotNull() & F.col("m").isNotNull())
        .groupBy("label")
        .agg(F.sum("m").alias("total"))
    )
    top_arr = (
        g.orderBy(F.col("total").desc(), F.col("label")).limit(top)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("k"), "label", "total"))),
                lambda s: F.struct(s["label"].alias("label"), F.round(s["total"], digits).alias("value")),
            ).alias("a")
        )
        .scalar()
    )
    s = g.agg(
        F.count(F.lit(1)).alias("groups"),
        F.min_by("label", F.struct(-F.col("total"), F.col("label"))).alias("leader"),
        F.max(F.col("total")).alias("leader_value"),
        F.max_by("label", F.struct(-F.col("total"), F.col("label"))).alias("laggard"),
        F.min(F.col("total")).alias("laggard_value"),
        F.sum("total").alias("grand"),
    )
    return s.where(F.col("groups") >= 2).select(
        F.lit(dim).alias("dimension"),
        F.lit(metric).alias("metric"),
        "leader",
        F.round("leader_value", digits).alias("leader_value"),
        "laggard",
        F.round("laggard_value", digits).alias("laggard_value"),
        F.round(F.col("leader_value") - F.col("laggard_value"), digits).alias("gap"),
        F.round(F.col("leader_value") / F.when(F.col("grand") != 0, F.col("grand")).otherwise(1.0) * 100, digits).alias(
            "leader_share_pct"
        ),
        "groups",
        top_arr.alias("top_segments"),
    )


def group_means(df: DataFrame, dim: str, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Mean of every numeric column by group."""
    dim = resolve(df, dim)
    cols = [c for c in (cols or numeric_columns(df)) if c != dim]
    return df.groupBy(q(dim)).agg(*[F.round(F.avg(q(c).cast("double")), digits).alias(f"mean_{c}") for c in cols])


def breakdowns(df: DataFrame, metric: str, dims: Sequence[str] | None = None, top: int = 5, digits: int = 2) -> DataFrame:
    """Total of ``metric`` by every categorical column, top ``top`` labels per
    dimension; long (dimension, label, total, rank)."""
    metric = resolve(df, metric)
    dims = list(dims) if dims else [c for c in string_columns(df) if c != metric]
    if not dims:
        raise ValueError("no categorical columns")
    pairs = ", ".join(f"'{d}', cast(`{d}` as string)" for d in dims)
    long = df.select(number(df, metric).alias("m"), *[q(d) for d in dims]).select(
        "m", F.expr(f"stack({len(dims)}, {pairs}) as (dimension, label)")
    )
    g = long.where(F.col("label").isNotNull() & F.col("m").isNotNull()).groupBy("dimension", "label").agg(
        F.sum("m").alias("total")
    )
    ranked = top_k_per_group(g, ["dimension"], [F.col("total").desc(), F.col("label")], top, rank_name="rank")
    return ranked.select("dimension", "label", F.round("total", digits).alias("total"), "rank")


def class_balance(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Count and % per class (nulls dropped) and whether it is the minority."""
    col = resolve(df, col)
    base = df.where(q(col).isNotNull())
    n = base.agg(F.count(F.lit(1))).scalar()
    g = base.groupBy(q(col).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    mn = g.agg(F.min("count")).scalar()
    return g.select(
        "class", "count", F.round(F.col("count") * 100.0 / n, digits).alias("pct"), (F.col("count") == mn).alias("is_minority")
    )


def missing_report(df: DataFrame, digits: int = 2) -> DataFrame:
    """Missing count and % per column (NaN counts as missing). One pass."""
    cols = df.columns
    miss = []
    for f in df.schema.fields:
        c = q(f.name)
        m = c.isNull()
        if f.dataType.typeName() in ("double", "float"):
            m = m | F.isnan(c)
        miss.append(F.count_if(m).alias(f"m{len(miss)}"))
    agg = df.agg(F.count(F.lit(1)).alias("n"), *miss)
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', m{i}" for i, c in enumerate(cols))
    long = agg.select("n", F.expr(f"stack({len(cols)}, {pairs}) as (column, missing)"))
    return long.select(
        "column", "missing", F.round(safe_div(F.col("missing") * 100.0, F.col("n")), digits).alias("missing_pct")
    )


def duplicate_count(df: DataFrame, digits: int = 2) -> DataFrame:
    """Copies after the first (nulls equal nulls), and their % of rows.

    Group-by-all with map-side combine: a row repeated a billion times is
    pre-counted per partition before the shuffle."""
    g = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    s = g.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))
    return s.select(
        "rows", "duplicates", F.round(F.coalesce(safe_div(F.col("duplicates") * 100.0, F.col("rows")), F.lit(0.0)), digits).alias("duplicate_pct")
    )


def zero_report(df: DataFrame) -> DataFrame:
    """Zeros and missing (null or NaN) per numeric column; suspicious = zeros and no missing."""
    cols = numeric_columns(df)
    if not cols:
        raise ValueError("no numeric columns")
    aggs = []
    for i, c in enumerate(cols):
        miss = q(c).isNull()
        if df.schema[c].dataType.typeName() in ("double", "float"):
            miss = miss | F.isnan(q(c))
        aggs += [F.count_if(q(c) == 0).alias(f"z{i}"), F.count_if(miss).alias(f"m{i}")]
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', z{i}, m{i}" for i, c in enumerate(cols))
    long = df.agg(*aggs).select(F.expr(f"stack({len(cols)}, {pairs}) as (column, zeros, missing)"))
    return long.withColumn("suspicious", (F.col("zeros") > 0) & (F.col("missing") == 0))


def uniqueness(df: DataFrame, high_ratio: float = 0.8, digits: int = 4) -> DataFrame:
    """Distinct count/ratio per column, fully unique flag, high-cardinality flag."""
    from .profile import value_freq

    vf = value_freq(df)
    n = df.agg(F.count(F.lit(1))).scalar()
    d = vf.where(F.col("value").isNotNull()).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    ratio = safe_div(F.col("distinct").cast("double"), n)
    return d.select(
        "column",
        "distinct",
        F.round(ratio, digits).alias("distinct_ratio"),
        (F.col("distinct") == n).alias("fully_unique"),
        (ratio >= high_ratio).alias("high_cardinality"),
    )


def crosstab(df: DataFrame, a: str, b: str, value: str | None = None, agg: str = "count", wide: bool = False, max_columns: int = 200) -> DataFrame:
    """Cross-tabulation. Long ``(a, b, value)`` by default; ``wide=True``
    pivots, after checking ``b`` has at most ``max_columns`` distinct values."""
    a, b = resolve(df, a), resolve(df, b)
    if value is None or agg == "count":
        e = F.count(F.lit(1))
    else:
        v = number(df, resolve(df, value))
        e = {"sum": F.sum(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v)}[agg]
    if not wide:
        return df.groupBy(q(a), q(b)).agg(e.alias("value"))
    nb = df.select(q(b)).distinct().limit(max_columns + 1).count()
    if nb > max_columns:
        raise ValueError(f"{b} has more than {max_columns} values; use the long form")
    return df.groupBy(q(a)).pivot(b).agg(e)


def histogram(df: DataFrame, col: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """Equal-width bins between the column's min and max (last bin closed).

    Edges come from scalar subqueries, so this is a single aggregation plan.
    Bins without rows are emitted with a count of 0 (for each group); a
    constant column has one bin."""
    col = resolve(df, col)
    x = number(df, col)
    base = df.select(*([q(resolve(df, by)).alias("group")] if by else []), x.alias("x")).where(F.col("x").isNotNull())
    lo = base.agg(F.min("x")).scalar()
    hi = base.agg(F.max("x")).scalar()
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - lo) / width).cast("int"), F.lit(bins - 1)))
    keys = (["group"] if by else []) + ["bin"]
    g = base.withColumn("bin", b).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    # one more row per bin and group, with a count of 0
    every = F.explode(F.when(hi == lo, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1))))
    empty = g.select(*keys[:-1]).distinct() if by else base.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    empty = empty.select(*keys[:-1], every.alias("bin"), F.lit(0).cast("long").alias("count"))
    g = g.unionByName(empty).groupBy(*keys).agg(F.sum("count").alias("count"))
    return g.select(
        *keys,
        (lo + F.col("bin") * width).alias("lower"),
        F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("upper"),
        "count",
    )


def box_stats(df: DataFrame, col: str, by: str | None = None, digits: int = 4) -> DataFrame:
    """Quartiles, 1.5*IQR whiskers (most extreme values inside the fences)
    and outlier count, per group."""
    col = resolve(df, col)
    by_l = [resolve(df, by)] if by else []
    base = df.select(*[q(b) for b in by_l], number(df, col).alias("x")).where(F.col("x").isNotNull())
    qs = quantile_wide(base, ["x"], [0.25, 0.5, 0.75], by=by_l, names=["q1", "median", "q3"]).drop("column")
    if by_l:
        j = join_null_safe(base, qs, by_l)
    else:
        q1 = qs.agg(F.max("q1")).scalar()
        md = qs.agg(F.max("median")).scalar()
        q3 = qs.agg(F.max("q3")).scalar()
        j = base.select("x", q1.alias("q1"), md.alias("median"), q3.alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    out = j.groupBy(*[q(b) for b in by_l]).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("min"),
        F.first("q1", ignorenulls=True).alias("q1"),
        F.first("median", ignorenulls=True).alias("median"),
        F.first("q3", ignorenulls=True).alias("q3"),
        F.max("x").alias("max"),
        F.min(F.when(F.col("x") >= lo_f, F.col("x"))).alias("lower_whisker"),
        F.max(F.when(F.col("x") <= hi_f, F.col("x"))).alias("upper_whisker"),
        F.count_if((F.col("x") < lo_f) | (F.col("x") > hi_f)).alias("outliers"),
    )
    r = lambda c: F.round(c, digits).alias(c)
    return out.select(*[q(b) for b in by_l], "n", r("min"), r("q1"), r("median"), r("q3"), r("max"), r("lower_whisker"), r("upper_whisker"), "outliers")


def mean_difference_test(df: DataFrame, dim: str, col: str, digits: int = 4) -> DataFrame:
    """Welch t (two groups) or one-way ANOVA F (three or more).

    Group n/mean/variance are one distributed aggregate; the statistic is an
    aggregate over that grouped frame, one row, whose p-value (two-sided for t,
    6 dp) comes from the incomplete beta function."""
    dim, col = resolve(df, dim), resolve(df, col)
    x = number(df, col)
    g = (
        df.select(q(dim).alias("g"), x.alias("x"))
        .where(F.col("g").isNotNull() & F.col("x").isNotNull())
        .groupBy("g")
        .agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
        .where(F.col("n") >= 2)
    )
    # deviations from the grand mean, not sums of squares: no cancellation far from 0
    grand = g.agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).scalar()
    s = g.agg(
        F.sum(F.col("n") * (F.col("m") - grand) * (F.col("m") - grand)).alias("ssb"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("N"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"),
        F.min_by(F.struct("n", "m", "v"), F.col("g")).alias("a"),
        F.max_by(F.struct("n", "m", "v"), F.col("g")).alias("b"),
    )
    va, vb = F.col("a.v") / F.col("a.n"), F.col("b.v") / F.col("b.n")
    welch_t = safe_div(F.col("a.m") - F.col("b.m"), F.sqrt(va + vb))
    welch_df = safe_div((va + vb) * (va + vb), va * va / (F.col("a.n") - 1) + vb * vb / (F.col("b.n") - 1))
    anova_f = safe_div(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("N") - F.col("k")))
    two = F.col("k") == 2
    found = s.where(F.col("k") >= 2).select(
        F.when(two, welch_t).otherwise(anova_f).alias("s"),
        F.when(two, welch_df).otherwise(F.col("k") - 1).cast("double").alias("df1"),
        F.when(two, F.lit(None)).otherwise(F.col("N") - F.col("k")).cast("double").alias("df2"),
        F.col("k").alias("groups"),
        F.col("N").alias("n"),
    )
    rows = []
    for r in found.collect():  # one row at most
        p = None
        if r["s"] is not None and r["df1"]:
            p = p_value_t(r["s"], r["df1"]) if r["groups"] == 2 else p_value_f(r["s"], r["df1"], r["df2"])
        rows.append(("welch_t" if r["groups"] == 2 else "anova_f", r["groups"], r["n"], r["s"], r["df1"], r["df2"], p))
    out = df.sparkSession.createDataFrame(rows, "test string, groups long, n long, statistic double, df1 double, df2 double, p_value double")
    return out.withColumns({c: F.round(c, digits) for c in ("statistic", "df1", "df2")} | {"p_value": F.round("p_value", 6)})


GRAINS = {"day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def period_col(ts: Column, grain: str) -> Column:
    """Period label; weeks are labelled by the Sunday that ends the Mon-Sun week."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {sorted(GRAINS)}")
    start = F.date_trunc(GRAINS[grain], ts)
    if grain == "week":
        return F.to_date(start) + F.lit(6)
    return F.to_date(start)


def period_totals(df: DataFrame, date: str, metric: str, grain: str = "month", digits: int = 2) -> DataFrame:
    """Total of ``metric`` per period (day/week/month/quarter/year)."""
    date, metric = resolve(df, date), resolve(df, metric)
    ts = to_timestamp_mixed(q(date)) if not _is_ts(df, date) else q(date).cast("timestamp")
    base = df.select(period_col(ts, grain).alias("period"), number(df, metric).alias("m")).where(
        F.col("period").isNotNull() & F.col("m").isNotNull()
    )
    return base.groupBy("period").agg(F.round(F.sum("m"), digits).alias("total"), F.count(F.lit(1)).alias("rows"))


def _is_ts(df: DataFrame, name: str) -> bool:
    from ..functions.columns import is_temporal

    return is_temporal(df.schema[name].dataType)
