"""Insight bundles (Q20-Q26): compositions of the operators above.

Column choices (primary metric, dimension, time column) come from the role
table, which has one row per column; everything else is the underlying
operators' DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, q, value
from . import aggregate as A
from . import relate as R
from . import windows as W
from .quality import issue_list, quality_facts, quality_issues, quality_score, table_facts
from .roles import column_roles


def pick_columns(df: DataFrame, facts: dict | None = None) -> dict:
    """Primary metric, dimension and time column by role rank (small collect:
    one row per role assignment)."""
    roles = column_roles(df, facts["flags"] if facts else None).collect()
    by = {}
    for r in sorted(roles, key=lambda r: (r["role"], r["rank"])):
        by.setdefault(r["role"], []).append(r["column"])
    return {
        "metric": (by.get("metrics") or [None])[0],
        "dimension": (by.get("dimensions") or [None])[0],
        "time": (by.get("time") or [None])[0],
        "metrics": by.get("metrics", []),
        "dimensions": by.get("dimensions", []),
    }


def readiness(df: DataFrame) -> DataFrame:
    """Q20: Q5 score - 20 (no metric) - 10 (no dimension) - 10 (< 30 rows)
    - 10 (needs attention), clamped 0-100; ready >= 85, caution >= 65; risk
    flags, among them a missing time field, which costs nothing."""
    facts = quality_facts(df)
    cols = pick_columns(df, facts)
    qs = quality_score(df, facts)
    n = facts["prof"].select("rows").scalar()
    no_metric, no_dim = cols["metric"] is None, cols["dimension"] is None
    pen = F.lit(20 if no_metric else 0) + F.lit(10 if no_dim else 0) + F.when(n < 30, 10).otherwise(0) + F.when(
        F.col("status") == "needs_attention", 10
    ).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("score") - pen))
    flags = F.array_compact(
        F.array(
            F.when(F.lit(no_metric), F.lit("no_metric")),
            F.when(F.lit(no_dim), F.lit("no_dimension")),
            F.when(F.lit(cols["time"] is None), F.lit("no_time_field")),
            F.when(n < 30, F.lit("small_sample")),
            F.when(F.col("status") == "needs_attention", F.lit("quality_needs_attention")),
        )
    )
    return qs.select(
        score.alias("readiness_score"),
        F.when(score >= 85, "ready").when(score >= 65, "caution").otherwise("not_ready").alias("readiness"),
        F.col("score").alias("health_score"),
        flags.alias("risk_flags"),
    )


def kpis(df: DataFrame, metric: str | None = None, digits: int = 2) -> DataFrame:
    """Q21: rows, health score, total and average of the primary metric."""
    facts = quality_facts(df)
    metric = metric or pick_columns(df, facts)["metric"]
    qs = quality_score(df, facts).select("score").scalar()
    df = facts["table"]
    m = q(metric).cast("double") if metric else F.lit(None).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum(m), digits).alias("metric_total"),
        F.round(F.avg(m), digits).alias("metric_mean"),
    ).select("rows", qs.alias("health_score"), F.lit(metric).alias("metric"), "metric_total", "metric_mean")


def dashboard_series(df: DataFrame, metric: str | None = None, dim: str | None = None, date: str | None = None) -> dict[str, DataFrame]:
    """Q22: the series behind a dashboard: trend by month, segment totals (top
    15), segment counts (top 10), histogram of the metric, metric pair."""
    cols = {"metrics": numeric_columns(df)} if metric and dim and date else pick_columns(df)
    metric, dim, date = metric or cols["metric"], dim or cols["dimension"], date or cols["time"]
    out: dict[str, DataFrame] = {}
    if metric and date:
        out["trend"] = A.period_totals(df, date, metric, "month")
    if metric and dim:
        out["segment_totals"] = A.group_top(df, dim, metric, "sum", 15)
    if dim:
        out["segment_counts"] = A.value_counts(df, dim, 10)
    if metric:
        out["histogram"] = A.histogram(df, metric, 10)
    pair = [c for c in cols["metrics"] if c != metric][:1]
    if metric and pair:
        out["metric_pair"] = df.select(q(metric), q(pair[0]))
    return out


def insights(df: DataFrame, metric: str | None = None, dim: str | None = None, limit: int | None = None) -> DataFrame:
    """Q23: insight rows ``(kind, subject, value, detail)`` with evidence
    numbers: profile (rows), kpi (total, mean), segment leader share, quality
    (missing cells, duplicate rows), strongest relationship (|r| >= 0.3), IQR
    anomalies (from 8 values on). ``limit`` cuts the list."""
    facts = quality_facts(df)
    prof, df = facts["prof"], facts["table"]
    if metric is None or dim is None:
        cols = pick_columns(df, facts)
        metric, dim = metric or cols["metric"], dim or cols["dimension"]
    fact = lambda name, c: F.concat(F.lit(name + "="), c.cast("string"))
    parts = [
        prof.select(
            F.lit(0).alias("o"), F.lit("profile").alias("kind"), F.lit("rows").alias("subject"), F.col("rows").cast("double").alias("value"),
            F.concat_ws(" ", fact("columns", F.col("columns")), fact("numeric", F.col("numeric_features"))).alias("detail"),
        )
    ]
    if metric:
        x = value(df, metric).cast("double")
        total = df.agg(F.round(F.sum(x), 2).alias("v"), F.round(F.avg(x), 2).alias("m"))
        parts.append(total.select(F.lit(1), F.lit("kpi"), F.lit(metric), "v", fact("mean", F.col("m"))))
    if metric and dim:
        sd = A.segment_driver(df, dim, metric)
        parts.append(sd.select(F.lit(2), F.lit("segment"), F.col("leader"), F.col("leader_share_pct"), F.lit("leader_share_pct")))
    parts.append(prof.select(F.lit(3), F.lit("quality"), F.lit("missing_cells"), F.col("missing_total").cast("double"), fact("duplicate_rows", F.col("duplicate_rows"))))
    nums = numeric_columns(df)
    if len(nums) >= 2:
        tc = R.top_correlations(df, k=1, min_abs=0.3, cols=nums)
        parts.append(tc.select(F.lit(4), F.lit("relationship"), F.concat_ws(" ~ ", "left", "right"), F.col("corr"), F.col("strength")))
    if metric:
        io = facts["outliers"].where((F.col("column") == metric) & (F.col("outliers") > 0))
        parts.append(io.select(F.lit(5), F.lit("anomaly"), F.col("column"), F.col("outliers").cast("double"), F.lit("iqr_outliers")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.orderBy("o")
    return (out.limit(limit) if limit else out).drop("o")


def investigate(df: DataFrame, metric: str | None = None, dim: str | None = None, date: str | None = None) -> DataFrame:
    """Q24: evidence steps in order: trend, segment driver, z-score anomalies,
    strongest pair, leading quality issue. ``(step, name, status, facts)``
    where facts is a string map."""
    facts = quality_facts(df)
    if not (metric and dim and date):
        cols = pick_columns(df, facts)
        metric, dim, date = metric or cols["metric"], dim or cols["dimension"], date or cols["time"]
    df = facts["table"]
    steps = []
    str_map = lambda fr: F.map_from_arrays(F.array(*[F.lit(c) for c in fr.columns]), F.array(*[F.col(c).cast("string") for c in fr.columns]))
    if metric and date:
        t = W.trend(df, date, metric)
        steps.append(t.select(F.lit(1).alias("step"), F.lit("trend").alias("name"), F.lit("complete").alias("status"), str_map(t).alias("facts")))
    if metric and dim:
        s = A.segment_driver(df, dim, metric).drop("top_segments")
        steps.append(s.select(F.lit(2), F.lit("segment_driver"), F.lit("complete"), str_map(s)))
    if metric:
        z = W.zscore_summary(df, metric)
        steps.append(z.select(F.lit(3), F.lit("anomaly_scan"), F.lit("complete"), str_map(z)))
    nums = numeric_columns(df)
    if len(nums) >= 2:
        c = R.top_correlations(df, k=1, cols=nums)
        steps.append(c.select(F.lit(4), F.lit("relationship"), F.lit("complete"), str_map(c)))
    qi = quality_issues(df, facts).orderBy("seq").limit(1)
    steps.append(qi.select(F.lit(5), F.lit("quality"), F.lit("complete"), str_map(qi)))
    out = steps[0]
    for s in steps[1:]:
        out = out.union(s)
    return out


def story_facts(df: DataFrame, metric: str | None = None, dims=None) -> dict[str, DataFrame]:
    """Q25: profile, primary metric total/mean, 3 dimensions x top 5, and the
    3 strongest pairs."""
    facts = table_facts(df)
    if not (metric and dims):
        cols = pick_columns(facts["table"])
        metric, dims = metric or cols["metric"], dims or cols["dimensions"][:3]
    dims, df = list(dims), facts["table"]
    out = {"profile": facts["prof"]}
    if metric:
        out["metric"] = df.agg(F.round(F.sum(q(metric).cast("double")), 2).alias("total"), F.round(F.avg(q(metric).cast("double")), 2).alias("mean"))
        if dims:
            out["breakdowns"] = A.breakdowns(df, metric, dims, top=5)
    nums = numeric_columns(df)
    if len(nums) >= 2:
        out["pairs"] = R.top_correlations(df, k=3, cols=nums)
    return out


def decision_triggers(df: DataFrame, metric: str | None = None, dim: str | None = None, date: str | None = None) -> DataFrame:
    """Q26: triggers ``(trigger, level, subject, value)``: the leader's share
    from two groups on (high from 40%, else medium); trend |change| >= 5% (a
    drop > 10% is high); one high row for each warning among the first two
    quality issues; model readiness (a metric, >= 50 rows, >= 2 numeric
    columns; medium)."""
    facts = quality_facts(df)
    if metric is None or dim is None or date is None:
        cols = pick_columns(df, facts)
        metric, dim, date = metric or cols["metric"], dim or cols["dimension"], date or cols["time"]
    df = facts["table"]
    parts = []
    if metric and dim:
        s = A.segment_driver(df, dim, metric)
        groups = df.where(q(dim).isNotNull()).agg(F.count_distinct(q(dim))).scalar()
        share = F.col("leader_share_pct").cast("double")
        level = F.when(share >= 40, "high").otherwise("medium")
        parts.append(s.where(groups >= 2).select(F.lit("concentration").alias("trigger"), level.alias("level"), F.col("leader").alias("subject"), share.alias("value")))
    if metric and date:
        t = W.trend(df, date, metric).where((F.col("periods") >= 3) & (F.abs("pct_change") >= 5))
        parts.append(t.select(F.lit("trend").alias("trigger"), F.when(F.col("pct_change") < -10, "high").otherwise("medium").alias("level"), F.lit(metric).alias("subject"), F.col("pct_change").cast("double").alias("value")))
    first_two = issue_list(quality_issues(df, facts)).orderBy("seq").limit(2).where(F.col("severity") == "warn")
    parts.append(first_two.select(F.lit("quality").alias("trigger"), F.lit("high").alias("level"), F.col("code").alias("subject"), F.col("value")))
    if metric:
        enough = (F.col("rows") >= 50) & (F.col("numeric_features") >= 2)
        parts.append(facts["prof"].where(enough).select(F.lit("model_ready"), F.lit("medium"), F.lit(metric), F.col("rows").cast("double")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
