"""Registered analyses: filters, aggregates, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import filters as FL
from ..operators import joins as J
from .catalog import load, register
from .derived import dirty_events


@register(
    "a1_sum_by_segment",
    """
    SELECT c_mktsegment, round(coalesce(sum(o_totalprice), 0), 2) AS revenue
    FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey
    WHERE o_orderstatus = 'F'
    GROUP BY c_mktsegment
    """,
)
def a1_sum_by_segment(spark, sf):
    """Flagship: S3 + J1 + F1 + A1 — revenue of fulfilled orders by customer segment."""
    joined = J.join_tables(load(spark, sf, "orders"), load(spark, sf, "customer"), "o_custkey", "c_custkey")
    g = A.group_agg(joined, "c_mktsegment", "sum", "o_totalprice", label="revenue", filters=[("o_orderstatus", "==", "F")])
    return g.select("c_mktsegment", F.round("revenue", 2).alias("revenue"))


@register(
    "a1_count_distinct_by_priority",
    "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
)
def a1_count_distinct(spark, sf):
    return A.group_agg(load(spark, sf, "orders"), "o_orderpriority", "count_distinct", "o_custkey", label="customers")


@register(
    "a1_mean_by_status",
    "SELECT o_orderstatus, round(avg(o_totalprice), 2) AS mean_price FROM orders GROUP BY o_orderstatus",
)
def a1_mean(spark, sf):
    return A.group_agg(load(spark, sf, "orders"), "o_orderstatus", "mean", "o_totalprice", label="mean_price")


@register(
    "a1_median_by_returnflag",
    "SELECT l_returnflag, round(median(l_extendedprice), 4) AS median_price FROM lineitem GROUP BY l_returnflag",
)
def a1_median(spark, sf):
    g = A.group_agg(load(spark, sf, "lineitem"), "l_returnflag", "median", "l_extendedprice", label="median_price")
    return g.select("l_returnflag", F.round("median_price", 4).alias("median_price"))


@register(
    "a1_percentage_by_priority",
    """
    SELECT o_orderpriority, round(count(*) * 100.0 / (SELECT count(*) FROM orders WHERE o_totalprice > 100000), 1) AS pct
    FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority
    """,
)
def a1_percentage(spark, sf):
    return A.group_agg(
        load(spark, sf, "orders"), "o_orderpriority", "percentage", label="pct", filters=[("o_totalprice", ">", 100000)]
    )


@register(
    "a1_min_max_by_linestatus",
    "SELECT l_linestatus, min(l_discount) AS min_discount, max(l_tax) AS max_tax FROM lineitem GROUP BY l_linestatus",
)
def a1_min_max(spark, sf):
    li = load(spark, sf, "lineitem")
    mn = A.group_agg(li, "l_linestatus", "min", "l_discount", label="min_discount")
    mx = A.group_agg(li, "l_linestatus", "max", "l_tax", label="max_tax")
    return mn.join(mx, "l_linestatus")


@register("a2_scalar_mean", "SELECT round(avg(l_quantity), 4) AS l_quantity FROM lineitem")
def a2_mean(spark, sf):
    return A.scalar_agg(load(spark, sf, "lineitem"), "mean", "l_quantity")


@register("a2_scalar_median", "SELECT round(median(o_totalprice), 4) AS o_totalprice FROM orders")
def a2_median(spark, sf):
    return A.scalar_agg(load(spark, sf, "orders"), "median", "o_totalprice").select(F.round("o_totalprice", 4).alias("o_totalprice"))


@register(
    "a2_scalar_sum_filtered",
    "SELECT round(coalesce(sum(l_extendedprice), 0), 2) AS l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05",
)
def a2_sum(spark, sf):
    r = A.scalar_agg(load(spark, sf, "lineitem"), "sum", "l_extendedprice", filters=[("l_returnflag", "==", "R"), ("l_discount", ">=", 0.05)])
    return r.select(F.round("l_extendedprice", 2).alias("l_extendedprice"))


@register("a3_shape", "SELECT count(*) AS rows, 11 AS columns FROM lineitem")
def a3_shape(spark, sf):
    return A.shape(load(spark, sf, "lineitem"))


@register(
    "a4_column_counts",
    """
    SELECT count(*) AS row_count, count(DISTINCT l_partkey) AS nunique, count(l_partkey) AS count_non_null,
           round(avg(l_partkey), 4) AS mean
    FROM lineitem
    """,
)
def a4_counts(spark, sf):
    li = load(spark, sf, "lineitem")
    parts = [A.scalar_agg(li, op, "l_partkey", label=op) for op in ("row_count", "nunique", "count_non_null", "mean")]
    return parts[0].select(
        "row_count", parts[1].scalar().alias("nunique"), parts[2].scalar().alias("count_non_null"), parts[3].scalar().alias("mean")
    )


@register(
    "a6_top_brands_by_price",
    """
    SELECT p_brand, round(avg(p_retailprice), 4) AS value FROM part WHERE p_brand IS NOT NULL
    GROUP BY p_brand ORDER BY value DESC, p_brand LIMIT 15
    """,
)
def a6_top(spark, sf):
    return A.group_top(load(spark, sf, "part"), "p_brand", "p_retailprice", "mean", n=15)


@register(
    "a7_value_counts_type",
    """
    SELECT CAST(p_type AS VARCHAR) AS value, count(*) AS count FROM part WHERE p_type IS NOT NULL
    GROUP BY 1 ORDER BY count DESC, value LIMIT 10
    """,
)
def a7_value_counts(spark, sf):
    return A.value_counts(load(spark, sf, "part"), "p_type", n=10)


_A8_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _a8_sql() -> str:
    parts = []
    for c in _A8_COLS:
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, "
            f"round(min({c}), 2) AS min, round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50, "
            f"round(quantile_cont({c}, 0.75), 2) AS p75, round(max({c}), 2) AS max FROM lineitem"
        )
    return "\nUNION ALL\n".join(parts)


@register("a8_describe_lineitem", _a8_sql())
def a8_describe(spark, sf):
    return A.describe_numeric(load(spark, sf, "lineitem"))


@register(
    "a14_share_by_nation",
    """
    SELECT c_nationkey, round(sum(c_acctbal), 2) AS total,
           round(sum(c_acctbal) * 100.0 / (SELECT sum(c_acctbal) FROM customer WHERE c_nationkey IS NOT NULL), 2) AS share_pct
    FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey
    """,
)
def a14_share(spark, sf):
    return A.share_of_total(load(spark, sf, "customer"), "c_nationkey", "c_acctbal")


@register(
    "a15_segment_driver",
    """
    WITH g AS (SELECT CAST(c_mktsegment AS VARCHAR) AS label, sum(c_acctbal) AS total FROM customer
               WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL GROUP BY 1),
         lead AS (SELECT label, total FROM g ORDER BY total DESC, label LIMIT 1),
         lag AS (SELECT label, total FROM g ORDER BY total ASC, label DESC LIMIT 1)
    SELECT 'c_mktsegment' AS dimension, 'c_acctbal' AS metric, lead.label AS leader, round(lead.total, 2) AS leader_value,
           lag.label AS laggard, round(lag.total, 2) AS laggard_value, round(lead.total - lag.total, 2) AS gap,
           round(lead.total / (SELECT sum(total) FROM g) * 100, 2) AS leader_share_pct, (SELECT count(*) FROM g) AS groups,
           (SELECT string_agg(label, ',' ORDER BY total DESC, label) FROM (SELECT * FROM g ORDER BY total DESC, label LIMIT 5)) AS top_labels,
           (SELECT round(sum(v), 2) FROM (SELECT round(total, 2) AS v FROM g ORDER BY total DESC, label LIMIT 5)) AS top_total
    FROM lead, lag
    """,
)
def a15_driver(spark, sf):
    d = A.segment_driver(load(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    # the five leading segments as plain columns, in order
    total = F.round(F.aggregate("top_segments.value", F.lit(0.0), lambda a, x: a + x), 2)
    return d.withColumns({"top_labels": F.array_join("top_segments.label", ","), "top_total": total}).drop("top_segments")


@register(
    "a16_group_means",
    "SELECT l_returnflag, " + ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in _A8_COLS) + " FROM lineitem GROUP BY l_returnflag",
)
def a16_means(spark, sf):
    return A.group_means(load(spark, sf, "lineitem"), "l_returnflag")


@register(
    "a17_breakdowns",
    """
    WITH long AS (
      SELECT 'o_orderstatus' AS dimension, CAST(o_orderstatus AS VARCHAR) AS label, o_totalprice AS m FROM orders
      UNION ALL SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR), o_totalprice FROM orders),
    g AS (SELECT dimension, label, sum(m) AS total FROM long WHERE label IS NOT NULL AND m IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, label) AS rank FROM g)
    SELECT dimension, label, round(total, 2) AS total, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
    """,
)
def a17_breakdowns(spark, sf):
    return A.breakdowns(load(spark, sf, "orders"), "o_totalprice")


@register(
    "a18_class_balance",
    """
    WITH g AS (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS count FROM labels WHERE quality IS NOT NULL GROUP BY 1)
    SELECT class, count, round(count * 100.0 / (SELECT sum(count) FROM g), 2) AS pct,
           count = (SELECT min(count) FROM g) AS is_minority FROM g
    """,
)
def a18_balance(spark, sf):
    return A.class_balance(load(spark, sf, "labels"), "quality")


_A19_COLS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def _a19_sql() -> str:
    parts = []
    for c in _A19_COLS:
        extra = f" OR isnan({c})" if c == "value" else ""
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL{extra}) AS BIGINT) AS missing, "
            f"round(count_if({c} IS NULL{extra}) * 100.0 / count(*), 2) AS missing_pct FROM ev"
        )
    return (
        "WITH ev AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, "
        "CASE WHEN event_type = 'view' THEN NULL ELSE props END AS props FROM events)\n" + "\nUNION ALL\n".join(parts)
    )


@register("a19_missing_report", _a19_sql())
def a19_missing(spark, sf):
    return A.missing_report(dirty_events(spark, sf))


@register(
    "a20_duplicates",
    """
    WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
    SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicates, round(coalesce(sum(c - 1) * 100.0 / sum(c), 0), 2) AS duplicate_pct FROM g
    """,
)
def a20_dups(spark, sf):
    return A.duplicate_count(load(spark, sf, "lineitem"))


def _nan(c: str) -> str:
    return f" OR isnan({c})" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else ""


_A21_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register(
    "a21_zero_report",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST(count_if({c} = 0) AS BIGINT) AS zeros, CAST(count_if({c} IS NULL{_nan(c)}) AS BIGINT) AS missing, "
        f"(count_if({c} = 0) > 0 AND count_if({c} IS NULL{_nan(c)}) = 0) AS suspicious FROM lineitem"
        for c in _A21_COLS
    ),
)
def a21_zeros(spark, sf):
    return A.zero_report(load(spark, sf, "lineitem"))


_A22_COLS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@register(
    "a22_uniqueness",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT CAST({c} AS VARCHAR)) AS distinct, "
        f"round(count(DISTINCT CAST({c} AS VARCHAR)) * 1.0 / count(*), 4) AS distinct_ratio, "
        f"count(DISTINCT CAST({c} AS VARCHAR)) = count(*) AS fully_unique, "
        f"count(DISTINCT CAST({c} AS VARCHAR)) * 1.0 / count(*) >= 0.8 AS high_cardinality FROM part"
        for c in _A22_COLS
    ),
)
def a22_unique(spark, sf):
    return A.uniqueness(load(spark, sf, "part"))


@register(
    "a23_crosstab",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS value FROM orders GROUP BY 1, 2",
)
def a23_crosstab(spark, sf):
    return A.crosstab(load(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@register(
    "a24_histogram",
    """
    WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    x AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 10)) AS INTEGER), 9) END AS bin,
                 lo, hi FROM orders, b WHERE o_totalprice IS NOT NULL)
    SELECT bin, round(min(lo) + bin * (min(hi) - min(lo)) / 10, 4) AS lower,
           round(CASE WHEN bin = 9 THEN min(hi) ELSE min(lo) + (bin + 1) * (min(hi) - min(lo)) / 10 END, 4) AS upper,
           count(*) AS count
    FROM x GROUP BY bin
    """,
)
def a24_hist(spark, sf):
    h = A.histogram(load(spark, sf, "orders"), "o_totalprice", bins=10)
    return h.select("bin", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "count")


@register(
    "a25_box_stats",
    """
    WITH qs AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS med,
                       quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
    j AS (SELECT l.l_returnflag, l.l_extendedprice AS x, q1, med, q3, q3 - q1 AS iqr FROM lineitem l JOIN qs USING (l_returnflag))
    SELECT l_returnflag, count(*) AS n, round(min(x), 4) AS min, round(min(q1), 4) AS q1, round(min(med), 4) AS median,
           round(min(q3), 4) AS q3, round(max(x), 4) AS max,
           round(min(CASE WHEN x >= q1 - 1.5 * iqr THEN x END), 4) AS lower_whisker,
           round(max(CASE WHEN x <= q3 + 1.5 * iqr THEN x END), 4) AS upper_whisker,
           CAST(count_if(x < q1 - 1.5 * iqr OR x > q3 + 1.5 * iqr) AS BIGINT) AS outliers
    FROM j GROUP BY 1
    """,
)
def a25_box(spark, sf):
    return A.box_stats(load(spark, sf, "lineitem"), "l_extendedprice", by="l_returnflag")


@register(
    "a26_mean_difference_anova",
    """
    WITH RECURSIVE g AS (SELECT o_orderstatus AS g, count(o_totalprice) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v
               FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1 HAVING count(o_totalprice) >= 2),
    s AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * m) / sum(n) AS grand, sum(n * m * m) AS snm2, sum((n - 1) * v) AS ssw FROM g),
    f AS (SELECT k, nn, CAST(k - 1 AS DOUBLE) AS df1, CAST(nn - k AS DOUBLE) AS df2,
                 ((snm2 - nn * grand * grand) / (k - 1)) / (ssw / (nn - k)) AS f FROM s),
    -- incomplete beta function with a = df2 / 2, b = df1 / 2 at x, from the side on which its fraction converges
    x AS (SELECT *, df2 / (df2 + df1 * f) AS x0, df2 / 2 AS a0, df1 / 2 AS b0 FROM f),
    y AS (SELECT *, x0 < (a0 + 1) / (a0 + b0 + 2) AS low FROM x),
    z AS (SELECT *, CASE WHEN low THEN a0 ELSE b0 END AS a, CASE WHEN low THEN b0 ELSE a0 END AS b, CASE WHEN low THEN x0 ELSE 1 - x0 END AS x FROM y),
    -- the two steps of each round of the fraction, one after the other
    cf AS (SELECT 0 AS i, a, b, x, CAST(1 AS DOUBLE) AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h FROM z
           UNION ALL
           SELECT i + 1, a, b, x, 1 + t / c, 1 / (1 + t * d), h * (1 + t / c) / (1 + t * d)
           FROM (SELECT *, CASE WHEN i % 2 = 0 THEN (i // 2 + 1) * (b - (i // 2 + 1)) * x / ((a + 2 * (i // 2 + 1) - 1) * (a + 2 * (i // 2 + 1)))
                                ELSE -(a + (i // 2 + 1)) * (a + b + (i // 2 + 1)) * x / ((a + 2 * (i // 2 + 1)) * (a + 2 * (i // 2 + 1) + 1)) END AS t FROM cf)
           WHERE i < 600),
    r AS (SELECT exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * h / a AS part FROM cf WHERE i = 600)
    SELECT 'anova_f' AS test, k AS groups, CAST(nn AS BIGINT) AS n, round(f, 4) AS statistic, round(df1, 4) AS df1, round(df2, 4) AS df2,
           round(CASE WHEN low THEN part ELSE 1 - part END, 6) AS p_value
    FROM z, r
    """,
)
def a26_anova(spark, sf):
    return A.mean_difference_test(load(spark, sf, "orders"), "o_orderstatus", "o_totalprice")


@register(
    "a27_period_totals_month",
    """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS total, count(*) AS rows
    FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1
    """,
)
def a27_period(spark, sf):
    return A.period_totals(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month")


# ---- filters -------------------------------------------------------------


@register(
    "f1_filters_lineitem",
    """
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus FROM lineitem
    WHERE l_returnflag IS DISTINCT FROM 'R' AND l_quantity >= 10 AND l_linestatus IN ('O')
    """,
)
def f1_filters(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    return FL.apply_filters(li, [("l_returnflag", "!=", "R"), ("l_quantity", ">=", 10), ("L_LINESTATUS", "in", ["O"])])


@register("f1_contains_part", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def f1_contains(spark, sf):
    return FL.apply_filters(load(spark, sf, "part").select("p_partkey", "p_name"), [("p_name", "contains", "Ring")])


@register(
    "f4_support",
    """
    SELECT count(*) AS rows, CAST(count_if(value IS NOT NULL AND props IS NOT NULL) AS BIGINT) AS complete_rows,
           round(CASE WHEN count(*) > 0 THEN (count(*) - count_if(value IS NOT NULL AND props IS NOT NULL)) * 100.0 / count(*) ELSE 0 END, 2) AS missing_pct
    FROM (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
                 CASE WHEN event_type = 'view' THEN NULL ELSE props END AS props FROM events)
    """,
)
def f4_support(spark, sf):
    return FL.support(dirty_events(spark, sf), ["value", "props"])


@register(
    "f4_complete_cases",
    """
    SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
                 CASE WHEN event_type = 'view' THEN NULL ELSE props END AS props FROM events)
    WHERE value IS NOT NULL AND props IS NOT NULL
    """,
)
def f4_complete(spark, sf):
    return FL.complete_cases(dirty_events(spark, sf), ["value", "props"]).select("event_id", "value")


@register(
    "f5_search_rows",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE contains(lower(CAST(c_custkey AS VARCHAR)), 'machinery') OR contains(lower(c_name), 'machinery')
       OR contains(lower(CAST(c_nationkey AS VARCHAR)), 'machinery') OR contains(lower(c_mktsegment), 'machinery')
    """,
)
def f5_search(spark, sf):
    cu = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return FL.search_rows(cu, "MACHinery").select("c_custkey", "c_name")


@register(
    "f8_above_average",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
)
def f8_above(spark, sf):
    return FL.above_average(load(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "o_totalprice")


@register(
    "f9_sql_select",
    """
    SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY o_orderpriority
    """,
)
def f9_sql(spark, sf):
    sql = (
        "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM data "
        "WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY o_orderpriority"
    )
    return FL.sql_select(spark, sql, {"data": load(spark, sf, "orders")})


# ---- joins and set operations ---------------------------------------------


@register(
    "j1_join_nation_region",
    """
    SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name
    FROM nation LEFT JOIN region ON n_regionkey IS NOT DISTINCT FROM r_regionkey
    """,
)
def j1_join(spark, sf):
    return J.join_tables(load(spark, sf, "nation"), load(spark, sf, "region"), "n_regionkey", "r_regionkey", "left")


@register(
    "j1_join_lineitem_orders",
    """
    SELECT o_orderpriority, count(*) AS lines, round(sum(l_extendedprice), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey IS NOT DISTINCT FROM o_orderkey GROUP BY o_orderpriority
    """,
)
def j1_join_big(spark, sf):
    j = J.join_tables(load(spark, sf, "lineitem"), load(spark, sf, "orders"), "l_orderkey", "o_orderkey")
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@register(
    "j2_join_audit",
    """
    SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM customer) AS right_rows,
           (SELECT count(*) FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey) AS rows_after
    """,
)
def j2_audit(spark, sf):
    return J.join_audit(load(spark, sf, "orders"), load(spark, sf, "customer"), "o_custkey", "c_custkey")


def _j3_sql() -> str:
    lcols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    rcols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    # Spark renders timestamps as 'yyyy-MM-dd HH:mm:ss'; strftime gives the same text
    def txt(c):
        return f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c == "o_orderdate" else f"CAST({c} AS VARCHAR)"

    v1 = " UNION ".join(f"SELECT DISTINCT '{c}' AS column_1, {i} AS pos_1, trim({txt(c)}) AS value FROM orders WHERE {c} IS NOT NULL" for i, c in enumerate(lcols))
    v2 = " UNION ".join(f"SELECT DISTINCT '{c}' AS column_2, {i} AS pos_2, trim({txt(c)}) AS value FROM customer WHERE {c} IS NOT NULL" for i, c in enumerate(rcols))
    return f"""
    WITH v1 AS ({v1}), v2 AS ({v2}),
    n1 AS (SELECT column_1, pos_1, count(*) AS n1 FROM v1 GROUP BY 1, 2),
    n2 AS (SELECT column_2, pos_2, count(*) AS n2 FROM v2 GROUP BY 1, 2),
    c AS (SELECT column_1, pos_1, column_2, pos_2, value FROM v1 JOIN v2 USING (value)),
    g AS (SELECT column_1, pos_1, column_2, pos_2, count(*) AS m,
                 array_to_string(list_sort(list(value ORDER BY value)[1:3]), ',') AS samples
          FROM c GROUP BY 1, 2, 3, 4),
    s AS (SELECT g.*, n1, n2,
                 round(least(1.0, greatest(m * 1.0 / n1, m * 1.0 / n2) * 0.6
                   + CASE WHEN lower(column_1) = lower(column_2) THEN 0.3 ELSE 0 END
                   + CASE WHEN lower(column_1) LIKE '%id' OR lower(column_2) LIKE '%id' THEN 0.1 ELSE 0 END), 2) AS score
          FROM g JOIN n1 USING (column_1, pos_1) JOIN n2 USING (column_2, pos_2))
    SELECT column_1, column_2, score,
           CASE WHEN score >= 0.7 THEN 'High' WHEN score >= 0.4 THEN 'Medium' ELSE 'Low' END AS confidence_label,
           m AS matched_unique_count, round(m * 100.0 / n1, 1) AS overlap_pct_1, round(m * 100.0 / n2, 1) AS overlap_pct_2,
           samples AS sample_matches
    FROM s WHERE score >= 0.2 ORDER BY score DESC, pos_1, pos_2 LIMIT 5
    """


@register("j3_infer_join_keys", _j3_sql())
def j3_infer(spark, sf):
    r = J.infer_join_keys(load(spark, sf, "orders"), load(spark, sf, "customer"))
    return r.withColumn("sample_matches", F.array_join("sample_matches", ","))


@register(
    "u1_distinct_rows",
    "SELECT DISTINCT * FROM lineitem",
)
def u1_distinct(spark, sf):
    return J.distinct_rows(load(spark, sf, "lineitem"))


@register(
    "u2_union_tagged",
    """
    SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment, 'customer' AS kind FROM customer
    UNION ALL SELECT s_name, s_acctbal, NULL, 'supplier' FROM supplier
    """,
)
def u2_union(spark, sf):
    cu = load(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    su = load(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return J.union_tagged({"customer": cu, "supplier": su})


@register(
    "u3_value_overlap",
    """
    WITH a AS (SELECT DISTINCT trim(CAST(o_custkey AS VARCHAR)) AS value FROM orders WHERE o_custkey IS NOT NULL),
         b AS (SELECT DISTINCT trim(CAST(c_custkey AS VARCHAR)) AS value FROM customer WHERE c_custkey IS NOT NULL)
    SELECT (SELECT count(*) FROM a) AS left_distinct, (SELECT count(*) FROM b) AS right_distinct,
           (SELECT count(*) FROM a JOIN b USING (value)) AS common,
           round((SELECT count(*) FROM a JOIN b USING (value)) * 100.0 / (SELECT count(*) FROM a), 1) AS overlap_pct_left,
           round((SELECT count(*) FROM a JOIN b USING (value)) * 100.0 / (SELECT count(*) FROM b), 1) AS overlap_pct_right
    """,
)
def u3_overlap(spark, sf):
    return J.value_overlap(load(spark, sf, "orders"), "o_custkey", load(spark, sf, "customer"), "c_custkey")
