"""Registered analyses: relationships, windows, resampling and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..operators import relate as R
from ..operators import windows as W
from .catalog import load, register

# every numeric column of lineitem
_LI = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _pairs(cols, diagonal=False):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i if diagonal else i + 1:]]


@register(
    "a9_correlation",
    "\nUNION ALL\n".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 3) + 0.0 AS corr, "
        f"CAST(count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n FROM lineitem"
        for a, b in _pairs(_LI)
    ),
)
def a9_corr(spark, sf):
    return R.correlation(load(spark, sf, "lineitem"))


@register(
    "a10_top_correlations",
    "WITH c AS ("
    + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 3) + 0.0 AS corr, "
        f"CAST(count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n FROM lineitem"
        for a, b in _pairs(_LI)
    )
    + """)
    SELECT "left", "right", corr, n,
           CASE WHEN abs(corr) >= 0.6 THEN 'High' WHEN abs(corr) >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength
    FROM c WHERE corr IS NOT NULL ORDER BY abs(corr) DESC, "left", "right" LIMIT 3
    """,
)
def a10_top(spark, sf):
    return R.top_correlations(load(spark, sf, "lineitem"), k=3)


@register(
    "a11_correlate_with_target",
    "\nUNION ALL\n".join(
        f"SELECT '{a}' AS feature, round(corr({a}, l_extendedprice), 3) + 0.0 AS corr, "
        f"CAST(count_if({a} IS NOT NULL AND l_extendedprice IS NOT NULL) AS BIGINT) AS n FROM lineitem"
        for a in _LI
        if a != "l_extendedprice"
    ),
)
def a11_corr_with(spark, sf):
    return R.correlate_with(load(spark, sf, "lineitem"), "l_extendedprice")


@register(
    "a12_covariance",
    "\nUNION ALL\n".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(covar_samp({a}, {b}), 4) + 0.0 AS cov FROM lineitem"
        for a, b in _pairs(_LI, diagonal=True)
    ),
)
def a12_cov(spark, sf):
    return R.covariance(load(spark, sf, "lineitem"))


@register(
    "a13_moments",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis, "
        f"round(stddev_samp({c}) / abs(avg({c})), 4) AS cv FROM lineitem"
        for c in _LI
    ),
)
def a13_moments(spark, sf):
    return R.moments(load(spark, sf, "lineitem"))


@register(
    "w1_trend",
    """
    WITH g AS (SELECT o_orderdate AS t, sum(o_totalprice) AS total, count(*) AS rows FROM orders
               WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1),
    s AS (SELECT sum(rows) AS rows, count(*) AS periods, min(t) AS ft, max(t) AS lt,
                 arg_min(total, t) AS fv, arg_max(total, t) AS lv FROM g)
    SELECT 'o_orderdate' AS time_column, 'o_totalprice' AS metric, strftime(ft, '%Y-%m-%d') AS first_period,
           strftime(lt, '%Y-%m-%d') AS latest_period, round(fv, 2) AS first_value, round(lv, 2) AS latest_value,
           round(lv - fv, 2) AS delta, round(CASE WHEN fv <> 0 THEN (lv - fv) / abs(fv) * 100 ELSE 0 END, 2) AS pct_change,
           CASE WHEN lv - fv >= 0 THEN 'increased' ELSE 'declined' END AS direction, periods
    FROM s WHERE rows >= 2
    """,
)
def w1_trend(spark, sf):
    return W.trend(load(spark, sf, "orders"), "o_orderdate", "o_totalprice")


@register(
    "w2_period_growth",
    """
    WITH g AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS total FROM orders
               WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1),
    l AS (SELECT period, total, lag(total, 1) OVER (ORDER BY period) AS prev FROM g)
    SELECT period, round(total, 2) AS total, round(prev, 2) AS previous,
           round(CASE WHEN prev <> 0 THEN (total - prev) * 100.0 / abs(prev) END, 2) AS growth_pct FROM l
    """,
)
def w2_growth(spark, sf):
    return W.period_growth(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month")


@register(
    "w3_running_totals",
    """
    WITH g AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS period, sum(value) AS total FROM events
               WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)
    SELECT event_type, period, round(total, 2) AS total,
           round(sum(total) OVER (PARTITION BY event_type ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS cumulative,
           round(avg(total) OVER (PARTITION BY event_type ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS moving_avg
    FROM g
    """,
)
def w3_running(spark, sf):
    return W.running(load(spark, sf, "events"), "ts", "value", "day", window=7, keys=["event_type"])


@register(
    "w4_top_bottom",
    """
    WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, sum(l_extendedprice) AS total FROM lineitem
               WHERE l_suppkey IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1),
    t AS (SELECT 'top' AS side, row_number() OVER (ORDER BY total DESC, label) AS rank, label, total FROM g),
    b AS (SELECT 'bottom' AS side, row_number() OVER (ORDER BY total ASC, label) AS rank, label, total FROM g)
    SELECT side, CAST(rank AS INTEGER) AS rank, label, round(total, 2) AS total FROM t WHERE rank <= 5
    UNION ALL SELECT side, CAST(rank AS INTEGER), label, round(total, 2) FROM b WHERE rank <= 5
    """,
)
def w4_top_bottom(spark, sf):
    return W.top_bottom(load(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", k=5)


@register(
    "w5_pareto",
    """
    WITH g AS (SELECT CAST(l_partkey AS VARCHAR) AS label, sum(l_extendedprice) AS total FROM lineitem
               WHERE l_partkey IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1),
    c AS (SELECT label, total, sum(total) OVER (ORDER BY total DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                 (SELECT sum(total) FROM g) AS grand FROM g)
    SELECT label, round(total, 2) AS total, round(cum / grand, 4) AS cumulative_share FROM c WHERE (cum - total) / grand < 0.8
    """,
)
def w5_pareto(spark, sf):
    return W.pareto(load(spark, sf, "lineitem"), "l_partkey", "l_extendedprice", 0.8)


@register(
    "w6_zscore_outliers",
    """
    WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd, count(o_totalprice) AS n FROM orders)
    SELECT o_orderkey, round((o_totalprice - m) / sd, 4) AS zscore FROM orders, s
    WHERE n >= 3 AND sd > 0 AND o_totalprice IS NOT NULL AND abs((o_totalprice - m) / sd) >= 1.5
    """,
)
def w6_zscore(spark, sf):
    return W.zscore_outliers(load(spark, sf, "orders"), "o_totalprice", 1.5).select("o_orderkey", "zscore")


@register(
    "w6_zscore_summary",
    """
    WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd, count(l_extendedprice) AS n,
                      min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem)
    SELECT 'l_extendedprice' AS metric, n, round(m, 4) AS mean, round(sd, 4) AS std,
           CAST((SELECT count_if(abs((l_extendedprice - m) / sd) >= 2) FROM lineitem) AS BIGINT) AS outliers, round(mn, 4) AS min, round(mx, 4) AS max
    FROM s WHERE n >= 3 AND sd > 0
    """,
)
def w6_summary(spark, sf):
    return W.zscore_summary(load(spark, sf, "lineitem"), "l_extendedprice", 2.0)


@register(
    "w7_iqr_outliers",
    "WITH long AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM lineitem WHERE {c} IS NOT NULL" for c in _LI)
    + """),
    st AS (SELECT "column", count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY 1),
    f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM st WHERE n >= 8 AND q3 - q1 <> 0)
    SELECT f."column", f.n, round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr, round(lower, 4) AS lower, round(upper, 4) AS upper,
           CAST(count_if(v < lower OR v > upper) AS BIGINT) AS outliers
    FROM f JOIN long USING ("column") GROUP BY ALL
    """,
)
def w7_iqr(spark, sf):
    return W.iqr_outliers(load(spark, sf, "lineitem"), list(_LI))


_W8_SQL = """
WITH b AS (SELECT l_returnflag, CAST(date_trunc('week', CASE WHEN l_shipdate > date_trunc('day', l_shipdate)
                THEN date_trunc('day', l_shipdate) + INTERVAL 1 DAY ELSE date_trunc('day', l_shipdate) END) AS DATE) + 6 AS period,
                avg(l_quantity) AS y
           FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1, 2),
span AS (SELECT l_returnflag, min(period) AS lo, max(period) AS hi FROM b GROUP BY 1),
cal AS (SELECT l_returnflag, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS period FROM span),
f AS (SELECT cal.l_returnflag, cal.period, b.y, row_number() OVER (PARTITION BY cal.l_returnflag ORDER BY cal.period) AS i
      FROM cal LEFT JOIN b ON cal.l_returnflag IS NOT DISTINCT FROM b.l_returnflag AND cal.period = b.period),
g AS (SELECT *, last_value(y IGNORE NULLS) OVER w1 AS py, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER w1 AS pi,
             first_value(y IGNORE NULLS) OVER w2 AS ny, first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER w2 AS ni
      FROM f WINDOW w1 AS (PARTITION BY l_returnflag ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    w2 AS (PARTITION BY l_returnflag ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT l_returnflag, period,
       round(CASE WHEN y IS NOT NULL THEN y WHEN ny IS NULL THEN py ELSE py + (ny - py) * (i - pi) / (ni - pi) END, 4) AS value,
       y IS NULL AS interpolated
FROM g
"""


@register("w8_resample_weekly", _W8_SQL)
def w8_resample(spark, sf):
    r = W.resample(load(spark, sf, "lineitem"), "l_shipdate", "l_quantity", freq="W", keys=["l_returnflag"])
    return r.select("l_returnflag", "period", F.round("value", 4).alias("value"), "interpolated")


M12_SQL = """
WITH b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, avg(o_totalprice) AS y FROM orders
           WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1),
span AS (SELECT min(period) AS lo, max(period) AS hi FROM b),
cal AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS period FROM span),
f AS (SELECT cal.period, b.y, row_number() OVER (ORDER BY cal.period) AS i FROM cal LEFT JOIN b USING (period)),
g AS (SELECT *, last_value(y IGNORE NULLS) OVER w1 AS py, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER w1 AS pi,
             first_value(y IGNORE NULLS) OVER w2 AS ny, first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER w2 AS ni
      FROM f WINDOW w1 AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    w2 AS (ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT period, CAST(i - 1 AS DOUBLE) AS t,
             CASE WHEN y IS NOT NULL THEN y WHEN ny IS NULL THEN py ELSE py + (ny - py) * (i - pi) / (ni - pi) END AS value FROM g),
fit AS (SELECT count(*) AS n, regr_slope(value, t) AS b, regr_intercept(value, t) AS a, max(period) AS last FROM s),
ok AS (SELECT count(*) AS rows FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
sd AS (SELECT stddev_pop(value - (a + b * t)) AS sd FROM s, fit)
SELECT period, round(value, 2) AS value, CAST(NULL AS DOUBLE) AS lower_95, CAST(NULL AS DOUBLE) AS upper_95, 'historical' AS kind
FROM s, fit, ok WHERE n >= 3 AND rows >= 5
UNION ALL
SELECT CAST(last + h * INTERVAL 1 MONTH AS DATE) AS period, round(a + b * (n - 1 + h), 2), round(a + b * (n - 1 + h) - 1.96 * sd, 2),
       round(a + b * (n - 1 + h) + 1.96 * sd, 2), 'forecast'
FROM fit, sd, ok, range(1, 13) r(h) WHERE n >= 3 AND rows >= 5
"""


@register("m12_forecast_linear", M12_SQL)
def m12_forecast(spark, sf):
    return FC.forecast_linear(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", periods=12)


@register("m13_forecast_holt")
def m13_holt(spark, sf):
    return FC.forecast_holt(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", periods=12, keys=["o_orderstatus"])
