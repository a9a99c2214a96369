import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulark.functions.ordering import exact_quantiles, top_k_per_group, with_positions, with_running_sum
from tabulark.operators import aggregate as A
from tabulark.operators import relate as R


def hr(spark):
    depts = ["Sales", "IT", "HR", "Ops"]
    rows = [(f"E{i:03d}", f"Name{i}", depts[i % 4], 60 + (i * 7) % 40, 40000 + 1000 * i) for i in range(20)]
    return spark.createDataFrame(rows, "EmployeeID string, Name string, Department string, PerformanceScore int, Salary int")


def test_group_count_distinct_and_mean(spark):
    df = hr(spark)
    cd = {r["Department"]: r["value"] for r in A.group_agg(df, "department", "count_distinct", "EmployeeID").collect()}
    assert cd == {"Sales": 5, "IT": 5, "HR": 5, "Ops": 5}
    mean = {r["Department"]: r["value"] for r in A.group_agg(df, "Department", "mean", "Salary").collect()}
    assert mean["Sales"] == pytest.approx(np.mean([40000 + 1000 * i for i in range(0, 20, 4)]))


def test_group_agg_keeps_null_group_and_sums_empty_to_zero(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3), ("b", None)], "k string, v int")
    out = {r["k"]: r["value"] for r in A.group_agg(df, "k", "sum", "v").collect()}
    assert out == {"a": 1, None: 3, "b": 0}
    pct = {r["k"]: r["value"] for r in A.group_agg(df, "k", "percentage").collect()}
    assert pct == {"a": 50.0, None: 25.0, "b": 25.0}


def test_group_median_exact(spark):
    df = spark.createDataFrame([("x", float(v)) for v in [1, 2, 3, 4]] + [("y", 5.0)], "g string, v double")
    med = {r["g"]: r["value"] for r in A.group_agg(df, "g", "median", "v").collect()}
    assert med == {"x": 2.5, "y": 5.0}


def test_scalar_count_counts_all_rows(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert A.scalar_agg(df, "count", "v").first()[0] == 3
    assert A.scalar_agg(df, "count_non_null", "v").first()[0] == 2
    assert A.scalar_agg(df, "unknown_op", "v").first()[0] == 4.0
    assert A.scalar_agg(df, "mean", "v").first()[0] == 2.0


def test_exact_quantiles_match_numpy_with_hot_value(spark):
    rnd = random.Random(7)
    vals = [rnd.gauss(0, 1) for _ in range(3000)] + [0.5] * 2000  # one value holds 40% of rows
    groups = [("a" if i % 3 else "b", v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(groups, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, ["v"], probs, by=["g"]).collect()}
    for g in ("a", "b"):
        arr = np.array([v for gg, v in groups if gg == g])
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.quantile(arr, p)), abs=1e-12)


def test_positions_and_running_sum_are_global(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit(1).alias("one"))
    pos = with_positions(df, ["k"], name="pos").collect()
    assert sorted(r["pos"] for r in pos) == list(range(1, 5001))
    assert all(r["pos"] == r["k"] + 1 for r in pos)
    run = with_running_sum(df, ["k"], "one", name="cum").collect()
    assert all(r["cum"] == r["k"] + 1 for r in run)


def test_top_k_per_group_two_rounds(spark):
    df = spark.range(0, 2000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    top = top_k_per_group(df, ["g"], [F.col("v").desc()], 3, rank_name="r").collect()
    got = sorted((r["g"], r["v"]) for r in top)
    assert got == [(0, 1994), (0, 1996), (0, 1998), (1, 1995), (1, 1997), (1, 1999)]


def test_duplicates_missing_zero(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "a", 5.0), (2, None, float("nan")), (3, "b", 0.0)], "id int, c string, v double")
    d = A.duplicate_count(df).first()
    assert (d["rows"], d["duplicates"]) == (4, 1)
    miss = {r["column"]: r["missing"] for r in A.missing_report(df).collect()}
    assert miss == {"id": 0, "c": 1, "v": 1}
    z = {r["column"]: (r["zeros"], r["suspicious"]) for r in A.zero_report(df).collect()}
    assert z["v"] == (1, False)


def test_histogram_edges_and_constant_column(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    h = {r["bin"]: r["count"] for r in A.histogram(df, "x", bins=3).collect()}
    assert sum(h.values()) == 10 and h[2] == 4  # last bin closed
    c = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert A.histogram(c, "x", bins=5).collect()[0]["count"] == 2


def test_correlation_constant_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.1, 7.0), (3.0, 5.9, 7.0)], "a double, b double, c double")
    out = {(r["left"], r["right"]): r["corr"] for r in R.correlation(df).collect()}
    assert out[("a", "c")] is None
    assert out[("a", "b")] == pytest.approx(0.999, abs=1e-3)


def test_moments_bias_corrected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (9.0,)], "x double")
    m = R.moments(df).first()
    assert m["skewness"] == pytest.approx(1.8217, abs=1e-4)
    assert m["kurtosis"] == pytest.approx(3.4651, abs=1e-4)


def test_mean_difference_two_groups_welch(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", float(v)) for v in (5, 6, 8, 9)], "g string, x double")
    r = A.mean_difference_test(df, "g", "x").first()
    a, b = np.array([1, 2, 3, 4.0]), np.array([5, 6, 8, 9.0])
    t = (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 4 + b.var(ddof=1) / 4)
    assert r["test"] == "welch_t" and r["statistic"] == pytest.approx(round(t, 4))


def test_empty_and_dotted_names(spark):
    df = spark.createDataFrame([], "`user.name` string, `unit price` double")
    assert A.shape(df).first()["rows"] == 0
    one = spark.createDataFrame([("ann", 2.0)], "`user.name` string, `unit price` double")
    out = A.group_agg(one, "user.name", "sum", "unit price").collect()
    assert out[0]["value"] == 2.0
