"""Inputs that clean test tables hide: NaN, copies, large offsets, constant
columns, quotes and line breaks in text, unknown targets."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tabulark.operators import aggregate as A
from tabulark.operators import filters as FL
from tabulark.operators import ml as M
from tabulark.operators import quality as Q
from tabulark.operators import relate as R
from tabulark.operators import rows as T
from tabulark.operators import windows as W
from tabulark.operators.contract import is_blank
from tabulark.sources import io


@pytest.fixture(scope="module")
def nan_rows(spark):
    rows = [("a", 1.0, 2.0), ("a", float("nan"), 5.0), ("b", 3.0, 6.0), ("b", 4.0, 8.5), ("b", None, 1.0)]
    return spark.createDataFrame(rows, "g string, x double, y double")


def one(df):
    return df.collect()[0].asDict()


def test_nan_is_missing(spark, nan_rows):
    got = {r["g"]: r["value"] for r in A.group_agg(nan_rows, "g", "sum", "x").collect()}
    assert got == {"a": 1.0, "b": 7.0}
    assert one(A.scalar_agg(nan_rows, "max", "x"))["x"] == 4.0 and one(A.scalar_agg(nan_rows, "mean", "x"))["x"] == 2.6667
    assert one(T.extreme(nan_rows, "x"))["value"] == 4.0 and one(T.extreme(nan_rows, "x"))["non_null"] == 3
    assert one(T.top_rows(nan_rows, "x", 1))["x"] == 4.0
    assert [r["x"] for r in T.sort_rows(nan_rows, "x", "desc").collect()][:3] == [4.0, 3.0, 1.0]
    assert one(FL.support(nan_rows, ["x"]))["complete_rows"] == FL.complete_cases(nan_rows, ["x"]).count() == 3
    corr = R.correlate_with(nan_rows, "x").collect()
    assert corr and all(not math.isnan(r["corr"]) for r in corr)
    filled, _ = Q.clean(nan_rows, ["fill_numeric_median"])
    assert sorted(r["x"] for r in filled.collect()) == [1.0, 3.0, 3.0, 3.0, 4.0]
    nothing = spark.createDataFrame([(float("nan"), 1), (None, 2)], "e double, k int")
    assert Q.clean(nothing, ["drop_empty_columns"])[0].columns == ["k"]
    assert FL.apply_filters(nan_rows, [("x", ">", 0)]).count() == 3
    text = spark.createDataFrame([("nan",), ("1.5",), ("x",)], "t string")
    assert [r["t"] for r in FL.coerce_numbers(text, ["t"]).collect()] == [None, 1.5, None]


def test_nan_is_null_on_read(spark, nan_rows, tmpdir_path):
    path = os.path.join(tmpdir_path, "p")
    nan_rows.write.parquet(path)
    assert io.read_parquet(spark, path).where("x is null").count() == 2


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_anova_far_from_zero(spark, shift):
    rows = [(g, shift + v) for g, vs in (("a", (1, 2, 3)), ("b", (4, 5, 7)), ("c", (9, 9, 12))) for v in vs]
    got = one(A.mean_difference_test(spark.createDataFrame(rows, "g string, x double"), "g", "x"))
    assert abs(got["statistic"] - 22.9474) < 0.01 and got["test"] == "anova_f"


def test_r2_far_from_zero_and_constant(spark):
    for shift in (0.0, 1e9):
        rows = [(shift + y, shift + y + e) for y, e in ((1, 0.5), (2, -0.5), (4, 0.5), (8, -0.5))]
        df = spark.createDataFrame(rows, "y double, p double")
        assert abs(one(df.agg(M._r2(F.col("y"), F.col("p")).alias("r2")))["r2"] - (1 - 1 / 28.75)) < 1e-6
    assert one(spark.createDataFrame([(1.0, 2.0)] * 3, "y double, p double").agg(M._r2(F.col("y"), F.col("p")).alias("r2")))["r2"] is None


def test_zscore_of_a_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert W.zscore_summary(df, "x").count() == 0 and W.zscore_outliers(df, "x").count() == 0


def test_histogram_lists_empty_bins(spark):
    df = spark.createDataFrame([(0.0, "a"), (1.0, "a"), (10.0, "b")], "x double, g string")
    assert [(r["bin"], r["count"]) for r in A.histogram(df, "x", 5).orderBy("bin").collect()] == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 1)]
    assert A.histogram(df, "x", 5, by="g").count() == 10 and A.histogram(df.where("false"), "x", 5).count() == 0


def test_quotes_and_line_breaks_survive_csv(spark, tmpdir_path):
    rows = [('say "hi", x', 1), ("two\nlines", 2), ("plain", 3)]
    path = os.path.join(tmpdir_path, "c")
    io.write_csv(spark.createDataFrame(rows, "t string, n int"), path)
    back = io.read_csv(spark, path, multi_line=True)
    assert sorted((r["t"], r["n"]) for r in back.collect()) == sorted(rows)


def test_blank_means_any_white_space(spark):
    df = spark.createDataFrame([("\t",), ("   ",), ("",), (None,), ("a\t",)], "t string")
    assert [r[0] for r in df.select(is_blank(F.col("t"))).collect()] == [True, True, True, True, False]
    assert [r["t"] for r in Q.clean(df, ["trim_string_whitespace"])[0].collect()] == ["", "", "", None, "a"]


@pytest.mark.parametrize(("op", "value", "want"), [(">", 10, 2), (">", 10.5, 2), (">=", 10, 3), ("<", 9.5, 1), ("<=", "10", 2), (">", 1e30, 0), ("<", 1e30, 4)])
def test_filters_compare_in_the_columns_own_type(spark, op, value, want):
    df = spark.createDataFrame([(9,), (10,), (11,), (2**53 + 1,)], "k long")
    out = FL.apply_filters(df, [("k", op, value)])
    assert out.count() == want and "cast(k" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_lookup_is_pushed_to_the_scan(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "l")
    spark.range(100).withColumnRenamed("id", "k").write.parquet(path)
    hit = T.lookup(spark.read.parquet(path), "k", " 42 ")
    assert [r["k"] for r in hit.collect()] == [42] and "EqualTo(k,42)" in hit._jdf.queryExecution().executedPlan().toString()
    assert T.lookup(spark.read.parquet(path), "k", "4.5").count() == T.lookup(spark.read.parquet(path), "k", "x").count() == 0


@pytest.fixture(scope="module")
def copies(spark):
    """200 rows with 20 different values, ids that only look like ids."""
    rows = [(i % 20, float(i % 20) * 2 + 1, "red" if i % 4 else "blue", "yes" if i % 20 > 11 else "no") for i in range(200)]
    return spark.createDataFrame(rows, "paid int, x double, colour string, label string")


def test_classes_split_exactly_and_names_stay(spark, copies):
    num, cat = M.select_features(copies, "label")
    assert num == ["paid", "x"] and cat == ["colour"]
    tr, te = M.split(copies, "label")
    assert {r["label"]: r["count"] for r in tr.groupBy("label").count().collect()} == {"yes": 60, "no": 90}
    assert te.count() == 50 and sorted(map(str, tr.unionAll(te).collect())) == sorted(map(str, copies.collect()))


def test_scoring_without_a_target_and_scenarios_row_by_row(spark, copies):
    model, test = M.train(copies, "label", trees=10)
    unknown = copies.withColumn("label", F.lit(None).cast("string"))
    scored = M.score(model, unknown).collect()
    assert len(scored) == 200 and {r["predicted"] for r in scored} == {"yes", "no"}
    assert one(M.evaluate(model, test.unionByName(test.withColumn("label", F.lit("never seen")))))["rows"] == test.count()
    out = M.scenario(model, copies, [("paid", "set", 19), ("x", "delta", 100)])
    assert out.count() == 200 and out.columns == [*copies.columns, "before", "after", "label_changed"]
    assert {r["after"] for r in out.collect()} == {"yes"}
    imp = {r["feature"]: r["importance_mean"] for r in M.permutation_importance(model, copies, repeats=2).collect()}
    assert set(imp) == {"paid", "x", "colour"} and max(imp["paid"], imp["x"]) > 0.05


def test_quality_rules_do_not_read_their_input_again(spark, copies, tmpdir_path):
    path = os.path.join(tmpdir_path, "q")
    copies.write.parquet(path)
    df = spark.read.parquet(path)
    plan = Q.quality_score(df, Q.quality_facts(df))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan
