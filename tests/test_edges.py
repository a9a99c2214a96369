"""Edge frames: empty, one row, all-null column, constant column, only
duplicates, NaN beside null, null join keys, names with dots and spaces."""

from tabulark.operators import aggregate as A
from tabulark.operators import contract as C
from tabulark.operators import joins as J
from tabulark.operators import quality as Q
from tabulark.operators import relate as R
from tabulark.operators import windows as W
from tabulark.functions.ordering import exact_quantiles


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert A.group_agg(df, "k", "sum", "v").count() == 0
    assert A.duplicate_count(df).first()["duplicates"] == 0
    assert exact_quantiles(df, ["v"], [0.5]).count() == 0
    p = Q.profile(df).first()
    assert (p["rows"], p["missing_total"], p["missing_pct"]) == (0, 0, 0.0)


def test_one_row(spark):
    df = spark.createDataFrame([("a", 3.0)], "k string, v double")
    assert A.scalar_agg(df, "median", "v").first()[0] == 3.0
    d = Q.drift(df, df).first()
    # null sample std: the denominator falls back to 1e-5, as in the reference
    assert d["drift_score"] == 0.0 and d["drift_level"] == "Low"
    assert W.zscore_outliers(df, "v").count() == 0


def test_all_null_and_constant_columns(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, None, 5.0), (3, None, 5.0)], "id int, empty string, const double")
    types = {r["column"]: r["type"] for r in C.infer_types(df).collect()}
    assert types["empty"] == "string"
    cleaned, _ = Q.clean(df, ["drop_empty_columns"])
    assert "empty" not in cleaned.columns
    m = {r["column"]: r for r in R.moments(df, ["const"]).collect()}
    assert m["const"]["skewness"] is None and m["const"]["cv"] == 0.0
    assert A.histogram(df, "const", bins=4).first()["count"] == 3


def test_only_duplicates(spark):
    df = spark.createDataFrame([(1, "x")] * 5, "a int, b string")
    d = A.duplicate_count(df).first()
    assert (d["rows"], d["duplicates"], d["duplicate_pct"]) == (5, 4, 80.0)
    assert J.distinct_rows(df).count() == 1


def test_nan_beside_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,), (4.0,)], "v double")
    miss = A.missing_report(df).first()
    assert miss["missing"] == 2
    assert exact_quantiles(df, ["v"], [0.5]).first()["value"] == 3.0


def test_null_keys_on_both_sides(spark):
    a = spark.createDataFrame([(None, "l1"), (None, "l2"), (1, "l3")], "k int, x string")
    b = spark.createDataFrame([(None, "r1"), (1, "r2")], "k int, y string")
    assert J.join_tables(a, b, "k", "k").count() == 3  # two null-null pairs + one match
    assert J.join_tables(a, b, "k", "k", how="outer").count() == 3


def test_dotted_and_spaced_names(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 4.1), ("a", 3.0, 5.9)], "`user.name` string, `unit price` double, `x.y z` double")
    g = {r["user.name"]: r["value"] for r in A.group_agg(df, "user.name", "sum", "unit price").collect()}
    assert g == {"a": 4.0, "b": 2.0}
    corr = R.correlation(df).first()
    assert (corr["left"], corr["right"]) == ("unit price", "x.y z")
    assert {r["column"] for r in A.missing_report(df).collect()} == {"user.name", "unit price", "x.y z"}
