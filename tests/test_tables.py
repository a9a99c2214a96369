import pytest
from pyspark.sql import functions as F

from tabulark.operators import contract as C
from tabulark.operators import filters as FL
from tabulark.operators import joins as J
from tabulark.operators import quality as Q
from tabulark.operators import roles as RO
from tabulark.operators import rows as T


def sales(spark):
    rows = [
        ("2024-01-01", "Electronics", "Laptop", "North", 1200, 1),
        ("2024-01-02", "Furniture", "Chair", "South", 150, 3),
        ("2024-01-03", "Electronics", "Phone", "East", 800, 2),
        ("2024-01-04", "Office", "Paper", "West", 20, 10),
    ]
    return spark.createDataFrame(rows, "date string, category string, product string, region string, revenue int, quantity int")


# ---- filters --------------------------------------------------------------------


def test_filters_ne_keeps_nulls_and_contains_is_literal(spark):
    df = spark.createDataFrame([("a.b",), ("A",), (None,), ("xyz",)], "c string")
    assert FL.apply_filters(df, [("c", "!=", "A")]).count() == 3
    assert FL.apply_filters(df, [("C", "contains", "a")]).count() == 2
    assert FL.apply_filters(df, [("c", "contains", ".")]).count() == 1  # literal dot
    assert FL.apply_filters(df, [("c", "contains", "^a", )], regex=True).count() == 2


def test_filters_unknown_column_raise_or_skip(spark):
    df = sales(spark)
    with pytest.raises(KeyError):
        FL.apply_filters(df, [("nope", "==", 1)])
    assert FL.apply_filters(df, [("nope", "==", 1), ("revenue", ">", "100")], on_error="skip").count() == 3


def test_sql_guard(spark):
    df = sales(spark)
    assert FL.sql_select(spark, "SELECT category, sum(revenue) AS t FROM data GROUP BY category", {"data": df}).count() == 3
    assert FL.sql_select(spark, "SELECT replace(category, 'E', 'e') AS c FROM data WHERE revenue > 5000", {"data": df}).count() == 0
    spark.createDataFrame([(1,)], "mine int").createOrReplaceTempView("data")
    bad_ones = (
        "DROP TABLE data", "SELECT 1; SELECT 2", "INSERT INTO data VALUES (1)", "WITH x AS (SELECT 1) DELETE FROM data",
        "SELECT * FROM parquet.`/tmp`", "SELECT * FROM other", "SELECT * FROM data WHERE revenue IN (SELECT x FROM a.b)",
        "WITH q AS (SELECT 1) INSERT INTO data SELECT * FROM q", "SET a = 1", "",
    )
    for bad in bad_ones:
        with pytest.raises(ValueError):
            FL.sql_select(spark, bad, {"data": df})
    # words are no statements, WITH names are fine, the caller's own view stays
    words = df.select(F.col("revenue").alias("load"), F.col("category").alias("set"))
    assert FL.sql_select(spark, "WITH u AS (SELECT load, `set` FROM data) SELECT load FROM u ORDER BY load", {"data": words}).columns == ["load"]
    assert spark.table("data").columns == ["mine"]
    spark.catalog.dropTempView("data")


def test_above_average_and_search(spark):
    df = sales(spark)
    assert [r["product"] for r in FL.above_average(df, "revenue").collect()] == ["Laptop", "Phone"]
    assert FL.search_rows(df, "ELEC").count() == 2


# ---- joins ----------------------------------------------------------------------


def test_join_key_inference_and_join(spark):
    left = spark.createDataFrame([(1, "Ann"), (2, "Bo"), (3, "Cy")], "customer_id int, name string")
    right = spark.createDataFrame([(10, 1, 5), (11, 2, 7), (12, 3, 9)], "order_id int, customer_id int, amount int")
    cand = J.infer_join_keys(left, right).collect()
    top = cand[0]
    assert (top["column_1"], top["column_2"]) == ("customer_id", "customer_id")
    assert top["score"] >= 0.7 and top["confidence_label"] == "High"
    joined = J.join_tables(left, right, "customer_id", "customer_id")
    assert joined.count() == 3 and joined.columns.count("customer_id") == 1


def test_join_disjoint_has_no_candidates(spark):
    a = spark.createDataFrame([("x",), ("y",), ("z",)], "alpha string")
    b = spark.createDataFrame([(1,), (2,), (3,)], "beta int")
    assert J.infer_join_keys(a, b).count() == 0


def test_join_null_keys_match_like_pandas_and_suffixes(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    b = spark.createDataFrame([(None, 3), (1, 4)], "k int, v int")
    assert J.join_tables(a, b, "k", "k").count() == 2
    assert J.join_tables(a, b, "k", "k", null_keys="drop").count() == 1
    assert set(J.join_tables(a, b, "k", "k").columns) == {"k", "v_left", "v_right"}
    with pytest.raises(TypeError):
        J.join_tables(a, spark.createDataFrame([("x",)], "k string"), "k", "k")


# ---- rows -----------------------------------------------------------------------


def test_extreme_rows_ties_and_positions(spark):
    df = spark.createDataFrame([(1, 88, 30.1), (2, 70, 22.0), (3, 88, 25.5)], "PatientID int, BloodPressure int, BMI double")
    r = T.extreme_rows(df, "BloodPressure", "max", ["PatientID"], ["PatientID"]).orderBy("position").collect()
    assert [(x["position"], x["PatientID"], x["tie_count"]) for x in r] == [(1, 1, 2), (3, 3, 2)]
    e = T.extreme(df, "BloodPressure", "max").first()
    assert (e["value"], e["non_null"]) == (88, 3)


def test_lookup_is_not_position(spark):
    df = spark.createDataFrame([(101, "A", 10), (102, "B", 20), (103, "C", 30)], "EmployeeID int, Name string, Salary int")
    assert T.lookup(df, "EmployeeID", "2").count() == 0
    assert T.lookup(df, "EmployeeID", 102).first()["Name"] == "B"
    assert [r["field"] for r in T.row_at(df, 2, ["EmployeeID"]).collect()] == ["EmployeeID", "Name", "Salary"]
    assert T.row_at(df, 9, ["EmployeeID"]).count() == 0


def test_compare_to_median_excludes_ids_and_constants(spark):
    rows = [(i, f"N{i}", 1000 + 10 * i, i % 5, 20 + i % 30, 7) for i in range(50)]
    df = spark.createDataFrame(rows, "EmployeeID int, Name string, Salary int, PerformanceScore int, Age int, Constant int")
    out = T.compare_to_median(df, "EmployeeID", 3).collect()
    fields = {r["field"] for r in out}
    assert len(out) <= 4 and "EmployeeID" not in fields and "Constant" not in fields


# ---- roles, quality, cleaning, contract ---------------------------------------------


def test_roles(spark):
    df = spark.createDataFrame([("2024-01-01", "A", 10, 1), ("2024-01-02", "B", 20, 2)], "date string, category string, revenue int, order_id int")
    roles = {(r["column"], r["role"]) for r in RO.column_roles(df).collect()}
    assert ("date", "time") in roles and ("category", "dimensions") in roles
    assert ("revenue", "metrics") in roles and ("order_id", "ids") in roles


def dirty_quality(spark):
    rows = [(1, "A", 100), (2, "B", 110), (3, "A", None), (4, "B", 105), (4, "B", 105), (5, "A", 98), (6, "B", 102), (7, "A", 10000)]
    return spark.createDataFrame(rows, "order_id int, category string, revenue int")


def test_quality_score_below_100(spark):
    s = Q.quality_score(dirty_quality(spark)).first()
    assert s["score"] < 100
    codes = {r["code"] for r in Q.quality_issues(dirty_quality(spark)).collect()}
    assert {"missing_values", "duplicate_rows"} <= codes


def test_clean_defaults(spark):
    rows = [(7, " oak", 4, None), (8, "elm", None, None), (9, "elm", 12, None), (9, "elm", 12, None)]
    df = spark.createDataFrame(rows, "tree_id int, kind string, height int, note string")
    cleaned, audit = Q.clean(df, ["fill_numeric_median", "trim_string_whitespace", "drop_empty_columns", "remove_duplicate_rows"])
    assert cleaned.count() == 3 and "note" not in cleaned.columns
    vals = {r["tree_id"]: (r["kind"], r["height"]) for r in cleaned.collect()}
    assert vals[7][0] == "oak" and vals[8][1] == 8.0  # median after dedupe: (4, 12)
    assert [r["action"] for r in audit.orderBy("step").collect()][0] == "trim_string_whitespace"
    with pytest.raises(ValueError):
        Q.clean(df, ["explode"])


def test_contract_and_validation(spark):
    base = sales(spark)
    contract = C.infer_contract(base)
    spec = {r["column"]: r for r in contract.collect()}
    assert spec["date"]["type"] == "date" and spec["revenue"]["type"] == "integer"
    assert sorted(spec["category"]["allowed_values"]) == ["Electronics", "Furniture", "Office"]
    new = spark.createDataFrame(
        [
            (0, "2024-02-01", "Office", "Pen", "North", "5", "1", None),
            (1, "not a date", "Garden", "Hose", "East", "abc", "2", "x"),
        ],
        "rid int, date string, category string, product string, region string, revenue string, quantity string, extra string",
    )
    issues = C.validate(new, contract, "rid")
    codes = {(r["row"], r["code"]) for r in issues.collect()}
    assert (1, "type_mismatch") in codes and (1, "unknown_category") in codes and (0, "extra_column") in codes
    summ = C.validation_summary(new, issues, "rid").first()
    assert (summ["valid_rows"], summ["invalid_rows"]) == (1, 1)


def test_drift(spark):
    v1 = spark.createDataFrame([(40, 5), (44, 6), (36, 5), (42, 7), (38, 6)], "weight int, age int")
    v2 = spark.createDataFrame([(70, 5, 1), (74, 6, 1), (66, 5, 1), (72, 7, 1), (68, 6, 1)], "weight int, age int, batch int")
    d = {r["column"]: r for r in Q.drift(v1, v2).collect()}
    assert d["weight"]["mean_delta"] == 30.0 and d["weight"]["drift_level"] == "Significant"
    sch = {r["column"]: r["change"] for r in Q.compare_schemas(v1, v2).collect()}
    assert sch["batch"] == "added"


def test_cleaning_plan_estimate_and_issue_cut(spark):
    rows = [(7, " oak", 4, None), (8, "elm", None, None), (9, "elm", 12, None), (9, "elm", 12, None)]
    df = spark.createDataFrame(rows, "tree_id int, kind string, height int, note string")
    plan = {r["action"]: r for r in Q.cleaning_plan(df).collect()}
    assert plan["fill_categorical_mode"]["default"] is False if "fill_categorical_mode" in plan else True
    assert {"drop_empty_columns", "remove_duplicate_rows", "trim_string_whitespace", "fill_numeric_median"} <= set(plan)
    before = Q.quality_score(df).first()["score"]
    assert next(iter(plan.values()))["estimated_score_after"] >= before
    assert Q.quality_issues(dirty_quality(spark), keep=1).count() == 1


def test_compare_to_median_of_a_repeated_identifier(spark):
    """The same row whatever the order and the partitions."""
    rows = [(1, float(x)) for x in range(20)] + [(2, 5.0), (3, 7.0)]
    seen = set()
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows[::-1] if parts == 3 else rows, "code int, amount double").repartition(parts)
        seen.add(tuple(r["value"] for r in T.compare_to_median(df, "code", 1).collect()))
    assert len(seen) == 1 and seen != {()}
