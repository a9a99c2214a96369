"""Forests as one table of nodes: intervals and partial dependence against
Spark's own trees, and a run of every registered query without a SQL twin."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tabulark.operators import ml as M
from tabulark.operators.forest import node_table, tree_values

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), ("red", "green", "blue", None)[k], float(3 * x + 10 * k + rng.normal()), ("lo", "mid", "hi")[min(int(x) // 4, 2)], k % 2 == 0)
            for x, k in zip(rng.integers(0, 12, 240).tolist(), rng.integers(0, 4, 240).tolist(), strict=True)]
    return spark.createDataFrame(rows, "x double, colour string, y double, band string, even boolean")


def exploded(model, df, feature, values):
    """Partial dependence the long way: every row once per value."""
    base = M.prepare(model, df).withColumn("v", F.explode(F.array(*[F.lit(v) for v in values]))).withColumn(feature, F.col("v"))
    y = F.col("prediction") if model.task == "regression" or len(model.labels) != 2 else vector_to_array("probability")[1]
    rows = model.pipeline.transform(base).groupBy(F.col("v").cast("string").alias("v")).agg(F.avg(y).alias("m")).collect()
    return {r["v"]: r["m"] for r in rows}


def test_regression_trees_interval_and_dependence(spark, frame):
    model, test = M.train(frame.drop("band", "even"), "y", trees=12)
    scored = model.pipeline.transform(M.prepare(model, test)).select(vector_to_array("features").alias("f"), "prediction").collect()
    nodes = node_table(model.forest, spark)
    x = np.array([r["f"] for r in scored])
    y = tree_values(nodes, x)[:, :, 0]
    assert y.shape == (len(scored), 12)
    assert np.allclose(y.mean(axis=1), [r["prediction"] for r in scored], rtol=1e-12)
    by_tree = np.stack([[t.predict(v) for v in test_vectors(x)] for t in model.forest.trees], axis=1)
    assert np.allclose(y, by_tree, rtol=1e-12)

    got = M.score_with_interval(model, test)
    assert got.columns == ["x", "colour", "y", "prediction", "lower", "upper"] and got.count() == test.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("UDF(") <= 6
    want = sorted(zip(y.mean(axis=1).round(4), 1.645 * y.std(axis=1), strict=True))
    have = sorted((r["prediction"], (r["upper"] - r["lower"]) / 2) for r in got.collect())
    assert np.allclose(have, want, atol=2e-4)

    for feature, values in (("x", [0.0, 3.0, 5.0, 8.0, 11.0]), ("colour", ["blue", "green", "red"])):
        pd_ = {r["value"]: r for r in M.partial_dependence(model, frame, feature, grid=5).collect()}
        long = exploded(model, frame, feature, [float(v) for v in pd_] if feature == "x" else values)
        assert set(pd_) == set(long) and all(r["rows"] == 240 for r in pd_.values())
        assert all(abs(pd_[v]["mean_prediction"] - m) < 1e-4 for v, m in long.items())
    assert M.leading_features(model, 2) == ["colour", "x"]
    assert {r["feature"] for r in M.leading_dependence(model, frame, grid=3).collect()} == {"x", "colour"}


def test_vectors(x):
    from pyspark.ml.linalg import Vectors

    return [Vectors.dense(v) for v in x]


test_vectors.__test__ = False


@pytest.mark.parametrize("target", ["even", "band"])
def test_class_dependence(spark, frame, target):
    df = frame.select("x", "y", target).withColumn(target, F.col(target).cast("string"))
    model, _ = M.train(df, target, trees=7)
    got = {r["value"]: r["mean_prediction"] for r in M.partial_dependence(model, df, "x", grid=4).collect()}
    long = exploded(model, df, "x", [float(v) for v in got])
    assert got and all(abs(got[v] - m) < 1e-4 for v, m in long.items())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("key", sorted(k for k in queries() if k not in oracle_sql() and not k.startswith("op") and k != "pipeline"))
def test_query_without_sql_runs(spark, key, monkeypatch):
    from tabulark.plans import queries_more

    monkeypatch.setattr(queries_more, "TREES", 5)
    rows = queries()[key](spark, SF).collect()
    assert rows and len({len(r) for r in rows}) == 1


def rows_to_train(spark, n=400):
    return spark.range(n).selectExpr("cast(id * 37 % 101 as double) AS x", "cast(id * 53 % 29 as double) AS z", "cast(id * 37 % 101 > 50 as string) AS y", "id * 37 % 101 * 2.5D AS v").coalesce(1)


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    seen, was = [], M.Pipeline.fit

    def fit(self, rows, *more):
        seen.append(rows.rdd.getNumPartitions())
        return was(self, rows, *more)

    monkeypatch.setattr(M.Pipeline, "fit", fit)
    monkeypatch.setattr(M, "TASK_ROWS", 40)
    _, test = M.train(rows_to_train(spark).drop("y"), "v", trees=2, max_depth=2)
    # 300 rows to train on, 100 held out
    assert seen == [8] and test.rdd.getNumPartitions() >= 3 and test.count() == 100


def test_training_and_evaluation_evaluate_their_input_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(v):
        calls.add(1)
        return v

    once = F.udf(counted, "double")
    df = rows_to_train(spark).drop("v").withColumn("x", once("x"))
    model, _ = M.train(df, "y", trees=2, max_depth=3)
    assert calls.value == 400
    got = M.evaluate(model, df).first()
    assert calls.value == 800
    hit = M.score(model, rows_to_train(spark).drop("v")).select(F.avg((F.col("y") == F.col("predicted")).cast("double")), F.count(F.lit(1))).first()
    assert (got["accuracy"], got["rows"]) == (round(hit[0], 4), hit[1])
