import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulark.operators import forecast as FC
from tabulark.operators import ml as M
from tabulark.operators import windows as W


def daily_series(spark, n=30):
    rnd = random.Random(1)
    start = dt.date(2024, 1, 1)
    rows = [((start + dt.timedelta(days=i)).isoformat(), 100 + 3.0 * i + rnd.uniform(-2, 2)) for i in range(n)]
    return spark.createDataFrame(rows, "date string, sales double")


def test_forecast_linear_upward(spark):
    fc = FC.forecast_linear(daily_series(spark), "date", "sales", periods=7)
    f = fc.where("kind = 'forecast'").orderBy("period").collect()
    assert len(f) == 7 and all(r["lower_95"] <= r["value"] <= r["upper_95"] for r in f)
    assert f[0]["period"] == dt.date(2024, 1, 31)
    m = FC.forecast_metrics(fc).first()
    assert m["trend_direction"] == "upward"


def test_forecast_holt_shape(spark):
    fc = FC.forecast_holt(daily_series(spark), "date", "sales", periods=5)
    assert fc.where("kind = 'forecast'").count() == 5 and fc.where("kind = 'historical'").count() == 30


def test_resample_interpolates_gaps_and_weeks(spark):
    rows = [("2024-01-01", 1.0), ("2024-01-04", 4.0), ("2024-01-05", 5.0)]
    df = spark.createDataFrame(rows, "d string, v double")
    r = {x["period"]: (x["value"], x["interpolated"]) for x in W.resample(df, "d", "v", freq="D").collect()}
    assert r[dt.date(2024, 1, 2)] == (pytest.approx(2.0), True) and r[dt.date(2024, 1, 3)] == (pytest.approx(3.0), True)
    # pandas W: (Sunday, Sunday] bins labelled by the closing Sunday
    wk = spark.createDataFrame([("2024-01-07 00:00:00", 1.0), ("2024-01-07 10:00:00", 3.0)], "d string, v double")
    labels = sorted(x["period"] for x in W.resample(wk, "d", "v", freq="W").collect())
    assert labels == [dt.date(2024, 1, 7), dt.date(2024, 1, 14)]


def test_trend_and_growth(spark):
    df = daily_series(spark)
    t = W.trend(df, "date", "sales").first()
    assert t["direction"] == "increased" and t["periods"] == 30
    g = W.period_growth(df, "date", "sales", grain="week").orderBy("period").collect()
    assert g[0]["previous"] is None and g[1]["growth_pct"] is not None


def test_zscore_and_iqr(spark):
    df = spark.createDataFrame([(float(v),) for v in [10, 11, 9, 10, 12, 10, 11, 9, 100]], "x double")
    assert [r["x"] for r in W.zscore_outliers(df, "x").collect()] == [100.0]
    iq = W.iqr_outliers(df, ["x"]).first()
    assert iq["outliers"] == 1
    few = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert W.zscore_outliers(few, "x").count() == 0 and W.iqr_outliers(few, ["x"]).count() == 0


def test_pareto_and_top_bottom(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 15.0), ("d", 5.0)], "k string, v double")
    assert [r["label"] for r in W.pareto(df, "k", "v").orderBy(F.desc("total")).collect()] == ["a", "b"]
    tb = {(r["side"], r["rank"]): r["label"] for r in W.top_bottom(df, "k", "v", k=1).collect()}
    assert tb == {("top", 1): "a", ("bottom", 1): "d"}


def classify_frame(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        x1, x2 = rnd.uniform(0, 10), rnd.uniform(0, 10)
        grp = "g1" if i % 2 else "g2"
        rows.append((x1, x2, grp, int(x1 + x2 > 10)))
    return spark.createDataFrame(rows, "x1 double, x2 double, group string, target int")


def test_classifier_and_scoring(spark):
    df = classify_frame(spark)
    task = M.model_task(df, "target").first()
    assert task["task"] == "classification" and task["classes"] == 2
    model, test = M.train(df, "target", trees=20)
    assert model.task == "classification" and set(model.numeric) == {"x1", "x2"} and model.categorical == ["group"]
    ev = M.evaluate(model, test).first()
    assert ev["accuracy"] > 0.6
    scored = M.score(model, df).select("predicted", "confidence").collect()
    assert len(scored) == 120 and all(0.0 <= r["confidence"] <= 1.0 for r in scored)
    imp = M.importances(model).collect()
    assert imp[0]["feature"] in ("x1", "x2")
    pi = {r["feature"]: r["importance_mean"] for r in M.permutation_importance(model, test, repeats=2).collect()}
    assert set(pi) == {"x1", "x2", "group"}


def test_regressor_interval_and_scenario(spark):
    rnd = random.Random(5)
    rows = [(x, 3 * x + 10 + rnd.uniform(-1, 1)) for x in [rnd.uniform(0, 20) for _ in range(120)]]
    df = spark.createDataFrame(rows, "x double, y double")
    model, test = M.train(df, "y", trees=15)
    assert model.task == "regression"
    iv = M.score_with_interval(model, df).collect()
    assert all(r["lower"] <= r["prediction"] <= r["upper"] for r in iv)
    sc = M.scenario(model, df, [("x", "delta", 5)]).collect()
    assert len(sc) == 120 and sum(r["delta"] > 0 for r in sc) > 60
    pd_ = M.partial_dependence(model, df, "x", grid=5).collect()
    assert len(pd_) == 5
    with pytest.raises(ValueError):
        M.train(df.limit(10), "y")


def test_holt_weights_are_least_squares():
    """Never above the starting grid, and as good as a fine search."""
    fine = [x.ravel() for x in np.meshgrid(np.linspace(0, 1, 101), np.linspace(0, 1, 101), indexing="ij")]
    coarse = [x.ravel() for x in np.meshgrid(FC._GRID, FC._GRID, indexing="ij")]
    rng = np.random.default_rng(11)
    for i in range(50):
        t = np.arange(12 + i)
        kind = i % 5
        y = 100 + (3 * t if kind else 0) + rng.normal(0, 1 + 4 * kind, len(t)).cumsum() + rng.normal(0, 5, len(t))
        a, b, level, trend, sse = FC._holt_fit(y)
        assert 0 <= a <= 1 and 0 <= b <= 1
        assert sse <= FC._holt_run(y, *coarse)[2].min()
        lv, tr, errors, _, _ = FC._holt_run(y, *fine)
        k = errors.argmin()
        assert sse <= errors[k] * (1 + 1e-9)
        # where the fine search is at the same weights, the forecasts agree
        if abs(a - fine[0][k]) < 0.01 and abs(b - fine[1][k]) < 0.01:
            assert level + trend == pytest.approx(lv[k] + tr[k], rel=0.01)
        np.testing.assert_allclose(((y - FC._holt_fitted(y, a, b)) ** 2).sum(), sse)


def test_holt_gradient():
    rng = np.random.default_rng(12)
    y, a, b, h = rng.normal(50, 9, 30), np.array([0.3, 0.8]), np.array([0.2, 0.6]), 1e-6
    grad = FC._holt_run(y, a, b)[3]
    assert grad[0] == pytest.approx((FC._holt_run(y, a + h, b)[2] - FC._holt_run(y, a - h, b)[2]) / (2 * h), rel=1e-5)
    assert grad[1] == pytest.approx((FC._holt_run(y, a, b + h)[2] - FC._holt_run(y, a, b - h)[2]) / (2 * h), rel=1e-5)


def test_holt_of_constant_and_linear_series():
    for y in (np.full(5, 3.0), np.arange(6.0)):
        _, _, level, trend, sse = FC._holt_fit(y)
        assert sse == pytest.approx(0) and level + trend == pytest.approx(2 * y[-1] - y[-2])
