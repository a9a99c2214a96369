"""Co-moments of column pairs and quantiles by refining histograms against
numpy on frames that are far from zero, clustered, constant or incomplete."""

import numpy as np
import pandas as pd
import pytest

from tabulark.functions.comoments import _state, merge, pair_moments
from tabulark.functions.ordering import exact_quantiles, nth_row, with_positions
from tabulark.operators import relate as R


def complete(frame, a, b):
    both = frame[[a, b]].dropna() if a != b else frame[[a]].dropna()
    return both[a].to_numpy(), both[b].to_numpy()


def test_forty_columns_with_their_own_nulls(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(700, 4))
    frame = pd.DataFrame({f"c.{i}": base[:, i % 4] * (i + 1) + rng.normal(size=700) + 10.0 ** (i % 9) for i in range(38)})
    frame = frame.mask(rng.random(frame.shape) < 0.1)
    frame["flat"], frame["none"] = 0.1, np.nan
    df = spark.createDataFrame(frame).repartition(7)
    got = {(r["left"], r["right"]): r for r in R.correlation(df, digits=9).collect()}
    cov = {(r["left"], r["right"]): r["cov"] for r in R.covariance(df, digits=6).collect()}
    assert len(got) == 40 * 39 // 2 and len(cov) == 40 * 41 // 2
    for (a, b), r in got.items():
        x, y = complete(frame, a, b)
        assert r["n"] == len(x)
        if "flat" in (a, b) or "none" in (a, b):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-7)
    for (a, b), c in cov.items():
        x, y = complete(frame, a, b)
        assert c is None if "none" in (a, b) else c == pytest.approx(np.cov(x, y)[0, 1], rel=1e-6, abs=2e-6)


def test_far_from_zero_and_few_rows(spark):
    x = 1e9 + np.arange(50) % 7
    frame = pd.DataFrame({"a": x, "b": -2 * x, "c": np.arange(50.0)})
    df = spark.createDataFrame(frame).repartition(9)
    got = {(r["left"], r["right"]): r["corr"] for r in R.correlation(df, digits=6).collect()}
    assert got["a", "b"] == -1 and got["a", "c"] == pytest.approx(np.corrcoef(x - 1e9, np.arange(50))[0, 1], abs=1e-6)
    one = df.limit(1)
    assert [tuple(r)[2:] for r in R.correlation(one).collect()] == [(None, 1)] * 3
    assert [r["n"] for r in R.correlation(df.where("false")).collect()] == [0] * 3
    assert {r["feature"] for r in R.correlate_with(df, "C").collect()} == {"a", "b"}


def test_states_merge_in_any_grouping():
    rng = np.random.default_rng(2)
    x = np.where(rng.random((90, 3)) < 0.3, np.nan, rng.normal(1e6, 1, (90, 3)))
    cols = [0, 1, 2]
    whole = _state(x, cols, cols)
    parts = [_state(p, cols, cols) for p in np.array_split(x, 8)] + [_state(np.full((2, 3), np.nan), cols, cols)]
    left = parts[0]
    for p in parts[1:]:
        left = merge(left, p)
    right = merge(merge(parts[8], parts[7]), merge(merge(parts[0], parts[1]), merge(merge(parts[2], parts[3]), merge(parts[4], merge(parts[5], parts[6])))))
    assert np.allclose(left, whole, rtol=1e-9) and np.allclose(right, whole, rtol=1e-9)


def test_pairs_of_two_sides(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 7.0, 5.0)], "a double, b double, c double")
    got = pair_moments(df, ["a", "b"], ["c"], [("a", "c"), ("b", "c")]).collect()
    assert [(r["left"], r["n"], r["m2_left"], r["m2_right"], r["c"]) for r in got] == [("a", 2, 0.5, 8.0, 2.0), ("b", 2, 4.5, 8.0, 6.0)]


@pytest.mark.parametrize("limit", [16, 1 << 16])
def test_quantiles_of_clusters_at_many_scales(spark, limit):
    rng = np.random.default_rng(0)
    v = np.concatenate([
        1e9 + rng.normal(size=600) * 10.0 ** -rng.integers(0, 7, 600),
        rng.normal(size=100) * 1e-300,
        -(10.0 ** rng.uniform(-300, 300, 400)),
        np.full(900, 7.25),
        [np.inf, -np.inf, 0.0, -0.0, 1.7e308, -1.7e308],
    ])
    g = rng.integers(0, 3, len(v))
    frame = pd.DataFrame({"g": [None if x == 2 else str(x) for x in g], "v": v, "w": v[::-1].copy()})
    probs = [0, 0.1, 0.25, 0.5, 0.77, 1.0]
    rows = exact_quantiles(spark.createDataFrame(frame).repartition(4), ["v", "w"], probs, by=["g"], limit=limit).collect()
    got = {(r["g"], r["column"], r["p"]): r["value"] for r in rows}
    assert len(got) == len(rows) == 3 * 2 * len(probs)
    for k in ("0", "1", None):
        for c, values in (("v", v), ("w", v[::-1])):
            a = np.sort(values[g == (2 if k is None else int(k))])
            for p in probs:
                h = p * (len(a) - 1)
                lo, hi = a[int(np.floor(h))], a[int(np.ceil(h))]
                want = lo if lo == hi else lo + (hi - lo) * (h - np.floor(h))
                assert got[k, c, p] == pytest.approx(want, rel=1e-12)


def test_quantile_plan_has_no_exchange_by_value(spark):
    import contextlib
    import io

    df = spark.range(3000).selectExpr("id % 3 AS g", "cast(id * id % 1009 AS double) AS v")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        exact_quantiles(df, ["v"], [0.5], by=["g"]).explain("simple")
    exchanges = [line for line in out.getvalue().splitlines() if "hashpartitioning" in line]
    assert exchanges and not any("v#" in line.split("hashpartitioning")[1].split("ENSURE")[0] for line in exchanges)
    assert "rangepartitioning" not in out.getvalue()


def test_nth_row_by_counting(spark):
    """Every rank of a frame with nulls, a hot key, exact copies and a map."""
    rows = [(None if i % 11 == 0 else i % 7, f"s{i % 13}" if i % 5 else None, {"a": i % 3}) for i in range(120)] + [(3, "hot", {"a": 1})] * 80
    df = spark.createDataFrame(rows, "x int, s string, m map<string,int>").repartition(4).cache()
    order = sorted(((r["x"] is not None, r["x"] or 0, r["s"] is not None, r["s"] or "") for r in df.collect()))
    for n in (1, 2, 17, 60, 100, 130, 180, 200):
        got = nth_row(df, n, ["x", "s"], splits=4, small=8).collect()
        assert [(r["x"] is not None, r["x"] or 0, r["s"] is not None, r["s"] or "") for r in got] == [order[n - 1]]
    whole = [tuple(sorted(nth_row(df, n, ["x"], splits=4, small=8).first()["m"].items())) for n in range(60, 64)]
    assert whole == [tuple(sorted(nth_row(df, n, ["x"]).first()["m"].items())) for n in range(60, 64)]
    assert nth_row(df, 0, ["x"]).count() == nth_row(df, 201, ["x"]).count() == nth_row(df.where("false"), 1, ["x"]).count() == 0


def test_positions_of_rows_with_maps(spark):
    df = spark.createDataFrame([(i % 3, {"a": i}) for i in range(30)], "x int, m map<string,int>")
    got = sorted((r["p"], r["x"]) for r in with_positions(df, ["x"], name="p").collect())
    assert got == [(i + 1, i // 10) for i in range(30)]
