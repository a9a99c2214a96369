"""Operator 11 against the eigenvectors of the exact covariance."""

from fractions import Fraction

import numpy as np
import pytest

from tabulark.llm import whitening as wh
from tabulark.llm.queries import QUERIES

from .fixtures import SF


def check(got, rows, components=16):
    """``got`` against numpy on the rows (id, vector of finite numbers)."""
    x = [(i, np.floor(64 * np.asarray(v, np.float64)).astype(np.int64) + 1_000_000) for i, v in rows]
    fit = np.unique(np.stack([v for _, v in x]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    a = np.array([[float(Fraction(int(n * e - t), n)) for e, t in zip(v, s, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == k * len(rows) and {r["n"] for r in got} <= {n}
    want, have = {}, {}
    for i, v in x:
        own = np.array([float(Fraction(int(n * e - t), n)) for e, t in zip(v, s, strict=True)])
        want.setdefault(i, []).append((int(sum(int(n * e - t) ** 2 for e, t in zip(v, s, strict=True))), own @ vectors[:, :k] / np.sqrt(values[:k])))
    for r in got:
        have.setdefault((r["vec_id"], r["component"]), []).append(r)
    sign = {}
    gaps = [min(abs(values[c] - values[j]) for j in range(len(values)) if j != c) / values[0] for c in range(k)]
    for (i, c), found in have.items():
        assert sorted(r["deviation"] for r in found) == sorted(d for d, _ in want[i])
        assert all(abs(r["explained"] - values[c - 1] / values.sum()) < 1e-9 for r in found)
        assert all(0 <= r["identity_error"] < 1e-8 for r in found)
        if gaps[c - 1] > 1e-3 and len(found) == 1 and abs(found[0]["whitened"]) > 1e-6:
            y = want[i][0][1][c - 1]
            assert abs(abs(found[0]["whitened"]) - abs(y)) < 1e-8
            assert sign.setdefault(c, np.sign(found[0]["whitened"] * y)) == np.sign(found[0]["whitened"] * y)


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    return df.selectExpr("*", "'z' AS x", "'z' AS component", "'z' AS n", "1 AS v")


def test_dirty_rows_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(v) for v in rng.normal(size=7).astype(np.float32)]) for i in range(40)]
    good += [(100, good[0][1]), (100, good[1][1]), (None, good[2][1])] + [(200 + i, good[3][1]) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    bad = [(300, None), (301, []), (302, [nan] * 7), (303, [1.0] * 6 + [None]), (304, [inf] + [0.0] * 6), (305, [1.0] * 6), (306, [-1e18] * 7)]
    got = [r.asDict() for r in wh.whiten(frame(spark, good + bad, "double")).collect()]
    check(got, good)


def test_missing_and_repeated_variances(spark):
    low = np.random.default_rng(2).integers(-9, 9, (30, 2)) @ np.random.default_rng(3).integers(-5, 5, (2, 9))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(low)]
    check([r.asDict() for r in wh.whiten(frame(spark, rows)).collect()], rows)
    rows = [(2 * i + (s > 0), [float(s * (i == j)) for j in range(20)]) for i in range(20) for s in (1, -1)]
    got = [r.asDict() for r in wh.whiten(frame(spark, rows)).collect()]
    check(got, rows)
    assert {r["component"] for r in got} == set(range(1, 17))


def test_no_variance_and_no_rows(spark):
    assert wh.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert wh.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert wh.whiten(frame(spark, [(1, None)]).where("false")).collect() == []


def test_large_numbers_stay_exact():
    x = np.array([[2**52, -(2**52)], [2**52 - 5, 7], [0, 3]], np.int64)
    sums = [int(v) for v in x.astype(object).sum(axis=0)]
    centre = wh.exact_mean(3, sums)
    want = [sum((3 * int(e) - s) ** 2 for e, s in zip(r, sums, strict=True)) for r in x]
    assert wh._deviations(x, centre) == [w if w < 1 << 63 else None for w in want]
    assert wh._deviations(x % 1000, wh.exact_mean(3, [int(v) for v in (x % 1000).sum(axis=0)]))[0] is not None


@pytest.mark.parametrize("spread", [0, 3, 6])
def test_bidiagonal_form(spread):
    x = np.floor(np.random.default_rng(4).normal(size=(500, 24)) * 10.0 ** np.linspace(spread, 0, 24) * 9).astype(np.int64)
    centre = wh.exact_mean(len(x), [int(v) for v in x.sum(axis=0)])
    b, right, total = wh.bidiagonalise(lambda left, v, beta: wh._products(x, (centre, left, v, beta)), 24)
    a = wh._centred(x, centre)
    assert np.abs(right.T @ right - np.eye(24)).max() < 1e-13
    assert np.abs(np.triu(b, 2)).max() == 0 and np.abs(np.tril(b, -1)).max() == 0
    assert np.allclose(np.linalg.svd(b)[1], np.linalg.svd(a)[1], rtol=1e-7, atol=1e-12 * np.sqrt(total))


def test_registered_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check([r.asDict() for r in QUERIES["op11_whitening"](spark, SF).collect()], rows)
