"""Co-moments of many column pairs in one pass.

Every partition keeps, per pair of columns, the number of complete rows, both
means, both sums of squared deviations and the sum of their products, over
the rows where both columns have a value. States merge pairwise (Chan et al.),
each deviation is taken from a nearby mean, so values far from zero lose no
digits. A batch costs a few matrix products whatever pattern of nulls it has,
and a state has six numbers per pair: nothing grows with the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import q

#: states that the driver merges itself; more are merged in groups first
_STATES = 64


def _shift(x: np.ndarray) -> np.ndarray:
    """A value near each column's mean; a constant column's value itself."""
    lo, hi = np.fmin.reduce(x, axis=0), np.fmax.reduce(x, axis=0)
    with np.errstate(invalid="ignore", over="ignore"):
        mean = np.nansum(x, axis=0) / np.maximum((~np.isnan(x)).sum(axis=0), 1)
    return np.nan_to_num(np.where(lo == hi, lo, mean))


def _state(x: np.ndarray, left: list[int], right: list[int]) -> np.ndarray:
    """(n, mean of left, of right, squares of left, of right, products), each
    (left, right), of the rows of ``x``; NaN is missing."""
    shift = _shift(x)
    has = ~np.isnan(x)
    d = np.where(has, x - shift, 0.0)
    m = has.astype(np.float64)
    dl, dr, ml, mr = d[:, left], d[:, right], m[:, left], m[:, right]
    n = ml.T @ mr
    some = np.maximum(n, 1)
    sl, sr = dl.T @ mr, ml.T @ dr
    squares_l, squares_r = (dl * dl).T @ mr - sl * sl / some, ml.T @ (dr * dr) - sr * sr / some
    products = dl.T @ dr - sl * sr / some
    return np.stack([n, sl / some + shift[left][:, None], sr / some + shift[right], np.maximum(squares_l, 0), np.maximum(squares_r, 0), products])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of the rows of both."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    # the mean of no rows says nothing
    dl, dr = (np.where((a[0] > 0) & (b[0] > 0), b[k] - a[k], 0.0) for k in (1, 2))
    first = np.where(a[0] > 0, 1.0, 0.0)
    mean_l = np.where(first, a[1], b[1]) + dl * share
    mean_r = np.where(first, a[2], b[2]) + dr * share
    weight = a[0] * share
    return np.stack([n, mean_l, mean_r, a[3] + b[3] + dl * dl * weight, a[4] + b[4] + dr * dr * weight, a[5] + b[5] + dl * dr * weight])


def _scan(left: list[int], right: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in b.columns], axis=1)
            with np.errstate(invalid="ignore", over="ignore"):
                new = _state(x, left, right)
                state = new if state is None else merge(state, new)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([state.tobytes()], pa.binary())], ["part", "state"])

    return run


def _merge_all(rows: list[tuple[int, bytes]], shape: tuple[int, int]) -> np.ndarray:
    """The states in the order of their partitions, so that reruns agree."""
    state = None
    for _, s in sorted(rows):
        new = np.frombuffer(s, np.float64).reshape(6, *shape)
        state = new if state is None else merge(state, new)
    return state


def _merge_group(shape: tuple[int, int]):
    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(t.column("part").to_pylist(), t.column("state").to_pylist(), strict=True))
        return pa.table({"part": [min(rows)[0]], "state": pa.array([_merge_all(rows, shape).tobytes()], pa.binary())})

    return run


def pair_moments(df: DataFrame, left: Sequence[str], right: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(left, right, n, m2_left, m2_right, c) for ``pairs`` of a column of
    ``left`` and one of ``right``: complete rows, sums of squared deviations
    and of products of deviations. Null and NaN are missing. One row per pair:
    the result has the size of the schema, not of the table."""
    cols = list(dict.fromkeys([*left, *right]))
    at = {c: i for i, c in enumerate(cols)}
    shape = (len(left), len(right))
    doubles = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    states = doubles.mapInArrow(_scan([at[c] for c in left], [at[c] for c in right]), "part long, state binary")
    if doubles.rdd.getNumPartitions() > _STATES:
        states = states.groupBy(F.pmod("part", F.lit(_STATES)).alias("g")).applyInArrow(_merge_group(shape), "part long, state binary")
    state = _merge_all([(r["part"], bytes(r["state"])) for r in states.collect()], shape)
    state = np.zeros((6, *shape)) if state is None else state
    row, column = {c: i for i, c in enumerate(left)}, {c: i for i, c in enumerate(right)}
    out = []
    for a, b in pairs:
        n, _, _, ml, mr, c = (float(v) for v in state[:, row[a], column[b]])
        out.append((a, b, int(n), *(v if np.isfinite(v) else None for v in (ml, mr, c))))
    return df.sparkSession.createDataFrame(out, "left string, right string, n long, m2_left double, m2_right double, c double")
