"""Operator 11, embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never squared up front. Each step is one distributed
pass that gives both products: w = Xv for the newest right vector, row by row
in the partitions, and X'w, summed up. Left vectors have a place for every row
and stay out of the driver: they are the rows times a small matrix, which the
driver extends by a column in each step. Both sides are fully
reorthogonalised, the left one through its inner products from the same pass,
the right one on the driver. When a Krylov space is exhausted (repeated or
missing directions) a new start orthogonal to it goes on. After as many steps
as there are dimensions X = U B V' holds in full, and the singular values and
right vectors of the small bidiagonal B give deviations and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

COMPONENTS = 16
#: entries are rounded down to multiples of 1 / SCALE
SCALE = 64
#: |SCALE * entry| from which an entry is no number that a double holds exactly
LARGEST = 2.0**53
#: least share of the largest variance that a component must have
LEAST = 1e-12
#: rows of one product, and partial sums that the driver adds up itself
ROWS, PARTIALS = 1 << 13, 512


def _integers(scale: int):
    """Rows whose vector holds only finite numbers, as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                lists = part.column("v")
                ends = lists.offsets.to_numpy().astype(np.int64)
                n = np.where(np.asarray(lists.is_valid()), np.diff(ends), 0)
                values = np.asarray(lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False), np.float64) * scale
                good = n > 0
                with np.errstate(invalid="ignore"):
                    bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < LARGEST))])
                good &= bad[ends[1:] - ends[0]] == bad[ends[:-1] - ends[0]]
                rows = np.flatnonzero(good)
                x = [np.floor(values[ends[r] - ends[0] : ends[r + 1] - ends[0]]).astype("<i8").tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(rows)), pa.array(x, pa.binary())], ["vec_id", "x"])

    return run


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            col = part.column("x")
            off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
            yield part, np.frombuffer(col.buffers()[2], "<i8", (off[-1] - off[0]) // 8, off[0]).reshape(len(col), d)


def _partial(state, fold, d: int):
    """One row per partition: the sum of ``fold`` over its matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, total = state.value, None
        for _, x in _matrices(batches, d):
            got = fold(x, known)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    return run


def _add(kind: type):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        total = sum(np.frombuffer(x.as_py(), kind) for x in t.column("sums"))
        return pa.table({"part": [t.column("part")[0].as_py()], "sums": pa.array([total.tobytes()], pa.binary())})

    return run


def _sum(fit: DataFrame, fold, known, d: int, kind: type = np.float64) -> np.ndarray:
    """The sum of ``fold(x, known)`` over the rows of ``fit``, in the order of
    partitions, so reruns over the same files agree. Very many partial sums
    are added up in groups first."""
    sent = fit.sparkSession.sparkContext.broadcast(known)
    parts = fit.mapInArrow(_partial(sent, fold, d), "part long, sums binary")
    if fit.rdd.getNumPartitions() > PARTIALS:
        parts = parts.groupBy(F.pmod("part", F.lit(64)).alias("g")).applyInArrow(_add(kind), "part long, sums binary")
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    sent.destroy()
    return sum(np.frombuffer(r["sums"], kind) for r in rows)


def _halves(x: np.ndarray, _) -> np.ndarray:
    """Sums of the high and low halves of each dimension: neither overflows."""
    return np.concatenate([(x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)])


def exact_mean(n: int, sums: list[int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, whole, rest) with sums = n * whole + rest and 0 <= rest < n."""
    whole, rest = zip(*(divmod(s, n) for s in sums), strict=True)
    return n, np.array(whole, np.int64), np.array(rest, np.int64)


def _centred(x: np.ndarray, centre: tuple) -> np.ndarray:
    n, whole, rest = centre
    return (x - whole) - rest / n


def _products(x: np.ndarray, known: tuple) -> np.ndarray:
    """For w = Xv - beta * (last left vector): |w|^2, |X|^2, X'w and U'w."""
    centre, left, v, beta = known
    a = _centred(x, centre)
    u = a @ left
    w = a @ v
    if left.shape[1]:
        w -= beta * u[:, -1]
    return np.concatenate([[w @ w, np.einsum("ij,ij->", a, a)], a.T @ w, u.T @ w])


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(product, d: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(B, V, |X|^2) with X = U B V' for d dimensions. ``product(left, v,
    beta)`` gives |w|^2, |X|^2, X'w and U'w for w = Xv - beta u, where the left
    vectors are U = X @ left and u is the last of them."""
    rng = np.random.default_rng(seed)
    right, left, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    alphas, betas = [], [0.0]
    v, scale, total = rng.normal(size=d), 0.0, 0.0
    v /= np.linalg.norm(v)
    for k in range(d):
        got = product(left, v, betas[k])
        ww, total, xw, uw = got[0], got[1], got[2 : 2 + d], got[2 + d :]
        right = np.column_stack([right, v])
        alpha = np.sqrt(max(ww - uw @ uw, 0.0))
        scale = max(scale, alpha)
        tiny = 1e-13 * np.sqrt(total)
        if alpha > tiny:
            last = left[:, -1] if k else np.zeros(d)
            left = np.column_stack([left, (v - betas[k] * last - left @ uw) / alpha])
            back = np.column_stack([back, (xw - back @ uw) / alpha])
            z = _orthogonal(back[:, -1] - alpha * v, right)
        else:
            # v adds nothing to the left space: its left vector is none
            alpha = 0.0
            left, back = (np.column_stack([m, np.zeros(d)]) for m in (left, back))
            z = np.zeros(d)
        alphas.append(alpha)
        if k + 1 == d:
            break
        beta = float(np.linalg.norm(z))
        if beta <= tiny:
            # the space is closed: go on outside of it
            beta, z = 0.0, _orthogonal(rng.normal(size=d), right)
        betas.append(beta)
        v = _orthogonal(z / np.linalg.norm(z), right)
        v /= np.linalg.norm(v)
    return np.diag(alphas) + np.diag(betas[1:], 1), right, total


def _covariance(x: np.ndarray, known: tuple) -> np.ndarray:
    centre, maps = known
    y = _centred(x, centre) @ maps
    return np.concatenate([y.sum(axis=0), (y.T @ y).reshape(-1)])


def _deviations(x: np.ndarray, centre: tuple) -> list[int | None]:
    """Sum of (n * x - S)^2 per row, exact; null where no long holds it."""
    n, whole, rest = centre
    far = x - whole
    bound = n * (int(np.abs(far).max(initial=0)) + 1)
    if bound * bound * x.shape[1] < 1 << 63:
        q = n * far - rest
        return (q * q).sum(axis=1).tolist()
    q = far.astype(object) * n - rest.astype(object)
    return [s if s < 1 << 63 else None for s in (q * q).sum(axis=1)]


def _whitened(state, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, maps, explained, error = state.value
        k = maps.shape[1]
        for part, x in _matrices(batches, d):
            m = len(x)
            take = pa.array(np.repeat(np.arange(m), k))
            cols = [part.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre[0]))]
            cols += [pa.array(_deviations(x, centre), pa.int64()).take(take), pa.array((_centred(x, centre) @ maps).reshape(-1))]
            cols += [pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error: for each row a row per component.

    Entries are rounded down to multiples of 1 / ``scale`` and counted in
    these: x = floor(scale * entry). (A constant added to all x, such as
    1000000, changes nothing here.) Components and deviations come from the
    distinct vectors, n of them; explained is a component's share of their
    total variance, identity_error how far their whitened covariance is from
    the identity. Components run by falling variance, at most ``components``,
    and only those with a variance (at least ``LEAST`` of the largest): with
    one distinct vector there is none and the result is empty, as for an empty
    table. Of equal variances any orthogonal directions are taken. Rows whose
    vector is null, empty, or holds null, NaN, infinite or (times ``scale``)
    over 2^53 large entries are left out, and so are those of another length
    than most rows have (of equal counts the longer one). Null and repeated
    ids are kept. deviation is null where no 64-bit integer holds it. Other
    columns are not read. The table of distinct vectors is read once per
    dimension."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    result = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = shared_table(rows.mapInArrow(_integers(scale), f"vec_id {kind}, x binary"))
    lengths = rows.groupBy(F.octet_length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    empty = vectors.sparkSession.createDataFrame([], result)
    if lengths is None:
        return empty
    d = lengths["bytes"] // 8
    rows = rows.where(F.octet_length("x") == lengths["bytes"])
    fit = shared_table(rows.select("x").distinct())
    n = fit.count()
    halves = _sum(fit, _halves, None, d, np.int64)
    centre = exact_mean(n, [(int(halves[j]) << 26) + int(halves[d + j]) for j in range(d)])
    b, right, total = bidiagonalise(lambda left, v, beta: _sum(fit, _products, (centre, left, v, beta), d), d)
    _, sigma, directions = np.linalg.svd(b)
    # what is far below the largest variance is rounding
    some = int((sigma[:components] ** 2 > LEAST * sigma[0] ** 2).sum()) if sigma[0] > 0 else 0
    if not some:
        return empty
    sigma, maps = sigma[:some], (right @ directions[:some].T) * (np.sqrt(n) / sigma[:some])
    got = _sum(fit, _covariance, (centre, maps), d)
    mean = got[:some] / n
    error = float(np.abs(got[some:].reshape(some, some) / n - np.outer(mean, mean) - np.eye(some)).max())
    sent = vectors.sparkSession.sparkContext.broadcast((centre, maps, sigma**2 / total, error))
    return rows.mapInArrow(_whitened(sent, d), result)
