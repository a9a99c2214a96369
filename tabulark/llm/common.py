"""Shared pieces of the training-data operators: lineage cuts in the shared
folder, zero-copy access to Arrow text columns, and vectorised word hashing.

All hashing works on UTF-8 bytes in blocks of whole documents; a block holds
at least one document and about ``BLOCK_BYTES`` bytes, so a worker's memory is
bounded by its Arrow batch plus the longest document."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.session import checkpoint_dir, cut_lineage

BLOCK_BYTES = 1 << 20
#: odd multiplier of the polynomial prefix hash and its inverse modulo 2^64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: the white space of the word pattern [^\x20\x09-\x0D]+
WORD = r"[^\x20\x09-\x0D]+"


def shared(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so later stages neither
    recompute it nor depend on one executor."""
    return cut_lineage(df)


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder, for what is
    too large to keep as checkpointed rows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once for each worker process. Functions are
    shipped by value, so a module-level variable would be new in every task;
    reused workers find this one again in the interpreter's modules."""
    name = "_tabulark_worker"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def text_or_empty(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; a null is an empty run."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count:
        # a null slot may span bytes in theory: give it none
        gap = np.where(np.asarray(col.is_null()), off[1:] - off[:-1], 0)
        if gap.any():
            parts = [raw[a:b] for a, b, g in zip(off[:-1], off[1:], gap, strict=True) if not g]
            raw = np.concatenate(parts) if parts else raw[:0]
            off = np.concatenate([[0], np.cumsum(off[1:] - off[:-1] - gap)])
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``size`` bytes each, whole rows only."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted integers without repeats. ``np.unique`` may go through a hash
    table, which takes some 20 times as long and more memory."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers with good avalanche (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes(seed: int) -> np.ndarray:
    return mix64((np.arange(256, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.cumprod(x, out=x)


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` or more powers of the prefix hash's multiplier and of its
    inverse. A worker process keeps those that a block of documents needs."""
    if n > 2 * BLOCK_BYTES:
        return _powers(_P, n), _powers(_PINV, n)
    # as many as the next power of two, so that small blocks need no large table
    m = max(1 << 12, 1 << (n - 1).bit_length())
    return per_process(("powers", m), lambda: (_powers(_P, m), _powers(_PINV, m)))


class Spans:
    """64-bit hashes of arbitrary byte spans of one block, from one prefix sum."""

    def __init__(self, raw: np.ndarray, seed: int = 1):
        n = len(raw)
        power, self.inv = _both_powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = _byte_codes(seed)[raw]
        terms *= power[:n]
        np.cumsum(terms, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix64(h + (end - start).astype(np.uint64))

    def windows(self, points: np.ndarray, size: int) -> np.ndarray:
        """``hash(points[k], points[k + size])`` for every such k; rising ``points``."""
        n = max(0, len(points) - size)
        out = np.empty(n, np.uint64)
        # parts that stay in the cache
        for i in range(0, n, 1 << 14):
            j = min(n, i + (1 << 14))
            at = points[i : j + size]
            sums = self.sums[at]
            h = sums[size:] - sums[:-size]
            h *= self.inv[at[:-size]]
            h += (at[size:] - at[:-size]).astype(np.uint64)
            out[i:j] = mix64(h)
        return out


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row) of the words [^\\x20\\x09-\\x0D]+, or
    runs of other bytes than ``space`` flags; no word crosses a row.
    ``offsets`` starts at 0 and has one more entry than rows; the third array
    too."""
    n = len(raw)
    solid = ~space[raw]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | begins[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | begins[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    # unsigned: bytes below 65 wrap around to large ones
    return raw | ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def chain(hashes: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of aligned hash arrays (word windows)."""
    x = mix64(hashes[0])
    for h in hashes[1:]:
        x = mix64(x + h)
    return x


def multiplied(x: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """MinHash of sets of well-mixed 32-bit values by odd multipliers, each a
    bijection, (sets, size). Set i is x[first[i]:first[i + 1]], not empty."""
    factors = mix64(np.arange(1, size + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(first) - 1, size), np.uint32)
    # blocks of whole sets that stay in the cache
    for i, j in blocks(first, 1 << 15):
        s, f = x[first[i] : first[j]], first[i:j] - first[i]
        found, low = np.empty_like(s), np.empty((size, j - i), np.uint32)
        for k in range(size):
            np.minimum.reduceat(np.multiply(s, factors[k], out=found), f, out=low[k])
        out[i:j] = low.T
    return out


def segment_ids(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, one materialised row per key. Both
    sides are shuffled for this join alone, so where a key has a large part of
    all rows Spark's skew handling splits that partition over many tasks and
    hands each the group's one row; a grouped result joined straight away
    would keep its partitioning and could not be split."""
    return rows.join(groups, keys, how)
