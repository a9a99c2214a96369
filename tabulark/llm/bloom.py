"""A Bloom filter of a frame's keys with a fixed size, for skipping rows early.

The filter has ``FILTER_BITS`` bits whatever the number of keys, so its
broadcast is bounded; with more keys than it can tell apart it lets more rows
through, which costs work later but never changes a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unique
from .exact_dedup import BLOCK_BITS, _places

FILTER_BITS = 1 << 27
#: pairs that a task of :func:`several` takes at a time (16 bytes each)
PAIRS = 1 << 20


def _bits(n_blocks: int):
    """Per partition: the offsets set in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(0, np.int64)
        for b in batches:
            block, off = _places(b.column(0).to_numpy(zero_copy_only=False), n_blocks)
            bits = unique(np.concatenate([bits, (block * BLOCK_BITS + off).reshape(-1)]))
        blocks = bits // BLOCK_BITS
        cut = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(bits))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield pa.RecordBatch.from_pydict({"block": [int(blocks[i])], "bits": [(bits[i:j] % BLOCK_BITS).astype("<u2").tobytes()]})

    return run


def _bitmap(table: pa.Table) -> pa.Table:
    flags = np.zeros(BLOCK_BITS, bool)
    for x in table.column("bits"):
        flags[np.frombuffer(x.as_py(), "<u2")] = True
    return pa.table({"block": [table.column("block")[0].as_py()], "bitmap": [np.packbits(flags, bitorder="little").tobytes()]})


def key_filter(keys: DataFrame, n_keys: int, column: str):
    """Broadcast (bitmap, number of blocks) of a bigint column; at most
    ``FILTER_BITS`` bits, 16 for each of ``n_keys`` where that is less."""
    n_blocks = max(1, min(FILTER_BITS, 16 * n_keys) // BLOCK_BITS)
    merged = keys.select(column).mapInArrow(_bits(n_blocks), "block long, bits binary").groupBy("block").applyInArrow(_bitmap, "block long, bitmap binary")
    out = np.zeros((n_blocks, BLOCK_BITS // 8), np.uint8)
    for x in merged.toLocalIterator():
        out[x.block] = np.frombuffer(x.bitmap, np.uint8)
    return keys.sparkSession.sparkContext.broadcast((out.tobytes(), n_blocks))


def maybe(filter_, key: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    raw, n_blocks = filter_.value
    bitmap = np.frombuffer(raw, np.uint8)
    block, off = _places(key, n_blocks)
    at = block * BLOCK_BITS + off
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def with_maybe(rows: DataFrame, filter_, column: str) -> DataFrame:
    """``rows`` plus ``_maybe``: false only where ``column`` is not in the
    filter. Only that column goes to the Python workers."""

    @F.arrow_udf("boolean")
    def test(key: pa.Array) -> pa.Array:
        return pa.array(maybe(filter_, key.to_numpy(zero_copy_only=False)))

    return rows.withColumn("_maybe", test(column))


def flat(keys: pa.Array, value: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(value, key) of each key of an Arrow column of keys or lists of them."""
    if not pa.types.is_list(keys.type):
        return value.to_numpy(), keys.to_numpy().view(np.uint64)
    count = np.diff(keys.offsets.to_numpy())
    return np.repeat(value.to_numpy(), count), keys.flatten().to_numpy().view(np.uint64)


def _ends(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key with its least value and, where it is another one, its greatest,
    by rising unsigned key."""
    order = np.argsort(key)
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if len(first) == len(key):
        return key, value
    lo, hi = np.minimum.reduceat(value, first), np.maximum.reduceat(value, first)
    twice = 1 + (lo < hi)
    at = np.cumsum(twice) - twice
    out = np.repeat(lo, twice)
    out[at + twice - 1] = hi
    return np.repeat(key[first], twice), out


def _deal(parts: int):
    """Ends of the keys of about ``PAIRS`` pairs at a time, packed by range of keys."""

    def packed(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        key, value = _ends(key, value)
        part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        at = pa.py_buffer((8 * cut).astype(np.int32))
        cols = [pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, at, pa.py_buffer(x)]) for x in (key, value)]
        return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), *cols], ["part", "key", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for b in batches:
            value, key = flat(b.column("keys"), b.column("value"))
            some.append((key, value))
            n += len(key)
            if n >= PAIRS:
                yield packed(*map(np.concatenate, zip(*some, strict=True)))
                some, n = [], 0
        if n:
            yield packed(*map(np.concatenate, zip(*some, strict=True)))

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with two ends, out of all packed rows of a range."""
    kept = key, value = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    some, n = [kept], 0
    for b in batches:
        for k, v in zip(b.column("key"), b.column("value"), strict=True):
            some.append((np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.int64)))
            n += len(some[-1][0])
            if n >= max(PAIRS, len(some[0][0])):
                some, n = [_ends(*map(np.concatenate, zip(*some, strict=True)))], 0
    key, value = _ends(*map(np.concatenate, zip(*some, strict=True)))
    twice = key[1:][key[1:] == key[:-1]].view(np.int64)
    for i in range(0, len(twice), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(twice[i : i + (1 << 16)])], ["key"])


def several(rows: DataFrame, n: int) -> DataFrame:
    """The ``key``s that come with two or more different values: ``rows``
    (keys array<bigint> or bigint, value bigint) with about ``n`` well-mixed keys in all.
    Pairs travel packed by ranges of keys; each task sends two values of a key
    at most, so a hot key is no load for the one that gets its range."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PAIRS))
    # more ranges than partitions, so that these are even
    dealt = rows.mapInArrow(_deal(4 * parts), "part int, key binary, value binary")
    return dealt.repartition(parts, "part").select("key", "value").mapInArrow(_several, "key long")




def meet(rows: DataFrame, per_key: DataFrame, keys: tuple[str, ...] = ("doc_id", "th")) -> tuple[DataFrame, DataFrame]:
    """``rows`` against ``per_key`` (materialised, one row per key, null keys
    included): (rows that the filter lets through, with the other columns of
    ``per_key`` or nulls; all other rows). Only the first kind is shuffled."""
    hashes = per_key.select(F.xxhash64(*keys).alias("_k"))
    tested = with_maybe(rows.withColumn("_k", F.xxhash64(*keys)), key_filter(hashes, per_key.count(), "_k"), "_k").drop("_k")
    t, r = tested.where("_maybe").drop("_maybe").alias("t"), per_key.hint("shuffle_hash").alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}"))
    return t.join(r, same, "left").select("t.*", *[f"r.{c}" for c in per_key.columns if c not in keys]), tested.where("not _maybe").drop("_maybe")


def without(rows: DataFrame, keys_gone: DataFrame, keys: tuple[str, ...] = ("doc_id", "th")) -> DataFrame:
    """``rows`` whose key is not in ``keys_gone`` (materialised, distinct)."""
    some, none = meet(rows, keys_gone.withColumn("_gone", F.lit(True)), keys)
    return none.unionByName(some.where("_gone is null").drop("_gone"))
