"""Operator 3, exact dedup by two-pass Bloom filtering.

Pass 1 reads only digests: every partition notes, in blocks of a Bloom filter,
which bits were set once and which twice; merged, the bits set at least twice
are the filter of *possibly repeated* digests. Pass 2 tests every row against
it. Rows that fail the test are unique and go straight to the result; only the
others are grouped by digest. The filter is built and broadcast in rounds over
ranges of the digest, each at most ``ROUND_BITS`` bits, so the broadcast has a
fixed bound while the number of rounds follows the input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, mix64, shared, text_or_empty

ROUND_BITS = 1 << 27
BITS_PER_ROW = 16
#: bits of one block: an offset in it fits 16 bits
BLOCK_BITS = 1 << 16


def _places(key: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the two bit offsets of each digest, shape (2, rows)."""
    x = mix64(key.astype(np.int64).view(np.uint64))
    block = ((x >> np.uint64(32)) % np.uint64(n_blocks)).astype(np.int64)
    return block, np.stack([x & np.uint64(0xFFFF), (x >> np.uint64(16)) & np.uint64(0xFFFF)]).astype(np.int64)


def _note_bits(n_blocks: int):
    """Per partition: (block, offsets set once, offsets set twice or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            block, off = _places(b.column(0).to_numpy(zero_copy_only=False), n_blocks)
            # both offsets of one row may coincide: that is one bit of one row
            off = np.where((np.arange(2) == 1)[:, None] & (off[0] == off[1]), -1, off)
            new = (block * BLOCK_BITS + off)[off >= 0]
            u, c = np.unique(np.concatenate([bits, new]), return_inverse=True)
            n = np.zeros(len(u), np.int64)
            np.add.at(n, c, np.concatenate([counts, np.ones(len(new), np.int64)]))
            bits, counts = u, np.minimum(n, 2)
        blocks = bits // BLOCK_BITS
        cut = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(bits))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            o = (bits[i:j] % BLOCK_BITS).astype("<u2")
            c = counts[i:j]
            yield pa.RecordBatch.from_pydict({"block": [int(blocks[i])], "once": [o[c == 1].tobytes()], "twice": [o[c > 1].tobytes()]})

    return run


def _merge_bits(table: pa.Table) -> pa.Table:
    """Bitmap of a block's offsets that are set at least twice over all parts."""
    once = np.frombuffer(b"".join(table.column("once").to_pylist()), "<u2")
    twice = np.frombuffer(b"".join(table.column("twice").to_pylist()), "<u2")
    n = np.bincount(once, minlength=BLOCK_BITS)
    n[twice] = 2
    bitmap = np.packbits(n > 1, bitorder="little").tobytes()
    return pa.table({"block": [table.column("block")[0].as_py()], "bitmap": [bitmap]})


def _test_bits(filter_, n_blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(filter_.value, np.uint8)
        for b in batches:
            block, off = _places(b.column("_key").to_numpy(zero_copy_only=False), n_blocks)
            at = block * BLOCK_BITS + off
            hit = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield b.append_column("_maybe", pa.array(hit.all(axis=0)))

    return run


def possibly_repeated(rows: DataFrame, key: str = "_key") -> DataFrame:
    """``rows`` (materialised, with a bigint digest ``_key``) plus ``_maybe``:
    false only for rows whose digest occurs once in the whole frame."""
    spark = rows.sparkSession
    n = rows.count()
    rounds = max(1, -(-n * BITS_PER_ROW // ROUND_BITS))
    n_blocks = max(1, -(-n * BITS_PER_ROW // (rounds * BLOCK_BITS)))
    out = None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    for r in range(rounds):
        part = rows.where(F.pmod(F.col(key), F.lit(rounds)) == r) if rounds > 1 else rows
        noted = part.select(key).mapInArrow(_note_bits(n_blocks), "block long, once binary, twice binary")
        merged = noted.groupBy("block").applyInArrow(_merge_bits, "block long, bitmap binary")
        bitmap = np.zeros((n_blocks, BLOCK_BITS // 8), np.uint8)
        for x in merged.toLocalIterator():
            bitmap[x.block] = np.frombuffer(x.bitmap, np.uint8)
        filter_ = spark.sparkContext.broadcast(bitmap.tobytes())
        tested = part.mapInArrow(_test_bits(filter_, n_blocks), f"{fields}, _maybe boolean")
        out = tested if out is None else out.unionByName(tested)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the
    row with the largest id stays; null ids sort lowest, and of rows that
    agree in text and id one stays. Columns other than id and text are not
    read. An empty table gives an empty result."""
    digests = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"))
    digests = digests.withColumn("_key", F.xxhash64("text_sha256")).withColumn("_row", F.monotonically_increasing_id())
    tested = shared(possibly_repeated(shared(digests)))
    last = F.struct("doc_id", "_row")
    maybe = tested.where("_maybe")
    groups = maybe.groupBy("text_sha256").agg(F.max(last).alias("_last"), F.count(F.lit(1)).alias("group_size"))
    grouped = join_groups(maybe, shared(groups), ["text_sha256"]).select(
        "doc_id",
        F.col("_last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_last._row")).alias("kept"),
        "text_sha256",
    )
    single = tested.where(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return single.unionByName(grouped)
