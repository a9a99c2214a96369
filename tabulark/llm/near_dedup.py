"""Operator 6, near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: the first (sigma) shuffles the
shingles, the second (pi) is applied to sigma's values shifted by the number
of the coordinate. Bands of coordinates bring documents together; links are
confirmed by the exact Jaccard similarity of full shingle sets, and union-find
over the links gives the groups. Documents with equal sets form one class and
are compared once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, blocks, buffers, chain, join_groups, lower_ascii, mix64, segment_ids, shared, shared_table, text_or_empty, word_spans
from .graph import crowded, linked, sketch

WORDS = 3
PERCENT = 85
BANDS = 20
#: least share of the pairs at the threshold that share a band
RECALL = 0.9996
#: sketch bits of documents that share a bucket
SKETCH = 2048


def band_rows(percent: int, bands: int = BANDS) -> int:
    """The most rows a band can have for :data:`RECALL` at the threshold: 6 at
    0.85 (1 - (1 - 0.85^6)^20 = 0.9999), 5 at 0.8 (0.9996)."""
    rows = 1
    while rows < 6 and 1 - (1 - (percent / 100) ** (rows + 1)) ** bands >= RECALL:
        rows += 1
    return rows


def _sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct word shingles, sorted; first of each
    text). A text with fewer words has its whole sequence as one shingle."""
    n = len(offsets) - 1
    start, end, first = word_spans(raw, offsets)
    counts = np.diff(first)
    doc = segment_ids(counts)
    word = Spans(lower_ascii(raw)).hash(start, end)
    parts, owner = [], []
    if len(word) >= words:
        m = len(word) - words + 1
        at = np.flatnonzero(doc[:m] == doc[words - 1 :])
        parts.append(chain([word[i : i + m] for i in range(words)])[at])
        owner.append(doc[at])
    for k in range(1, words):
        rows = np.flatnonzero(counts == k)
        if len(rows):
            parts.append(chain([word[first[rows] + i] for i in range(k)]) ^ np.uint64(k))
            owner.append(rows)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h, o = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(n + 1))


def _mix32(x: np.ndarray) -> np.ndarray:
    """In place: a bijection on 32-bit integers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash, (texts, size); texts must not be empty."""
    sigma = _mix32(mix64(sets).astype(np.uint32))
    out = np.empty((len(first) - 1, size), np.uint32)
    # blocks of whole texts that stay in the cache
    for i, j in blocks(first, 1 << 15):
        s, f = sigma[first[i] : first[j]], first[i:j] - first[i]
        for k in range(size):
            out[i:j, k] = np.minimum.reduceat(_mix32(s + np.uint32(k)), f)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band, (texts, bands)."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        cols = sig[:, b * rows : (b + 1) * rows].astype(np.uint64)
        out[:, b] = chain([cols[:, r] + np.uint64(b << 32) for r in range(rows)])
    return out


def identity(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each set that do not depend on order, (texts, 2)."""
    some = np.diff(first) > 0
    out = np.zeros((len(first) - 1, 2), np.uint64)
    for c, seed in enumerate((0x51ED270B, 0xB5297A4D)):
        x = mix64(sets ^ np.uint64(seed))
        if some.any():
            out[some, c] = np.add.reduceat(x, first[:-1][some])
    return out.view(np.int64)


def _scan(words: int, bands: int, rows: int):
    """Per text: its hash, set size, identity and band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = buffers(b.column("text"))
            for i, j in blocks(off):
                sets, first = _sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], words)
                n = np.diff(first)
                some = np.flatnonzero(n)
                ident = identity(sets, first)
                keys = np.zeros((0, bands), np.int64)
                if len(some):
                    keys = band_keys(signatures(sets, np.append(first[some], len(sets)), bands * rows), bands, rows).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                cols = [b.column("doc_id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(n), pa.array(ident[:, 0]), pa.array(ident[:, 1])]
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n_shingles", "h1", "h2", "keys"])

    return run


def _scan_sets(words: int):
    """Sets of the texts, with their identity and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = buffers(b.column("text"))
            for i, j in blocks(off):
                sets, first = _sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], words)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                first = np.append(first[some], len(sets))
                ident = identity(sets, first)
                cols = [pa.array(ident[:, 0]), pa.array(ident[:, 1]), sketch(mix64(sets).astype(np.uint32), first, SKETCH)]
                cols.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", "sketch", "set"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose ``sets`` (node, set: distinct values,
    materialised) have an exact Jaccard similarity of at least ``percent``
    hundredths."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int | None = None) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_shingles, component_id, kept: one
    row per row.

    Texts are lower-cased in A-Z; a set is the distinct ``words``-word
    shingles (of a shorter text, its whole word sequence). Documents are
    linked where 100 * intersection >= ``percent`` * union; component_id is
    the smallest id reachable, null ids last; ``kept`` is whether the row's id
    and text are those of the component's first by (id, th). Texts without
    words, null or empty, are linked with nothing. Rows that agree in id and
    text are the same document and share its verdict; different texts under
    one id, or under null, are judged apart. Bands have ``rows`` coordinates,
    by default as :func:`band_rows` derives them from ``percent``. An empty table gives an empty
    result; other columns are not read."""
    rows = rows or band_rows(percent, bands)
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    kind = text.schema["doc_id"].dataType.simpleString()
    scanned = shared(text.mapInArrow(_scan(words, bands, rows), f"doc_id {kind}, th long, n_shingles long, h1 long, h2 long, keys array<bigint>"))
    # a class is a set; its least document stands for it
    same = ["h1", "h2", "n_shingles"]
    classes = scanned.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep"), F.first("keys").alias("keys"))
    classes = shared(classes.withColumn("node", F.monotonically_increasing_id()))
    members = crowded(classes.select("node", F.explode("keys").alias("key")).distinct())
    wanted = members.select("node").distinct().join(classes, "node")
    wanted = shared(wanted.select("node", "rep", "h1", "h2"))
    reps = wanted.select(F.col("rep.doc_id").alias("_rep"), F.col("rep.th").alias("_rep_th"))
    texts = text.join(reps, F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("th") == F.col("_rep_th")), "left_semi")
    sets = texts.select("text").mapInArrow(_scan_sets(words), "h1 long, h2 long, sketch array<bigint>, set array<bigint>")
    sets = sets.join(wanted.select("node", "h1", "h2"), ["h1", "h2"]).dropDuplicates(["node"])
    sets = shared_table(sets.select("node", F.size("set").alias("size"), "sketch", "set"))
    roots = linked(members, sets, percent, SKETCH, lambda pairs: confirm(pairs, sets, percent))
    joined = classes.join(roots, "node", "left").select(*same, "rep", F.coalesce("root", "node").alias("root"))
    least = shared(joined.groupBy("root").agg(F.min("rep").alias("first")))
    of_class = shared(join_groups(joined, least, ["root"]).select(*same, "first"))
    rows_ = scanned.select("doc_id", "th", *same)
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    grouped = join_groups(rows_.where("n_shingles > 0"), of_class, same).select("doc_id", "th", "n_shingles", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))
    alone = rows_.where("n_shingles = 0").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return alone.unionByName(grouped)
