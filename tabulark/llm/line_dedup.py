"""Operator 2, fuzzy line dedup by MinHash.

A line is compared by the set of its character shingles. Every distinct line
gets a signature once; bands of it bring lines together, exact Jaccard
similarity confirms the links, and distributed union-find gives components, of
which the first line in corpus order (id, then line) stays. Exact repeats need
no link: they have one fingerprint. Lines travel as fingerprints; texts move
only for lines in crowded buckets, and for documents that lose lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import flat, key_filter, maybe, meet, several, with_maybe
from .common import SPACE, Spans, blocks, buffers, chain, join_groups, lower_ascii, multiplied, segment_ids, shared, shared_table, text_or_empty, unique, word_spans
from .graph import crowded, linked, of_pairs, parity

SHINGLE = 6
PERCENT = 80
#: recall of a pair at 0.8: 1 - (1 - 0.8^4)^8 = 0.985, at 0.85 0.998
BANDS, ROWS = 8, 4


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    r"""The \n-split lines that hold a word: (row, number of the line in its
    row, start and end of the line without white space around it)."""
    bounds = unique(np.concatenate([offsets, np.flatnonzero(raw == 10) + 1]))
    row = np.searchsorted(offsets, bounds[:-1], "right") - 1
    number = np.arange(len(bounds) - 1) - np.searchsorted(bounds, offsets)[row]
    solid = np.append(~SPACE[raw], False)
    lo, hi = bounds[:-1].copy(), bounds[1:].copy()
    # a few steps trim nearly all lines; runs of white space have no bound, so the words settle the rest
    for _ in range(4):
        lo += (lo < hi) & ~solid[lo]
        hi -= (lo < hi) & ~solid[hi - 1]
    left = np.flatnonzero((lo < hi) & ~(solid[lo] & solid[hi - 1]))
    if len(left):
        start, end, _ = word_spans(raw, offsets)
        first, last = np.searchsorted(start, lo[left]), np.searchsorted(start, hi[left])
        lo[left] = hi[left]
        left, first, last = left[last > first], first[last > first], last[last > first]
        lo[left], hi[left] = start[first], end[last - 1]
    some = np.flatnonzero(lo < hi)
    return row[some], number[some], lo[some], hi[some]


def shingles(raw: np.ndarray, spans: Spans, lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the character shingles of each span, first of each span); a
    shorter span is one shingle."""
    points = np.append(np.flatnonzero(raw.view(np.int8) >= -64), len(raw))
    i, j = np.searchsorted(points, lo), np.searchsorted(points, hi)
    count = np.maximum(j - i - size + 1, 1)
    first = np.concatenate([[0], np.cumsum(count)])
    every = spans.windows(points, size)
    short = np.flatnonzero(j - i < size)
    if not len(every):
        return spans.hash(lo, hi), first
    at = np.repeat(i - first[:-1], count)
    at += np.arange(first[-1])
    # a short span may be the last of the block
    at[first[short]] = 0
    found = every[at]
    found[first[short]] = spans.hash(lo[short], hi[short])
    return found, first


def _scan(size: int, bands: int, rows: int):
    """One row per line that holds a word; band keys where the line comes up
    first in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = buffers(b.column("text"))
            for i, j in blocks(off):
                r, o = lower_ascii(raw[off[i] : off[j]]), off[i : j + 1] - off[i]
                row, number, lo, hi = lines(r, o)
                spans = Spans(r)
                node = spans.hash(lo, hi)
                _, one = np.unique(node, return_index=True)
                one = np.sort(one)
                keys = np.zeros((0, bands), np.uint64)
                if len(one):
                    found, first = shingles(r, spans, lo[one], hi[one], size)
                    sig = multiplied(found.astype(np.uint32), first, bands * rows).astype(np.uint64)
                    keys = np.stack([chain([sig[:, k * rows + c] + np.uint64(k << 32) for c in range(rows)]) for k in range(bands)], axis=1)
                has = np.zeros(len(node) + 1, np.int32)
                has[one + 1] = bands
                take = pa.array(i + row)
                cols = [b.column("doc_id").take(take), b.column("th").take(take), pa.array(number.astype(np.int32)), pa.array(node.view(np.int64))]
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum(has, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "line", "node", "keys"])

    return run


def _members(filter_):
    """(node, key) of the band keys that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, key = flat(b.column("keys"), b.column("node"))
            some = maybe(filter_, key.view(np.int64)) if len(key) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(value[some]), pa.array(key[some].view(np.int64))], ["node", "key"])

    return run


def _scan_texts(filter_):
    """(node, text) of the lines whose fingerprint the filter lets through, once
    for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            raw, off = buffers(b.column("text"))
            for i, j in blocks(off):
                r = lower_ascii(raw[off[i] : off[j]])
                _, _, lo, hi = lines(r, off[i : j + 1] - off[i])
                spans = Spans(r)
                node = spans.hash(lo, hi).view(np.int64)
                _, one = np.unique(node, return_index=True)
                one = one[maybe(filter_, node[one])] if len(one) else one
                one = _unseen(node, one, seen)
                if not len(one):
                    continue
                data = r.tobytes()
                texts = [data[p:q].decode() for p, q in zip(lo[one].tolist(), hi[one].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node[one]), pa.array(texts, pa.string())], ["node", "text"])

    return run


def _unseen(node: np.ndarray, at: np.ndarray, seen: set[int]) -> np.ndarray:
    """Those of the places ``at`` whose node comes up first, noted in ``seen``."""
    new = []
    for i, x in zip(at.tolist(), node[at].tolist(), strict=True):
        if x not in seen:
            seen.add(x)
            new.append(i)
    return np.array(new, np.int64)


def _sketches(size: int):
    """Different lines (node, text) with the size and the parity map of their
    sets; all copies of a line come to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            node = b.column("node").to_numpy()
            b = b.take(pa.array(_unseen(node, np.arange(len(node)), seen)))
            raw, off = buffers(b.column("text"))
            for lo, hi in blocks(off, 1 << 18):
                for i in range(lo, hi, 1 << 15):
                    j = min(hi, i + (1 << 15))
                    r, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                    keyed, first = distinct(*shingles(r, Spans(r), o[:-1], o[1:], size))
                    n = np.diff(first)
                    part = b.slice(i, j - i)
                    cols = [part.column("node"), pa.array(n.astype(np.int32)), parity(segment_ids(n), keyed, n), part.column("text")]
                    yield pa.RecordBatch.from_arrays(cols, ["node", "size", "sketch", "text"])

    return run


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each span's hashes without repeats, sorted by their upper 48 bits, at
    which they are told apart: (number of the span << 48 | hash, first of each
    span). At most 65,536 spans."""
    n = len(first) - 1
    keyed = (np.repeat(np.arange(n, dtype=np.uint64), np.diff(first)) << np.uint64(48)) | (hashes >> np.uint64(16))
    keyed = unique(keyed)
    starts = np.searchsorted(keyed, np.arange(n, dtype=np.uint64) << np.uint64(48))
    return keyed, np.append(starts, len(keyed))


def common(ta: pa.Array, tb: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles of a, of b, of both) of each pair of texts."""
    sets = []
    for col in (ta, tb):
        raw, off = buffers(col)
        sets.append(distinct(*shingles(raw, Spans(raw), off[:-1], off[1:], size)))
    both = np.concatenate([s[0] for s in sets])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]] >> np.uint64(48)
    return np.diff(sets[0][1]), np.diff(sets[1][1]), np.bincount(twice.astype(np.int64), minlength=len(ta))


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, off = buffers(b.column("ta"))
            for i, j in blocks(off, 1 << 18):
                for k in range(i, j, 1 << 15):
                    part = b.slice(k, min(j - k, 1 << 15))
                    na, nb, n = common(part.column("ta"), part.column("tb"), size)
                    yield part.select(["a", "b"]).filter(pa.array(100 * n >= percent * (na + nb - n)))

    return run


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of lines that are similar; ``texts``: node, text."""
    pairs, texts = of_pairs(pairs, texts.select("node", "text"))
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_confirm(size, percent), "a long, b long")


def repeated_lines(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, th, text) to (every line: doc_id, th, line, node; the
    lines that go: doc_id, th, line)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = shared_table(docs.mapInArrow(_scan(size, bands, rows), f"doc_id {kind}, th long, line int, node long, keys array<bigint>"))
    n = found.count()
    # buckets of at least two different lines; copies of one line make none
    shared_keys = shared(several(found.select("keys", F.col("node").alias("value")), bands * n))
    full = key_filter(shared_keys, shared_keys.count(), "key")
    some = shared(found.select("node", "keys").mapInArrow(_members(full), "node long, key long").distinct())
    members = crowded(some)
    wanted = shared(members.select("node").distinct())
    texts = docs.select("text").mapInArrow(_scan_texts(key_filter(wanted, wanted.count(), "node")), "node long, text string")
    # each different line is sketched once, however often it comes up
    texts = shared_table(texts.join(wanted.hint("shuffle_hash"), "node", "left_semi").mapInArrow(_sketches(size), "node long, size int, sketch array<bigint>, text string"))
    roots = linked(members, texts, percent, None, lambda pairs: confirm(pairs, texts, size, percent))

    # most lines come once and have no link: they are their own components
    copied = several(found.select(F.col("node").alias("keys"), F.monotonically_increasing_id().alias("value")), n)
    ends = roots.select(F.explode(F.array("node", "root")).alias("key")).distinct()
    more = shared(copied.unionByName(ends))
    maybe_more = with_maybe(found.select("doc_id", "th", "line", "node"), key_filter(more, more.count(), "key"), "node")
    places = shared_table(maybe_more.where("_maybe").drop("_maybe"))
    place = F.struct("doc_id", "th", "line")
    per_line = places.groupBy("node").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    per_line = shared(per_line.join(roots, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root")))
    per_root = shared(per_line.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1").drop("n"))
    crowd = shared(join_groups(per_line.select("node", "root"), per_root, ["root"]).select("node", "keep"))
    gone = join_groups(places, crowd, ["node"]).where(place != F.col("keep"))
    return found.drop("keys"), gone.select("doc_id", "th", "line")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines listed."""
    for b in batches:
        texts = []
        for t, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
            drop = set(gone or ())
            texts.append("\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop))
        at = b.schema.get_field_index("text")
        yield b.set_column(at, "text", pa.array(texts, pa.string()))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_removed and the columns ``keep``: one row per row.

    Lines are compared without white space around them and lower-cased in
    A-Z; a line without a word is never removed. Similar lines (Jaccard of
    their ``size``-character shingles of ``percent`` hundredths or more, and
    chains of such) form a component; its first line by id, then text hash,
    then line number stays, null ids first. Rows that agree in id and text
    are one place and lose the same lines. A null text is empty. An empty
    table gives an empty result; other columns are not read. Lines are told
    apart by 64-bit fingerprints."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), *keep)
    _, gone = repeated_lines(rows.select("doc_id", "th", "text"), size, percent)
    per_text = shared(gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone")))
    some, none = meet(rows, per_text)
    n = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    some = some.withColumn("n_removed", n).drop("th")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields)
    none = none.withColumn("n_removed", F.lit(0).cast("long"))
    return none.drop("th").unionByName(some.mapInArrow(_rebuild, fields).drop("gone"))
