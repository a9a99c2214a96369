"""Operator 7, repeated passages by prefix-free parsing.

A rolling hash runs over every text; its minimum in each window of a passage's
length is a trigger. Triggers cut the corpus into phrases that overlap by the
hashed bytes, and equal passages are cut alike, since a passage's own bytes
decide its triggers. The dictionary holds each distinct phrase with the bytes
around it once; the parse says where it occurs.

A passage is a suffix of a dictionary entry, cut at ``length`` bytes, and lies
whole in that entry. Two suffix arrays give the corpus order to that depth. The
parse is sorted by phrase and place: of a repeated entry all suffixes repeat,
and its first occurrence speaks for it. The dictionary is sorted by the bytes
of its suffixes, trigger by trigger, since equal passages have one trigger; only
entries that share a trigger but differ around it, at the ends of a copy or
near an edit, need it. Neighbours that agree in ``length`` bytes are one
passage, whose earliest place in the parse stays. The bytes of all other text
never leave their partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import meet
from .common import Spans, _byte_codes, blocks, buffers, join_groups, mix64, shared, shared_table, text_or_empty

LENGTH = 100
#: bytes that the rolling hash covers, a power of two
GRAM = 32
#: triggers with more dictionary entries than this are not sorted in one task
HOT_ROWS = 20_000
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _rolling(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of raw[i:i + gram] for each i, by doubling."""
    h, base = _byte_codes(3)[raw], 0x9E3779B97F4A7C15 | 1
    k = 1
    while k < gram:
        h = h[:-k] * np.uint64(base) + h[k:]
        base = base * base & 0xFFFFFFFFFFFFFFFF
        k *= 2
    return mix64(h)


def triggers(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of passage starts that have the same trigger: (row, first start
    within the block, number of starts, trigger place, trigger hash)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if len(raw) < length:
        return none
    h = _rolling(raw, gram)
    bits = np.uint64(int(len(h)).bit_length())
    low = np.uint64((1 << int(bits)) - 1)
    # the least hash, and of equal ones the last place
    m = ((h >> bits) << bits) | (low - np.arange(len(h), dtype=np.uint64))
    width, k = length - gram + 1, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if width > k:
        m = np.minimum(m[: len(m) - (width - k)], m[width - k :])
    at = (low - (m & low)).astype(np.int64)
    # starts whose passage lies inside one row
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    fits = np.arange(len(at)) + length <= offsets[1:][row_of]
    start = np.flatnonzero(fits)
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (at[start][1:] != at[start][:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    s = start[first]
    return row_of[s], s, count, at[s], h[at[s]]


def _scan_phrases(length: int, gram: int):
    """The parse: trigger hash, dictionary entry (a hash of the bytes of all
    passages of the run), place, number of starts. Of equal entries in one
    batch only the first goes on to its trigger's group; the others are known
    to be copies (``known``) and get a key of their own, so a phrase that is
    everywhere does not fill one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = buffers(b.column("text"))
            parts = []
            for i, j in blocks(off):
                r, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                row, start, count, at, f = triggers(r, o, length, gram)
                if len(row):
                    entry = mix64(Spans(r).hash(start, start + count + length - 1) + (at - start).astype(np.uint64) + f)
                    parts.append((i + row, start - o[row], count, f, entry))
            if not parts:
                continue
            row, start, count, f, entry = (np.concatenate(x) for x in zip(*parts, strict=True))
            # order of texts in the batch; texts that agree in id and hash are one place
            ids = pa.table({"doc_id": b.column("doc_id"), "th": b.column("th")})
            by = pc.sort_indices(ids, sort_keys=[("doc_id", "ascending"), ("th", "ascending")], null_placement="at_start").to_numpy()
            th, same_id = b.column("th").to_numpy()[by], _equal_to_last(b.column("doc_id").take(pa.array(by)))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(~(same_id & np.append(False, th[1:] == th[:-1])))
            order = np.lexsort((start, rank[row], entry))
            e, k, s = entry[order], rank[row][order], start[order]
            head = np.ones(len(e), bool)
            head[1:] = e[1:] != e[:-1]
            first = np.maximum.accumulate(np.where(head, np.arange(len(e)), 0))
            later = (k != k[first]) | (s != s[first])
            use = order[head | later]
            known = later[head | later]
            key = np.where(known, mix64(entry[use] ^ (row[use].astype(np.uint64) << np.uint64(32)) ^ start[use].astype(np.uint64)), f[use])
            take = pa.array(row[use])
            cols = [pa.array(key.view(np.int64)), pa.array(entry[use].view(np.int64)), b.column("doc_id").take(take), b.column("th").take(take)]
            cols += [pa.array(start[use].astype(np.int32)), pa.array(count[use].astype(np.int32)), pa.array(known)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "entry", "doc_id", "th", "start", "n", "known"])

    return run


def _equal_to_last(col: pa.Array) -> np.ndarray:
    """Whether each value equals the one before it (null equals null)."""
    if len(col) < 2:
        return np.zeros(len(col), bool)
    a, b = col.slice(0, len(col) - 1), col.slice(1)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return np.append(False, np.asarray(pc.or_(pc.fill_null(pc.equal(a, b), False), both)))


def _scan_contexts(length: int):
    """The bytes of all passages of the wanted runs of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column("runs")
            ends = runs.offsets.to_numpy()
            flat = runs.flatten()
            row = pa.array(np.repeat(np.arange(b.num_rows), np.diff(ends)))
            raw, off = buffers(b.column("text"))
            start, n, f, hot = (flat.field(c) for c in ("start", "n", "f", "hot"))
            lo = off[np.asarray(row)] + start.to_numpy()
            hi = lo + n.to_numpy() + length - 1
            data = raw.tobytes()
            text = pa.array([data[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
            cols = [f, b.column("doc_id").take(row), b.column("th").take(row), start, n, hot, text]
            yield pa.RecordBatch.from_arrays(cols, ["f", "doc_id", "th", "start", "n", "hot", "bytes"])

    return run


def suffix_ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """The suffix array of ``raw`` to a depth of ``length`` bytes, inverted:
    ranks of the strings raw[i:i + length] in byte order, equal ones alike.
    Eight bytes are one number; then prefix doubling on ranks, the last step
    with an overlap. Only strings that do not reach over the end count."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    step = 8 if length >= 8 else 1
    padded = np.append(raw, np.zeros(length, np.uint8)).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(step):
        word = (word << np.uint64(8)) | padded[k : n + k]
    rank = _dense(word)
    while step < length:
        # strings of twice the depth, or of the wanted one from two that overlap
        wide = min(2 * step, length)
        after = np.zeros(n, np.int64)
        after[: max(n - wide + step, 0)] = rank[wide - step :] + 1
        rank, step = _dense((rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)), wide
    return rank


def _dense(x: np.ndarray) -> np.ndarray:
    """Numbers to their ranks from 0, equal ones alike."""
    order = np.argsort(x)
    up = np.zeros(len(x), np.int64)
    up[1:] = x[order[1:]] != x[order[:-1]]
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(up)
    return rank


def _passages(bytes_: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the rows, row, offset and place in the bytes of each passage)."""
    raw, off = buffers(bytes_)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return raw, row, at, off[row] + at


def _rank_suffixes(length: int):
    """Rows sorted by trigger and place, to the runs of passages that come
    earlier in another row of the same trigger. Ranks in the suffix array of
    the rows' bytes tell equal passages, which have the same trigger."""

    def later(t: pa.Table) -> pa.RecordBatch:
        n = t.column("n").to_numpy().astype(np.int64)
        same = [_equal_to_last(t.column(c).combine_chunks()) for c in ("f", "doc_id", "th", "start")]
        place = np.cumsum(~(same[0] & same[1] & same[2] & same[3]))
        raw, row, at, where = _passages(t.column("bytes").combine_chunks(), n)
        key = suffix_ranks(raw, length)[where]
        order = np.lexsort((place[row], key))
        k, p = key[order], place[row][order]
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
        flag = np.zeros(len(k), bool)
        flag[order] = p != p[first]
        opens = flag.copy()
        opens[1:] &= ~flag[:-1] | (at[1:] == 0)
        lo = np.flatnonzero(opens)
        count = np.add.reduceat(flag.astype(np.int32), lo) if len(lo) else np.zeros(0, np.int32)
        take = pa.array(row[lo])
        t = t.combine_chunks()
        start = (t.column("start").to_numpy()[row[lo]] + at[lo]).astype(np.int32)
        cols = [t.column("doc_id").combine_chunks().take(take), t.column("th").combine_chunks().take(take), pa.array(start), pa.array(count.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            f = t.column("f").to_numpy()
            # the last trigger's rows may go on in the next batch
            cut = int(np.flatnonzero(f[:-1] != f[1:])[-1]) + 1 if len(f) and f[0] != f[-1] else 0
            if cut:
                yield later(t.slice(0, cut))
            left = t.slice(cut)
        if left is not None and len(left):
            yield later(left)

    return run


def _hash_suffixes(length: int):
    """Each passage of the rows with its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, row, at, where = _passages(b.column("bytes"), b.column("n").to_numpy().astype(np.int64))
            h = Spans(raw, 5).hash(where, where + length)
            take = pa.array(row)
            start = (b.column("start").to_numpy()[row] + at).astype(np.int32)
            cols = [b.column("doc_id").take(take), b.column("th").take(take), pa.array(start), pa.array(h.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "start", "h"])

    return run


def _cut(length: int):
    """Texts and their repeated starts to bytes kept and spans removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, starts, ns = b.column("text"), b.column("starts"), b.column("ns")
            kept, spans, size, gone = [], [], [], []
            for i in range(b.num_rows):
                t = (texts[i].as_py() or "").encode()
                s, n = np.array(starts[i].values, np.int64), np.array(ns[i].values, np.int64)
                order = np.argsort(s, kind="stable")
                s, e = s[order], (s + n + length - 1)[order]
                reach = np.maximum.accumulate(e)
                new = np.ones(len(s), bool)
                new[1:] = s[1:] > reach[:-1]
                lo, hi = s[new], np.append(reach[:-1][new[1:]], reach[-1])
                kept.append(b"".join(t[x:y] for x, y in zip([0, *hi], [*lo, len(t)], strict=True)))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)])
                size.append(len(t))
                gone.append(int((hi - lo).sum()))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "spans", "kept_bytes"])

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end in bytes), kept_bytes.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``length``
    bytes that covers it also starts earlier in the corpus: in a smaller id,
    or in the same text further left. Null ids come first; of texts with one
    id the one with the smaller hash does, and rows that agree in id and text
    are one place. A text under ``length`` bytes loses nothing. kept_bytes may
    end inside a character. An empty table gives an empty result; other
    columns are not read."""
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    id_ = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, th long"
    parse = texts.mapInArrow(_scan_phrases(length, gram), f"key long, entry long, {id_}, start int, n int, known boolean").repartition("key")
    group = Window.partitionBy("key")
    parse = parse.withColumn("r", F.rank().over(Window.partitionBy("key", "entry").orderBy("doc_id", "th", "start")))
    parse = parse.withColumns({"lo": F.min("entry").over(group), "hi": F.max("entry").over(group), "g": F.count(F.lit(1)).over(group)})
    copy = (F.col("known") | (F.col("r") > 1)).alias("copy")
    found = parse.where("known or r > 1 or lo < hi").select("doc_id", "th", "start", "n", F.col("key").alias("f"), copy, (F.col("g") > HOT_ROWS).alias("hot"))
    found = shared_table(found)
    copies = found.where("copy").select("doc_id", "th", "start", "n")

    ends = found.where("not copy").groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n", "f", "hot")).alias("runs"))
    about, _ = meet(texts, shared(ends))
    contexts = about.where("runs is not null").mapInArrow(_scan_contexts(length), f"f long, {id_}, start int, n int, hot boolean, bytes binary")
    contexts = shared_table(contexts)
    cold = contexts.where("not hot").drop("hot").repartition("f").sortWithinPartitions("f", "doc_id", "th", "start")
    later = cold.mapInArrow(_rank_suffixes(length), f"{id_}, start int, n int")
    # triggers with very many entries: their suffixes are grouped over all partitions
    place = F.struct("doc_id", "th", "start")
    wide = contexts.where("hot").mapInArrow(_hash_suffixes(length), f"{id_}, start int, h long")
    firsts = shared(wide.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    more = join_groups(wide, firsts, ["h"]).where(place != F.col("first")).select("doc_id", "th", "start", F.lit(1).alias("n"))

    every = copies.unionByName(later).unionByName(more)
    per_text = every.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("r"))
    some, none = meet(texts, shared(per_text.select("doc_id", "th", F.col("r.start").alias("starts"), F.col("r.n").alias("ns"))))
    out = f"{id_.split(',')[0]}, n_bytes long, n_removed long, spans {_SPANS}, kept_bytes binary"
    cut = some.where("starts is not null").select("doc_id", "text", "starts", "ns").mapInArrow(_cut(length), out)
    whole = none.select("doc_id", "text").unionByName(some.where("starts is null").select("doc_id", "text")).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast(_SPANS).alias("spans"),
        F.col("text").cast("binary").alias("kept_bytes"),
    )
    return whole.unionByName(cut)
