"""Operator 12, byte-level BPE by overlapping chunks.

A text of one chunk is encoded where it is read. A longer one is cut into
chunks that overlap; they are dealt over all tasks and pre-tokenised in
parallel. Two chunks resynchronise at a place in their overlap where both
start a pre-token; the text between such places is a piece that can be
encoded on its own, so the pieces are dealt and encoded in parallel and their
ids are joined in order. Chunks without a common place make one piece.
Decoding concatenates the bytes of the ids."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, buffers, join_groups, per_process, shared, shared_table, text_or_empty

#: characters of a chunk, and how far it reads into the next one
CHUNK, OVERLAP = 1 << 16, 1 << 10
RANKS = "byte_bpe_50k.tiktoken"


def encoding(ranks: str | None = None):
    """The tokenizer of a rank file (a name among the public ones, or a path
    that every worker can open); one for each worker process."""
    name = ranks or RANKS

    def load():
        import public_tokenizers
        import tiktoken

        with open(name if "/" in name else public_tokenizers.path(name), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    return per_process(("ranks", name), load)


def _splitter():
    def load():
        import public_tokenizers
        import regex

        return regex.compile(public_tokenizers.PATTERN)

    return per_process("pattern", load)


def _kind(c: str) -> str:
    """Letter, number, white space or other, as the pattern tells them apart;
    none for characters that are newer than Unicode 3.2 or have moved since, on
    which versions of the tables may differ."""
    old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
    if old == "Cn" or old[0] != new[0]:
        return ""
    if old[0] in "LN":
        return old[0]
    return "s" if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else "o"


def boundaries(text: str) -> np.ndarray:
    """Places where a pre-token of ``text`` starts and the text
    may be cut for good: the character before is no white space (what may
    follow it does not matter) and of another kind than the one after (so the
    place does not depend on where the pre-tokenising began)."""
    out = []
    # a match near the end of the chunk could go on behind it
    for m in _splitter().finditer(text):
        p = m.start()
        if 0 < p <= len(text) - 4 and text[p - 1] != "'":
            x, y = _kind(text[p - 1]), _kind(text[p])
            if x and y and x != "s" and x != y:
                out.append(p)
    return np.array(out, np.int32)


def _encode_short(ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks).encode_to_numpy
        for b in batches:
            _, off = buffers(b.column("text"))
            for i, j in blocks(off):
                ids = [encode(t).tobytes() for t in b.column("text").slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _chunks(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h1, h2, t in zip(*(b.column(c) for c in ("h1", "h2", "text")), strict=True):
                t = t.as_py()
                starts = range(0, len(t), size)
                for k in range(0, len(starts), 64):
                    part = starts[k : k + 64]
                    no = np.arange(k, k + len(part), dtype=np.int32)
                    cols = [pa.array([h.as_py()] * len(part), pa.int64()) for h in (h1, h2)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(no), pa.array([t[s : s + size + overlap] for s in part], pa.string())], ["h1", "h2", "no", "text"])

    return run


def _pre_tokenise(size: int, overlap: int):
    """Chunks with their cut places at the start and behind the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for t in b.column("text").to_pylist():
                p = boundaries(t)
                heads.append(p[p < overlap])
                tails.append(p[p >= size] - size)
            cols = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], ["h1", "h2", "no", "text", "heads", "tails"])

    return run


def _encode_pieces(ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks).encode_to_numpy
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                text = "".join(x["part"] for x in one.column("parts")[0].as_py())
                cols = [one.column("h1"), one.column("h2"), one.column("piece"), pa.array([encode(text).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", "piece", "ids"])

    return run


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            one = b.slice(i, 1)
            ids = b"".join(x["ids"] for x in one.column("pieces")[0].as_py())
            yield pa.RecordBatch.from_arrays([one.column("h1"), one.column("h2"), pa.array([ids], pa.binary())], ["h1", "h2", "ids"])


def _encode_long(texts: DataFrame, ranks: str | None, size: int, overlap: int) -> DataFrame:
    """``texts`` (h1, h2, text; distinct) to h1, h2, ids."""
    key = ["h1", "h2"]
    cut = texts.mapInArrow(_chunks(size, overlap), "h1 long, h2 long, no int, text string")
    # the chunks of one long text go to many tasks
    cut = cut.repartition(F.xxhash64(*key, "no")).mapInArrow(_pre_tokenise(size, overlap), "h1 long, h2 long, no int, text string, heads array<int>, tails array<int>")
    cut = shared_table(cut)
    places = cut.select(*key, "no", "heads", "tails")
    in_text = Window.partitionBy(*key).orderBy("no")
    # place in the chunk where the last chunk and this one resynchronise
    places = places.withColumn("at", F.when(F.col("no") == 0, 0).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(in_text)))))
    places = places.withColumns({"piece": F.count("at").over(in_text), "next": F.lead("at").over(in_text)})
    places = shared(places.select(*key, "no", "piece", F.coalesce("at", F.lit(0)).alias("lo"), (size + F.coalesce("next", F.lit(0))).alias("hi")))
    part = F.expr("substring(text, lo + 1, hi - lo)").alias("part")
    parts = cut.select(*key, "no", "text").join(places, [*key, "no"]).select(*key, "piece", "no", part)
    pieces = parts.groupBy(*key, "piece").agg(F.array_sort(F.collect_list(F.struct("no", "part"))).alias("parts"))
    ids = pieces.mapInArrow(_encode_pieces(ranks), "h1 long, h2 long, piece long, ids binary")
    whole = ids.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))
    return whole.mapInArrow(_join_ids, "h1 long, h2 long, ids binary")


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit): one row per row.

    Each match of the pattern is encoded by the ranks on its own, without
    special tokens, whatever strings the text holds. A null text is empty and
    has no ids. Texts over ``chunk`` characters that agree are encoded once;
    null and repeated ids are kept as they are. A text without a place to cut,
    such as one run of letters, is one piece and is encoded in one task. An
    empty table gives an empty result; other columns are not read. ``ranks``
    is a public tokenizer's name, opened by each worker, or a path. Long texts
    are told apart by two 64-bit hashes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    is_long = F.length("text") > chunk
    short = rows.where(~is_long).mapInArrow(_encode_short(ranks), f"doc_id {kind}, ids binary")
    keyed = rows.where(is_long).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    places = shared(keyed.select("doc_id", "h1", "h2"))
    if places.isEmpty():
        return short
    texts = keyed.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    encoded = shared_table(_encode_long(texts, ranks, chunk, overlap))
    return short.unionByName(join_groups(places, encoded, ["h1", "h2"]).select("doc_id", "ids"))


def _decode(ranks: str | None, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks)
        tokens = pa.array([own.decode_single_token_bytes(i) for i in range(own.n_vocab)], pa.binary())
        for b in batches:
            raw, off = buffers(b.column("ids"))
            for i, j in blocks(off, 1 << 22):
                bytes_, ends = buffers(tokens.take(pa.array(raw[off[i] : off[j]].view("<u4"))))
                at = ends[(off[i : j + 1] - off[i]) // 4]
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(bytes_)])
                yield pa.RecordBatch.from_arrays([b.column(id_name).slice(i, j - i), b.column("ids").slice(i, j - i), text.cast(pa.binary())], [id_name, "ids", "decoded"])

    return run


def decode(encoded: DataFrame, ranks: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """The rows' id and ids with ``decoded``, the bytes of the ids one after
    the other (they need not end at a character). Null ids, like none, decode to
    nothing."""
    rows = encoded.select(id_col, F.coalesce("ids", F.lit(b"")).alias("ids"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_decode(ranks, id_col), f"`{id_col}` {kind}, ids binary, decoded binary")
