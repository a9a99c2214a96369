"""Document retrieval over a documents table.

Chunking and hashed bag-of-words vectors are per-row column expressions (no
shuffle). Cosine search takes queries in blocks of a fixed size, each one
broadcast matrix and one matrix product per Arrow batch; a per-query top-k
picks the results. Whole texts are processed; nothing is truncated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import PY_SPACE
from ..functions.columns import q
from ..functions.ordering import top_k_per_group
from ..session import written

# Token rule of the hashed bag-of-words (two or more word characters).
TOKEN_PATTERN = r"(?U)\b\w\w+\b"
EMBED_DIM = 768


def collapse_whitespace(c):
    """' '.join(text.split()): runs of whitespace become one space, ends trimmed
    (after the collapse only plain spaces remain, so ``trim`` suffices)."""
    return F.trim(F.regexp_replace(c, PY_SPACE + "+", " "))


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 600, overlap: int = 80, min_chars: int = 40) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap`` over the
    whitespace-collapsed text; chunks with <= ``min_chars`` non-space
    characters are dropped. ``(doc_id, chunk_idx, start, text)``.

    Chunks are cut inside one row with ``transform`` and then exploded, so a
    long document's text is not copied onto each of its chunk rows."""
    step = size - overlap
    # a test that the optimiser cannot make of the whole collapse once more
    some = docs.where(q(text_col).rlike("[^" + PY_SPACE[1:]))
    t = some.select(q(id_col).alias("doc_id"), collapse_whitespace(q(text_col)).alias("_t"))
    pieces = F.expr(f"transform(sequence(0, greatest(length(_t) - 1, 0), {step}), s -> substring(_t, s + 1, {size}))")
    ex = t.select("doc_id", F.posexplode(pieces).alias("chunk_idx", "text"))
    ch = ex.select("doc_id", "chunk_idx", (F.col("chunk_idx") * step).alias("start"), "text")
    return ch.where(F.length(F.trim("text")) > min_chars)


def embed_arrays(frame: DataFrame, id_cols=("doc_id", "chunk_idx"), text_col: str = "text", dims: int = EMBED_DIM) -> DataFrame:
    """D2 as one row per text with a token: ``(*id_cols, dims array<int>,
    weights array<double>)``. Tokens are lower-cased runs of >= 2 word
    characters, bucket ``pmod(xxhash64(token), dims)``, counts L2-normalised.
    A vector depends on its own text alone, so it is made inside the row: no
    shuffle."""
    ids = [q(c) for c in id_cols]
    low = F.lower(q(text_col))
    tokens = F.regexp_extract_all(low, F.lit(TOKEN_PATTERN), 0)
    hashed = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
    # stops at the first token; a test of the array would be made before it, with all tokens taken twice
    rows = frame.where(low.rlike(TOKEN_PATTERN)).select(*ids, F.sort_array(hashed).alias("_h"))
    # sorted buckets: a count is the distance from where a bucket starts to where
    # the next one does, found in one walk along the array
    first = F.transform("_h", lambda h, i: F.when((i == 0) | (h != F.get("_h", i - 1)), i))
    rows = rows.withColumn("_s", F.array_compact(first))
    rows = rows.withColumn("dims", F.transform("_s", lambda s: F.get("_h", s)))
    rows = rows.withColumn("_c", F.transform("_s", lambda s, i: (F.coalesce(F.get("_s", i + 1), F.size("_h")) - s).cast("double")))
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda acc, c: acc + c * c))
    # outside the lambda: inside it the norm would be worked out for each entry
    weights = F.zip_with("_c", F.array_repeat(norm, F.size("_c")), lambda c, n: c / n)
    return rows.select(*ids, "dims", weights.alias("weights"))


def embed_hash(chunks: DataFrame, id_cols=("doc_id", "chunk_idx"), text_col: str = "text", dims: int = EMBED_DIM) -> DataFrame:
    """Hashed bag of words as sparse rows ``(*id_cols, dim, weight)``;
    weights are non-negative and each vector has unit length."""
    ids = [q(c) for c in id_cols]
    rows = embed_arrays(chunks, id_cols, text_col, dims).select(*ids, F.explode(F.arrays_zip("dims", "weights")).alias("_z"))
    return rows.select(*ids, F.col("_z.dims").alias("dim"), F.col("_z.weights").alias("weight"))


# Queries of one block: its matrix, shipped to every task, has about
# queries x dims x 8 bytes = 4096 x 768 x 8 = 24 MiB.
QUERY_BLOCK = 4096
SCORE_DIGITS = 9


def search(
    chunk_arrays: DataFrame,
    query_arrays: DataFrame,
    k: int = 4,
    min_score: float = 0.25,
    chunk_ids=("doc_id", "chunk_idx"),
    query_id: str = "query_id",
    dims: int = EMBED_DIM,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """D3: cosine top-k chunks per query with score > ``min_score`` (3 dp).

    Inputs are ``embed_arrays`` frames (unit vectors). Queries are split by a
    hash of their id into blocks of about ``query_block``; for each block every
    chunk batch is scored with one matrix product in ``mapInArrow``, emitting
    only each batch's top-k per query. A final top-k per query picks the
    winners. The plan is the same for any number of queries."""
    nq = query_arrays.select(q(query_id)).distinct().count()
    blocks = max(1, -(-nq // query_block))
    if blocks > 1:
        # the vectors are made once, however many blocks read them
        chunk_arrays = written(chunk_arrays)
    hits = None
    for b in range(blocks):
        part = query_arrays.where(F.pmod(F.xxhash64(q(query_id)), F.lit(blocks)) == b)
        h = _dense_scores(chunk_arrays, part, k, min_score, list(chunk_ids), query_id, dims)
        hits = h if hits is None else hits.unionByName(h)
    order = [F.col("score").desc(), *[q(c).asc() for c in chunk_ids]]
    top = top_k_per_group(hits, ["query_id"], order, k, rank_name="rank")
    return top.select("query_id", "rank", *[q(c) for c in chunk_ids], F.round("score", 3).alias("score"))


def _dense_scores(chunk_arrays, query_arrays, k, min_score, chunk_ids, query_id, dims) -> DataFrame:
    # about QUERY_BLOCK x dims (the caller splits queries)
    qrows = query_arrays.select(q(query_id).alias("qid"), "dims", "weights").collect()
    qids = [r["qid"] for r in qrows]
    qmat = np.zeros((dims, len(qrows)), dtype=np.float64)
    for j, r in enumerate(qrows):
        qmat[np.asarray(r["dims"], dtype=np.int64), j] = np.asarray(r["weights"], dtype=np.float64)
    bq = chunk_arrays.sparkSession.sparkContext.broadcast((qids, qmat))
    kind = query_arrays.schema[query_id].dataType.simpleString()
    fields = ", ".join(f"`{c}` {chunk_arrays.schema[c].dataType.simpleString()}" for c in chunk_ids)

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qm = bq.value
        qid = pa.array(qid)
        step = max(1, 4_000_000 // max(qm.shape[1], qm.shape[0], 1))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                m = np.zeros((b.num_rows, qm.shape[0]))
                row = np.repeat(np.arange(b.num_rows), np.diff(b.column("dims").offsets.to_numpy()))
                m[row, b.column("dims").flatten().to_numpy()] = b.column("weights").flatten().to_numpy()
                s = np.round(m @ qm, SCORE_DIGITS)
                mask = s > min_score
                if b.num_rows > k:
                    mask &= s >= -np.partition(-s, k - 1, axis=0)[k - 1]
                ri, qi = np.nonzero(mask)
                if len(ri):
                    cols = [b.column(c).take(pa.array(ri)) for c in chunk_ids]
                    yield pa.RecordBatch.from_arrays([qid.take(pa.array(qi)), *cols, pa.array(s[ri, qi])], ["query_id", *chunk_ids, "score"])

    return chunk_arrays.select(*[q(c) for c in chunk_ids], "dims", "weights").mapInArrow(score_batches, f"query_id {kind}, {fields}, score double")


def doc_summary(chunks: DataFrame) -> DataFrame:
    """Chunk count per document."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
