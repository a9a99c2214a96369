"""Operator 13, ranked lexical search by LEMP-style norm buckets.

A document is a vector of integer impacts over the terms that some item
holds, an item a vector of term weights, and a score is their inner product.
For the bounds both are scaled by the root of the weight. Vectors are ordered
by length: the longest ones are searched first and give every item a score to
beat. By Cauchy-Schwarz an item skips all buckets that are too short for that
score; inside a bucket the item's heaviest coordinates give each vector its
own bound; what survives is scored again exactly in integers. Every task keeps
the best ``k`` of its vectors for an item, and the best of these are the
result. Items come in blocks whose terms are bounded, so what is broadcast is
bounded too; the texts are read once for all blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import key_filter, maybe
from .common import Spans, blocks, buffers, lower_ascii, shared, shared_table, text_or_empty, word_spans

#: items and terms of a block of items (an item with more terms is a block)
ITEMS, TERMS = 1 << 10, 1 << 18
#: about so many of the longest vectors are searched first
FIRST = 1 << 12
#: relative slack of bounds, far above the rounding of doubles
SLACK = 1e-9

_BREAK = np.ones(256, bool)
_BREAK[128:] = False
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _BREAK[ord(_a) : ord(_b) + 1] = False


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of the terms, first term of each row)."""
    raw = lower_ascii(raw)
    start, end, first = word_spans(raw, offsets, _BREAK)
    return Spans(raw).hash(start, end).view(np.int64), first


def _counted(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms by row, their counts, first of each row)."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(row[at], np.arange(n + 1))


def _scan(filter_, id_name: str):
    """id, n, and the distinct terms that ``filter_`` lets through with their
    counts; rows without a term are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = buffers(b.column("text"))
            for i, j in blocks(off):
                h, first = _terms(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                if filter_ is not None and len(h):
                    some = maybe(filter_, h)
                    h, row = h[some], row[some]
                term, tf, ends = _counted(h, row, len(n))
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (term, tf.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(id_name).slice(i, j - i), pa.array(n), *lists], [id_name, "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return run


def _lengths(block, n_docs: int, n_terms: int):
    """Documents as impact vectors over the block's terms, with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, _ = block.value
        for b in batches:
            lists, n = b.column("terms"), b.column("n").to_numpy().astype(np.int64)
            ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            flat, tf = flat[ends[0] : ends[-1]], b.column("tfs").values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
            row = np.repeat(np.arange(len(n)), np.diff(ends))
            at = np.minimum(np.searchsorted(terms, flat), max(len(terms) - 1, 0))
            some = terms[at] == flat if len(terms) else np.zeros(len(flat), bool)
            at, tf, row = at[some], tf[some], row[some]
            m = 100 - 90 + 90 * n * n_docs // n_terms
            x = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
            length = np.sqrt(np.bincount(row, weight[at] * x.astype(np.float64) ** 2, len(n)))
            first = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(v)) for v in (at.astype(np.int32), x)]
            cols = [b.column("_r"), b.column("doc_id"), pa.array(length), *lists]
            yield pa.RecordBatch.from_arrays(cols, ["_r", "doc_id", "length", "at", "x"]).filter(pa.array(length > 0))

    return run


class Bucket:
    """Vectors of one bucket, by row and by coordinate."""

    def __init__(self, at: np.ndarray, x: np.ndarray, first: np.ndarray, length: np.ndarray, root: np.ndarray):
        self.at, self.x, self.first, self.length = at, x, first, length
        row = np.repeat(np.arange(len(length)), np.diff(first))
        order = np.argsort(at, kind="stable")
        self.row, self.value = row[order], root[at[order]] * x[order]
        self.of_term = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(root)))])

    def bounds(self, item: np.ndarray, root: np.ndarray, beat: float) -> np.ndarray:
        """An upper bound of each vector's score: its product with the item
        over the item's heaviest coordinates, and Cauchy-Schwarz over the
        rest. So many coordinates are used that a vector with none of them
        cannot reach ``beat``."""
        q = root[item]
        rest = np.sqrt(np.maximum(np.cumsum((q * q)[::-1])[::-1], 0))
        rest = np.append(rest[1:], 0.0)
        enough = np.flatnonzero(rest * self.length.max() * (1 + SLACK) < beat)
        use = int(enough[0]) + 1 if len(enough) else len(item)
        lists = [slice(self.of_term[t], self.of_term[t + 1]) for t in item[:use].tolist()]
        row = np.concatenate([self.row[s] for s in lists])
        value = np.concatenate([self.value[s] for s in lists])
        part = np.bincount(row, value * np.repeat(q[:use], [s.stop - s.start for s in lists]), len(self.length))
        left = np.maximum(self.length**2 - np.bincount(row, value * value, len(self.length)), 0)
        return part + rest[use - 1] * np.sqrt(left)

    def scores(self, rows: np.ndarray, item_weight: np.ndarray) -> np.ndarray:
        """Exact scores; ``item_weight`` has a weight for each term."""
        n = np.diff(self.first)[rows]
        ends = np.cumsum(n)
        at = np.repeat(self.first[:-1][rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return np.add.reduceat(item_weight[self.at[at]] * self.x[at], ends - n) if len(rows) else np.zeros(0, np.int64)


def _order(id_, score: int) -> tuple:
    return -score, id_ is not None, id_


def search_bucket(bucket: Bucket, ids: pa.Array, item: np.ndarray, weight: np.ndarray, root: np.ndarray, item_weight: np.ndarray, best: list, beat: int, k: int) -> list:
    """``best`` (at most k of (id, score), in order) after the bucket; vectors
    that score less than ``beat`` may be left out."""
    need = max(beat, best[-1][1] if len(best) == k else 0, 1)
    if np.sqrt((root[item] ** 2).sum()) * bucket.length.max() * (1 + SLACK) < need:
        return best
    bound = bucket.bounds(item, root, need) * (1 + SLACK)
    rows = np.flatnonzero(bound >= need)
    rows = rows[np.argsort(-bound[rows], kind="stable")]
    item_weight[item] = weight[item]
    step = 4 * k
    while len(rows):
        # the most promising ones raise the score to beat for the others
        now, rows = rows[:step], rows[step:]
        step *= 2
        score = bucket.scores(now, item_weight)
        good = np.flatnonzero(score >= need)
        if len(good):
            found = zip(ids.take(pa.array(now[good])).to_pylist(), score[good].tolist(), strict=True)
            best = sorted([*best, *found], key=lambda x: _order(*x))[:k]
            need = max(need, best[-1][1] if len(best) == k else 0)
        rows = rows[bound[rows] >= need]
    item_weight[item] = 0
    return best


def _search(block, beat, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, items = block.value
        root = np.sqrt(weight.astype(np.float64))
        item_weight = np.zeros(len(terms), np.int64)
        best: list[list] = [[] for _ in items]
        kind = None
        for b in batches:
            kind = b.schema.field("doc_id").type
            if not b.num_rows:
                continue
            first = b.column("at").offsets.to_numpy().astype(np.int64)
            flat = [b.column(c).values.to_numpy()[first[0] : first[-1]] for c in ("at", "x")]
            bucket = Bucket(flat[0], flat[1], first - first[0], b.column("length").to_numpy(), root)
            for q, item in enumerate(items):
                if len(item):
                    best[q] = search_bucket(bucket, b.column("doc_id"), item, weight, root, item_weight, best[q], beat[q], k)
        if kind is not None:
            rows = [(q, id_, s) for q, found in enumerate(best) for id_, s in found]
            cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["q", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """(item_id, terms) in blocks that hold a bounded number of terms."""
    out, size = [], 0
    for r in items.toLocalIterator():
        if out and (len(out) == ITEMS or size + len(r["terms"]) > TERMS):
            yield out
            out, size = [], 0
        out.append((r["item_id"], np.array(r["terms"], np.int64)))
        size += len(r["terms"])
    if out:
        yield out


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _search_block(block: list, vectors: DataFrame, dfs: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """q, rank, doc_id, score for the items of a block."""
    spark = vectors.sparkSession
    wanted = np.unique(np.concatenate([t for _, t in block]))
    asked = spark.createDataFrame([(int(t),) for t in wanted], "term long")
    df = {r["term"]: r["df"] for r in dfs.join(F.broadcast(asked), "term").collect()}
    terms = np.array(sorted(df), np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms.tolist()], np.int64)
    numbers = [np.searchsorted(terms, t[np.isin(t, terms)]) for _, t in block]
    # the numbers of each item's terms that documents hold, heaviest first
    own = [t[np.argsort(-weight[t], kind="stable")] for t in numbers]
    sent = spark.sparkContext.broadcast((terms, weight, own))
    kind = vectors.schema["doc_id"].dataType.simpleString()
    out = f"q int, doc_id {kind}, score long"
    sized = shared_table(vectors.mapInArrow(_lengths(sent, n_docs, n_terms), f"_r long, doc_id {kind}, length double, at array<int>, x array<long>"))
    count, cut = sized.agg(F.count(F.lit(1)), F.percentile_approx("length", 1 - min(1.0, FIRST / max(n_docs, 1)), 10_000)).first()
    if not count:
        return spark.createDataFrame([], f"q int, rank int, doc_id {kind}, score long")

    def by_length(v: DataFrame) -> DataFrame:
        order = (F.desc("length"), F.col("_r"))
        return v.repartitionByRange(*order).sortWithinPartitions(*order)

    longest = by_length(sized.where(F.col("length") >= cut)).mapInArrow(_search(sent, [0] * len(block), k), out)
    seen = shared(_best(longest, k))
    beat = [0] * len(block)
    for r in seen.where(F.col("rank") == k).collect():
        beat[r["q"]] = r["score"]
    # no item can use a shorter vector
    norms = [math.sqrt(float(weight[t].sum())) for t in own]
    least = min((b / n for b, n in zip(beat, norms, strict=True) if n), default=0.0) * (1 - SLACK)
    others = by_length(sized.where((F.col("length") < cut) & (F.col("length") >= least))).mapInArrow(_search(sent, beat, k), out)
    return _best(seen.select("q", "doc_id", "score").unionByName(others), k).select("q", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 10,
) -> DataFrame:
    r"""item_id, rank, doc_id, score: for each item its ``k`` best documents
    with a score above 0.

    Terms are runs of ASCII letters, digits and all characters behind ASCII,
    lower-cased in A-Z. With N documents that hold a term, L terms in all of
    them and n in one, m = 10 + 90 * n * N div L; a term that df documents hold
    weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))), and an item scores the
    sum of w * (10^9 tf div (1000 tf + 8 m)) over its distinct terms. Equal
    scores go by ascending id, null ids first; rows that repeat are documents
    of their own. Items that agree in id and text are one item. Null and empty
    texts hold no term and are in no result; an empty table on either side
    gives an empty result; other columns are not read. Terms are told apart by
    64-bit fingerprints."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    asked = items.select(F.col(item_id_col).alias("item_id"), text_or_empty(item_text_col).alias("text")).distinct()
    item_kind, kind = asked.schema["item_id"].dataType.simpleString(), rows.schema["doc_id"].dataType.simpleString()
    asked = shared(asked.mapInArrow(_scan(None, "item_id"), f"item_id {item_kind}, n long, terms array<long>, tfs array<int>"))
    result = f"item_id {item_kind}, rank int, doc_id {kind}, score long"
    vocabulary = shared(asked.select(F.explode("terms").alias("term")).distinct())
    filter_ = key_filter(vocabulary, vocabulary.count(), "term")
    vectors = rows.mapInArrow(_scan(filter_, "doc_id"), f"doc_id {kind}, n long, terms array<long>, tfs array<int>")
    vectors = shared_table(vectors.withColumn("_r", F.monotonically_increasing_id()))
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    dfs = shared(vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    found = spark.createDataFrame([], result)
    for block in _blocks(asked.select("item_id", "terms")):
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"q int, item_id {item_kind}")
        part = shared(_search_block(block, vectors, dfs, n_docs, n_terms, k)).join(F.broadcast(names), "q")
        found = found.unionByName(part.select("item_id", "rank", "doc_id", "score"))
    return found
