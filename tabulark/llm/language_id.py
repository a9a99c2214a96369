"""Operator 1, language ID by averaged hashed subword embeddings.

A text is the mean of the embeddings of its byte n-grams inside words (word
ends marked), hashed to ``BUCKETS`` rows, under a linear softmax. Embeddings
and weights are trained together by stochastic gradient descent in numpy on a
bounded sample; a temperature and a rejection threshold are then calibrated on
sample rows kept out of training. Since the softmax is linear in the mean, the
two matrices are multiplied once and workers only add up table rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, buffers, text_or_empty

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
DIM = 16
#: rows of each language that are sampled at most, and characters of each
PER_LANG = 400
SAMPLE_CHARS = 1 << 16
EPOCHS, RATE = 6, 4.0
#: wanted error rate among accepted texts
ERROR = 0.01

#: ASCII bytes other than letters mark word ends; bytes from 0x80 are letters
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def hashed_grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: (bucket of every n-gram inside a word, with one
    mark on either side; index of the first n-gram of each text)."""
    n = len(offsets) - 1
    # two marks between texts, so that no n-gram crosses them
    x = np.full(len(raw) + 2 * n + 2, 32, np.uint8)
    x[np.arange(len(raw)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1] = _FOLD[raw]
    starts = offsets + 2 * np.arange(n + 1)
    space = x == 32
    code = x.astype(np.uint32)
    inner = np.zeros(len(x), bool)
    for k in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint32(0x01000193) + x[k - 1 :]
        inner = inner[:-1] | space[k - 2 : len(x) - 1] if k > 2 else inner[:-1]
        if k not in GRAMS:
            continue
        keep = np.flatnonzero(~(inner | (space[: len(code)] & space[k - 1 :])))
        h = code[keep] * np.uint32(0x9E3779B1) + np.uint32(k)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        yield ((h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int32), np.searchsorted(keep, starts)


def means(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean over each text's n-grams of ``table`` (columns, BUCKETS), as
    (texts, columns); zeros for a text without n-grams."""
    total = np.zeros((len(offsets) - 1, len(table)))
    count = np.zeros(len(offsets) - 1)
    for bucket, first in hashed_grams(raw, offsets):
        some = np.diff(first) > 0
        count += np.diff(first)
        if some.any():
            for c, column in enumerate(table):
                total[some, c] += np.add.reduceat(column[bucket], first[:-1][some], dtype=np.float64)
    return total / np.maximum(count, 1)[:, None]


def has_letter(raw: np.ndarray, offsets: np.ndarray, text) -> np.ndarray:
    """Whether each text has a letter; ``text(i)`` is asked for only where no
    ASCII letter decides it."""
    s = np.concatenate([[0], np.cumsum((_FOLD[raw] != 32) & (raw < 128), dtype=np.int64)])
    out = s[offsets[1:]] > s[offsets[:-1]]
    s = np.concatenate([[0], np.cumsum(raw >= 128, dtype=np.int64)])
    for i in np.flatnonzero(~out & (s[offsets[1:]] > s[offsets[:-1]])):
        out[i] = any(map(str.isalpha, text(int(i))))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Languages, the table (columns, BUCKETS), the map from its columns to
    class scores (None: they are the scores), temperature, threshold."""

    def __init__(self, langs, table, to_class, temperature, threshold):
        self.langs, self.table, self.to_class = langs, table, to_class
        self.temperature, self.threshold = temperature, threshold

    def arrays(self) -> tuple:
        return self.langs, self.table, self.to_class, self.temperature, self.threshold

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = means(raw, offsets, self.table)
        if self.to_class is not None:
            z = z @ self.to_class
        return softmax(z / self.temperature)


def train(texts: list[str], langs: list[str], held: np.ndarray, seed: int = 3) -> Model:
    """SGD over whole texts; rows with ``held`` only calibrate."""
    classes = sorted(set(langs), key=lambda x: x.encode())
    y = np.array([classes.index(v) for v in langs])
    docs = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        all_ = np.concatenate([b for b, _ in hashed_grams(raw, np.array([0, len(raw)]))])
        b, n = np.unique(all_, return_counts=True)
        docs.append((b, (n / max(len(all_), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(classes))).astype(np.float32)
    learn = np.flatnonzero(~held)
    if not len(learn):
        learn = np.arange(len(docs))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(learn):
            b, f = docs[i]
            if not len(b):
                continue
            v = f @ emb[b]
            g = softmax((v @ w)[None])[0]
            g[y[i]] -= 1
            back = w @ g
            w -= np.float32(0.1 * rate) * np.outer(v, g)
            emb[b] -= np.float32(rate) * f[:, None] * back
    z = np.stack([f @ emb[b] if len(b) else np.zeros(DIM, np.float32) for b, f in docs]) @ w
    check = np.flatnonzero(held) if held.any() else np.arange(len(docs))
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    nll = [-np.log(np.maximum(softmax(z[check] / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(nll))])
    p = softmax(z[check] / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y[check]
    order = np.argsort(-top, kind="stable")
    wrong = np.cumsum(~right[order])
    fits = np.flatnonzero(wrong <= ERROR * np.arange(1, len(order) + 1))
    threshold = 0.0 if not len(fits) or fits[-1] == len(order) - 1 else float(top[order[fits[-1]]])
    if len(classes) <= DIM:
        return Model(classes, np.ascontiguousarray((emb @ w).T), None, temperature, threshold)
    return Model(classes, np.ascontiguousarray(emb.T), w.astype(np.float64), temperature, threshold)


def _predict(shared_model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared_model.value)
        names = np.array([*model.langs, "und"], object)
        for b in batches:
            col = b.column("text")
            raw, off = buffers(col)
            for i, j in blocks(off):
                r, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                p = model.probabilities(r, o)
                best = p.argmax(axis=1)
                score = p[np.arange(j - i), best]
                none = ~has_letter(r, o, lambda k, i=i, col=col: col[i + k].as_py())
                best, score = np.where(none, len(model.langs), best), np.where(none, 0.0, np.clip(score, 0, 1))
                cols = [b.column("doc_id").slice(i, j - i), b.column("held_out").slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score)]
                cols.append(pa.array(~none & (score >= model.threshold)))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted: one row per row.

    Learns from rows with a known language whose crc32(id as text) mod 4 is
    not 2 (0 and 1 train, 3 calibrates); a null id is never learned from and
    counts as not held out. ``per_lang`` bounds the sample: at most so many rows
    of each language, drawn row by row whatever ids or texts repeat, of which
    training reads ``SAMPLE_CHARS`` characters each; predictions read whole
    texts. A text that is null or has
    no letter is ``und`` with score 0, and so is every text where no row can
    be learned from. ``accepted`` is the calibrated decision: accepted texts
    have an expected error of at most ``ERROR``. Only id, text and language
    are read; the language never enters a prediction."""
    spark = docs.sparkSession
    rest = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))
    known = docs.where(F.col(lang_col).isNotNull() & (rest != 2))
    counts = {x.lang: x.n for x in known.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(rest == 2, F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("text"))
    if not counts:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    # about twice the wanted rows, drawn row by row so that repeated ids and texts
    # are neither all in nor all out; the first of them by the draw are taken
    share = spark.createDataFrame([(k, min(1 << 20, int((1 << 20) * 2 * per_lang / n) + 1)) for k, n in counts.items()], "_lang string, _share int")
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(id_col), F.monotonically_increasing_id()), F.lit(1 << 20))
    drawn = known.select(F.col(lang_col).cast("string").alias("_lang"), (rest == 3).alias("held"), F.substring(text_or_empty(text_col), 1, SAMPLE_CHARS).alias("text"), draw.alias("o"))
    drawn = drawn.join(F.broadcast(share), "_lang").where(F.col("o") < F.col("_share"))
    first = F.row_number().over(Window.partitionBy("_lang").orderBy("o", F.xxhash64("text")))
    sample = drawn.withColumn("r", first).where(F.col("r") <= per_lang).select("_lang", "held", "text", "o").toPandas()
    sample = sample.sort_values(["_lang", "o", "text"])
    model = train(sample["text"].tolist(), sample["_lang"].tolist(), sample["held"].to_numpy(bool))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean"
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model.arrays())), out)
