"""Operator 10, quality rules by an isolation forest on rule statistics.

Base statistics come from whole texts in one vectorised pass. An isolation
forest is fitted on a bounded, documented sample of labelled rows; every
document's mean path length over the random splits gives its anomaly score,
and the rejecting threshold is calibrated on all labelled rows from a
histogram of scores, so that at most ``MAX_LOSS`` of the good ones go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, blocks, buffers, chain, segment_ids, shared, text_or_empty, word_spans

#: labelled rows the forest is fitted on, about this many (a uniform hash sample)
SAMPLE_ROWS = 8192
TREES, SUBSAMPLE, DEPTH = 128, 256, 10
MAX_LOSS = 0.001
BINS = 4096
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct_words", "n_letters", "n_chars")
_SCHEMA = "doc_id {id}, th long, " + ", ".join(f"{c} long" for c in BASE + MORE)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: letters as bytes: ASCII letters, and lead bytes of longer characters
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xF5] = True


def _repeats(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where the (doc, key) pair occurs at least twice."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each doc."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def block_statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text of a block of UTF-8 bytes."""
    n = len(offsets) - 1
    start, end, first = word_spans(raw, offsets)
    counts = np.diff(first)
    doc = segment_ids(counts)

    def per_doc(flag: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return s[offsets[1:]] - s[offsets[:-1]]

    point = (raw & 0xC0) != 0x80
    in_word = np.zeros(len(raw) + 1, np.int8)
    in_word[start] += 1
    np.subtract.at(in_word, end, 1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    out = {"n_words": counts, "word_chars": per_doc(point & in_word), "n_symbols": per_doc(_SYMBOL[raw])}

    spans = Spans(raw)
    word = spans.hash(start, end)
    cover = np.zeros(len(word) + 1, np.int64)
    if len(word) >= WINDOW:
        m = len(word) - WINDOW + 1
        inside = doc[:m] == doc[WINDOW - 1 :]
        w = np.flatnonzero(inside)
        key = chain([word[i : i + m] for i in range(WINDOW)])[w]
        hit = w[_repeats(key, doc[w])]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    out["n_repeat_words"] = covered[first[1:]] - covered[first[:-1]]
    out["n_distinct_words"] = _distinct(word, doc, n)

    # lines: \n-split pieces of each text that hold a word
    newline = np.flatnonzero(raw == 10)
    bounds = np.unique(np.concatenate([offsets, newline + 1]))
    lo, hi = bounds[:-1], bounds[1:].copy()
    ends_in_newline = raw[hi - 1] == 10 if len(raw) else np.zeros(0, bool)
    hi -= ends_in_newline
    has_word = np.searchsorted(start, hi) > np.searchsorted(start, lo)
    lo, hi = lo[has_word], hi[has_word]
    line_doc = np.searchsorted(offsets, lo, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    out["n_lines"] = n_lines
    out["n_dup_lines"] = n_lines - _distinct(spans.hash(lo, hi), line_doc, n)
    out["n_letters"] = per_doc(_LETTER[raw])
    out["n_chars"] = per_doc(point)
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = buffers(b.column("text"))
        for i, j in blocks(off):
            s = block_statistics(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            cols = [b.column("doc_id").slice(i, j - i), b.column("th").slice(i, j - i)]
            cols += [pa.array(s[c].astype(np.int64)) for c in BASE + MORE]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", *BASE, *MORE])


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(_statistics, _SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))


def features(p) -> np.ndarray:
    """Rule ratios of a frame of statistics, one row per document."""
    words = np.maximum(p["n_words"], 1)
    return np.stack(
        [
            np.log1p(20 * p["n_symbols"] / words),
            p["n_dup_lines"] / np.maximum(p["n_lines"], 1),
            p["n_repeat_words"] / words,
            # how far distinct words stay behind what a text of this length has
            np.maximum(np.log(words**0.8 / np.maximum(p["n_distinct_words"], 1)), 0),
            1 - p["n_letters"] / np.maximum(p["word_chars"], 1),
            p["word_chars"] / words,
        ],
        axis=1,
    ).astype(np.float64)


def _usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Random splits over the box that all sampled statistics span, populated
    by the texts known to be good: a text that falls into a part of the box
    that good ones leave empty is isolated after few splits."""

    def __init__(self, good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sub: int = SUBSAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        sub = min(sub, len(good))
        self.usual = max(_usual_path(sub), 1e-9)
        self.depth = DEPTH
        size = 2 ** (self.depth + 1)
        self.feature = np.full((trees, size), -1, np.int16)
        self.cut = np.zeros((trees, size))
        self.path = np.zeros((trees, size))
        for t in range(trees):
            todo = [(0, good[rng.choice(len(good), sub, replace=False)], low, high, 0)]
            while todo:
                node, part, lo, hi, d = todo.pop()
                open_ = np.flatnonzero(hi > lo)
                if d >= self.depth or len(part) <= 1 or not len(open_):
                    self.path[t, node] = d + _usual_path(len(part))
                    continue
                f = rng.choice(open_)
                c = rng.uniform(lo[f], hi[f])
                self.feature[t, node], self.cut[t, node] = f, c
                left = part[:, f] < c
                below, above = hi.copy(), lo.copy()
                below[f] = above[f] = c
                todo += [(2 * node + 1, part[left], lo, below, d + 1), (2 * node + 2, part[~left], above, hi, d + 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the mean path, the nearer to 1."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.cut)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                go = 2 * node + 1 + (x[rows, f] >= self.cut[t, node])
                node = np.where(f < 0, node, go)
            total += self.path[t, node]
        return 2.0 ** (-total / len(self.cut) / self.usual)


def _score(forest: IsolationForest, schema: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = {c: b.column(c).to_numpy(zero_copy_only=False) for c in schema}
            yield b.append_column("anomaly", pa.array(forest.score(features(p))))

    return run


def calibrate(counts: dict[int, tuple[int, int]], most: float = MAX_LOSS) -> float:
    """The lowest bin edge at and above which at most ``most`` of the good
    labelled rows lie, or above 1 (reject nothing) without rows of both kinds.
    ``counts``: score bin -> (good, bad)."""
    good = sum(g for g, _ in counts.values())
    if not good or not sum(b for _, b in counts.values()):
        return 2.0
    lost, edge = 0, 2.0
    for k in sorted(counts, reverse=True):
        lost += counts[k][0]
        if lost > most * good:
            break
        edge = k / BINS
    return edge


def judge(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """doc_id, th (xxhash64 of the text), the statistics, base_failed, anomaly, kept: one row per row of
    ``docs``, null ids and repeated rows included (each is judged by its text).

    A null text has no words, so it fails the base rules. ``labels`` (doc_id,
    quality 0/1) calibrate; of repeated labels the lowest quality counts, null
    ones are ignored. Without good labelled rows to learn from, or labels of
    both kinds, only the base rules reject. Other columns are not read."""
    stats = shared(rule_statistics(docs, id_col, text_col))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    usable = stats.where(~F.col("base_failed"))
    if labels is None:
        known = usable.select("doc_id", F.lit(None).cast("int").alias("quality")).where(F.lit(False))
    else:
        known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = usable.join(known, "doc_id")
    n = labelled.count()
    part = min(1.0, SAMPLE_ROWS / max(n, 1))
    # drawn row by row, so that a repeated row is neither all in nor all out
    sample = labelled.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th", F.monotonically_increasing_id()), F.lit(1 << 20)) < int(part * (1 << 20)))
    sample = sample.select("quality", *BASE, *MORE).toPandas().sort_values(["quality", *BASE, *MORE])
    good = features({c: sample.loc[sample["quality"] > 0, c].to_numpy() for c in sample})
    if not len(good):
        return stats.withColumn("anomaly", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    every = features({c: sample[c].to_numpy() for c in sample})
    forest = IsolationForest(good, every.min(axis=0), every.max(axis=0), seed=seed)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    scored = shared(stats.mapInArrow(_score(forest, [*BASE, *MORE]), f"{fields}, anomaly double"))
    bins = scored.where(~F.col("base_failed")).join(known, "doc_id").groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"))
    rows = bins.agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.sum((F.col("quality") <= 0).cast("long")).alias("bad")).collect()
    edge = calibrate({x.bin: (x.good, x.bad) for x in rows})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < edge))
