"""Operator 4, mixing sources to target weights by Sainte-Laguë apportionment.

The budget (all words) is cut into equal blocks. Highest quotients
target / (2k + 1) hand the blocks to sources, and again each source's blocks
to its shards, so every shard has an integer quota. Inside a shard documents
lie on a line in seeded order; whole passes over the line come first, and the
rest of the quota takes whole documents from the line's start, up to the one
that would overshoot. That one is taken too where this brings the source
nearer to its quotas so far; the difference goes on to the source's next
shard, long documents first, so a source ends within half of its longest
document and mostly much nearer. Only per-shard numbers (at most ``SHARDS``
plus one per source) reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shared, text_or_empty

BLOCKS = 1 << 20
SHARDS = 1024
MAX_REPEAT = 3
WEIGHTS = (5, 2, 1)


def capped_targets(sizes: list[int], weights: list[float], total: float, most: int = MAX_REPEAT) -> list[float]:
    """Share ``total`` by weight; a target stops at ``most`` times its size and
    the excess is shared again by weight among the others."""
    out = [0.0] * len(sizes)
    open_ = {i for i, s in enumerate(sizes) if s > 0}
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > most * sizes[i] * w}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2k + 1), at most ``most`` each; ties
    go to the lower index. The divisor is found by bisection, and the last few
    seats by sorting the quotients next to it."""
    votes = np.asarray(votes, float)
    most = np.full(len(votes), np.iinfo(np.int64).max // 4) if most is None else np.asarray(most, np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if seats <= 0 or not len(votes):
        return np.zeros(len(votes), np.int64)

    def at(d: float) -> np.ndarray:
        return np.minimum(np.floor(votes / d + 0.5).astype(np.int64), most)

    low, high = votes.max() / (seats + 1.0) / 4, votes.max() * 2.5
    while at(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if at(mid).sum() >= seats else (low, mid)
    got = at(high)
    while (missing := seats - int(got.sum())) > 0:
        q = np.where(got < most, votes / (2 * got + 1), -1.0)
        got[np.lexsort((np.arange(len(q)), -q))[: min(missing, int((q > 0).sum()))]] += 1
    return got


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    seed: int = 17,
    share: float = 1.0,
) -> DataFrame:
    """One row per document: doc_id, th (xxhash64 of the text), size,
    source_size, target, taken (a multiple of size: documents stay whole).

    ``size`` counts words, null text 0. Sources sorted by code point, null
    last, take the weights in turn and share ``share`` of all words; targets
    stop at 3 times their source. ``taken`` counts words with repeats, at most
    3 times the size. Rows that repeat are mixed one by one (equal rows get
    neighbouring places on the line); empty tables give an empty result;
    other columns are not read. Reruns agree: the order depends on ``seed``,
    ids and texts alone."""
    return _mix(docs, id_col, text_col, source_col, weights, seed, share).drop("_source")


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], seed: int, share: float) -> DataFrame:
    """:func:`mix` with each row's ``_source``."""
    spark = docs.sparkSession
    sized = shared(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("_source"),
            F.xxhash64(text_or_empty(text_col)).alias("th"),
            F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        )
    )
    totals = sized.groupBy("_source").agg(F.sum("size").alias("n")).collect()
    # UTF-8 order is code point order
    totals.sort(key=lambda x: (x._source is None, (x._source or "").encode()))
    sizes = [int(x.n) for x in totals]
    total = int(sum(sizes) * share)
    target = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], total)
    block = max(1, total // BLOCKS)
    all_words = max(1, sum(sizes))
    shards = [max(1, round(SHARDS * n / all_words)) for n in sizes]
    source_row = "_source string, _s int, _shards int, source_size long, target double"
    table = spark.createDataFrame([(x._source, i, shards[i], sizes[i], target[i]) for i, x in enumerate(totals)], source_row)
    placed = sized.join(F.broadcast(table), sized["_source"].eqNullSafe(table["_source"])).drop(table["_source"])
    placed = placed.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "th"))
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "th"), F.col("_shards")).cast("int"))
    lines = {(x._s, x._shard): int(x.n) for x in placed.groupBy("_s", "_shard").agg(F.sum("size").alias("n")).collect()}

    of: dict[int, list[tuple[int, int]]] = {}
    for k in sorted(lines):
        of.setdefault(k[0], []).append(k)
    quota = []
    of_source = sainte_lague(np.array(target), round(sum(target) / block)) if target else []
    for s, seats in enumerate(of_source):
        keys = of.get(s, [])
        votes = np.array([lines[k] for k in keys], np.int64)
        got = sainte_lague(votes, int(seats), MAX_REPEAT * votes // block)
        for (_, shard), line, blocks in zip(keys, votes.tolist(), got.tolist(), strict=True):
            passes, rest = divmod(blocks * block, max(line, 1))
            quota.append((s, shard, passes, 0 if passes >= MAX_REPEAT else rest))
    plan = spark.createDataFrame(quota, "_s int, _shard int, _passes long, _rest long")
    on_line = Window.partitionBy("_s", "_shard").orderBy("_order", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    placed = shared(placed.join(F.broadcast(plan), ["_s", "_shard"]).withColumn("_to", F.sum("size").over(on_line)).drop("_order"))

    # the two places between documents that are next to the rest of the quota
    low, high = F.max(F.when(F.col("_to") <= F.col("_rest"), F.col("_to"))), F.min(F.when(F.col("_to") > F.col("_rest"), F.col("_to")))
    ends = {(x._s, x._shard): (x.low or 0, x.high) for x in placed.groupBy("_s", "_shard").agg(low.alias("low"), high.alias("high")).collect()}
    cuts, carry = [], dict.fromkeys(of, 0)
    # the longest documents are decided on first, so the short ones even out what is carried
    for s, shard, passes, rest in sorted(quota, key=lambda x: (ends[x[:2]][0] - (ends[x[:2]][1] or 0), x)):
        low, high = ends[s, shard]
        carry[s] += rest
        cut = high if high is not None and passes < MAX_REPEAT and 2 * carry[s] > low + high else low
        carry[s] -= cut
        cuts.append((s, shard, cut))
    cuts = spark.createDataFrame(cuts, "_s int, _shard int, _cut long")
    taken = F.col("size") * (F.col("_passes") + (F.col("_to") <= F.col("_cut")).cast("long"))
    placed = placed.join(F.broadcast(cuts), ["_s", "_shard"])
    return placed.select("doc_id", "th", "_source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(
    docs: DataFrame,
    keep: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    seed: int = 17,
    share: float = 1.0,
) -> DataFrame:
    """doc_id, text and the columns ``keep`` of the mix itself: a document
    comes, whole, as often as :func:`mix` takes it. Rows that agree in id, text
    and source share evenly what they take; an odd copy goes to the least of
    them by ``keep``. Texts without words have nothing to give."""
    mixed = _mix(docs, id_col, text_col, source_col, weights, seed, share).where("size > 0")
    copies, n = F.sum(F.expr("taken div size")), F.count(F.lit(1))
    per_text = mixed.groupBy("doc_id", "th", "_source").agg(copies.alias("_copies"), n.alias("_n"))
    per_text = shared(per_text.where("_copies > 0").selectExpr("*", "_copies div _n as _each", "_copies % _n as _odd"))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(source_col).alias("_source"), text.alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep]).alias("d")
    same = F.lit(True)
    for c in ("doc_id", "th", "_source"):
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}"))
    even = rows.join(per_text.where("_odd = 0").alias("m"), same).select("d.*", "m._each")
    # at most one text of a shard, the last one taken, has odd copies
    odd = rows.join(F.broadcast(per_text.where("_odd > 0")).alias("m"), same).select("d.*", "m._each", "m._odd")
    place = F.row_number().over(Window.partitionBy("doc_id", "th", "_source").orderBy(*[f"_keep_{c}" for c in keep] or ["th"]))
    odd = odd.withColumn("_each", F.col("_each") + (place <= F.col("_odd")).cast("long")).drop("_odd").where("_each > 0")
    out = even.unionByName(odd).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_each")))
    return out.select("doc_id", "text", *[F.col(f"_keep_{c}").alias(c) for c in keep])
