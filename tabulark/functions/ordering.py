"""Distributed building blocks for order-dependent results.

Spark has no global row order, and a window without ``partitionBy`` runs in a
single task. Everything here works over range partitions instead: a range
shuffle spreads even one hot group across many tasks (by value), per-partition
counts give each partition its offset, and the offset table is tiny (one row
per partition and group). Explicit-count range shuffles are never coalesced,
split or read locally by AQE, so ``spark_partition_id()`` stays aligned with
the range order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import q


def _pin(df: DataFrame) -> DataFrame:
    """Materialise a range-partitioned frame once. Its partition ids are read
    by two branches (per-partition totals and local ranks); run twice, the
    range shuffle could sample different bounds (the sampler seed depends on
    the RDD id), so both must read the same cached partitions. Lost cache
    blocks are recomputed from the same RDD, i.e. with the same bounds."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys match null keys; key columns emitted once (left's)."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_null_safe needs at least one key")
    ren = {k: f"__r_{i}" for i, k in enumerate(keys)}
    r = right.select(*[q(c).alias(ren.get(c, c)) for c in right.columns])
    cond = None
    for k in keys:
        c = q(k).eqNullSafe(F.col(ren[k]))
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    if how in ("outer", "full", "full_outer", "right", "right_outer"):
        out = out.select(
            *[F.coalesce(q(k), F.col(ren[k])).alias(k) if k in ren else q(k) for k in left.columns],
            *[F.col(c) for c in r.columns if c not in ren.values()],
        )
        return out
    return out.drop(*ren.values())


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), name: str = "column", value: str = "v") -> DataFrame:
    """Unpivot numeric ``cols`` to (*by, column, v double), nulls/NaN dropped."""
    cols = list(cols)
    if not cols:
        raise ValueError("no columns to unpivot")
    sel = [q(b) for b in by] + [q(c).cast("double").alias(f"__v{i}") for i, c in enumerate(cols)]
    wide = df.select(*sel)
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', `__v{i}`" for i, c in enumerate(cols))
    stacked = wide.select(*[q(b) for b in by], F.expr(f"stack({len(cols)}, {pairs}) as (`{name}`, `{value}`)"))
    return stacked.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))


def _log_scale(v: Column) -> Column:
    """sign(v) * log1p(|v|): order-preserving in floating point (log1p is
    semi-monotonic, negation reverses exactly), and it spreads heavy tails."""
    return F.when(v >= 0, F.log1p(v)).otherwise(-F.log1p(-v))


#: first-level buckets per unit of the log scale, and parts of a bucket that is split
_FINE, _SPLIT = 64, 1024
#: values of one bucket that are sorted together
SORTED = 1 << 16
#: wanted buckets that are broadcast to the rows; beyond that they are joined by shuffle
_BROADCAST_ROWS = 1 << 15


def _histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (*keys, v, _b: bucket, _in: the bucket it is part of) counted,
    materialised; only one row per bucket and task is shuffled."""
    agg = rows.groupBy(*keys, "_in", "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return cut_lineage(agg)


def _offsets(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``hist`` with the rank of each bucket's first row inside _in (_off)."""
    # a bounded window: the buckets of one group
    before = Window.partitionBy(*keys, "_in").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))


def _held(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that pair buckets with ranks (_r inside _in), to the ranks that
    the bucket holds: the rank inside it, its path, size and limits."""
    hit = ranked.where((F.col("_r") >= F.col("_off")) & (F.col("_r") < F.col("_off") + F.col("_c")))
    path = F.concat_ws("/", "_in", "_b").alias("_in")
    return cut_lineage(hit.select(*keys, path, "_p", "_side", "_frac", (F.col("_r") - F.col("_off")).alias("_r"), "_c", "_lo", "_hi"))


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    limit: int = SORTED,
) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas ``linear`` = DuckDB
    ``quantile_cont``) of every column in ``cols`` per ``by`` group, as long
    rows ``(*by, column, p, value)``; nulls and NaN do not count.

    Selection by refining histograms: one pass over the rows counts buckets on
    a log scale (partial aggregates, so a task sends one row per bucket); only
    buckets that hold a wanted rank matter from then on. A bucket whose least
    and largest value agree is an answer, however many rows it has. One with
    more than ``limit`` rows is split evenly between its least and largest
    value by another pass over the rows, which isolates repeated values and
    clusters at any scale in a few passes; the rows of the others are sorted,
    at most ``limit`` at a time. Values are never a shuffle key, and no group
    meets in one task."""
    by = list(by)
    keys = by + ["column"]
    long = long_values(df, cols, by)
    # order-preserving, also for infinite values
    first = F.least(F.greatest(F.floor(_log_scale(F.col("v")) * _FINE), F.lit(-100_000)), F.lit(100_000)).cast("long")
    hist = _histogram(long.withColumns({"_in": F.lit(""), "_b": first}), keys)
    spots = []
    for p in probs:
        h = F.lit(float(p)) * (F.col("_n") - 1)
        for side, r in enumerate((F.floor(h), F.ceil(h))):
            spots.append(F.struct(F.lit(float(p)).alias("_p"), F.lit(side).alias("_side"), (h - F.floor(h)).alias("_frac"), r.cast("long").alias("_r")))
    placed = _offsets(hist, keys).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys, "_in")))
    at = _held(placed.select("*", F.explode(F.array(*spots)).alias("_s")).select("*", "_s.*"), keys)
    # rows carry the path of buckets that they lie in, as far as it is of use
    rows = long.withColumn("_in", F.concat_ws("/", F.lit(""), first))
    answer = [*keys, "_p", "_side", "_frac", F.col("_lo").alias("v")]
    found = at.where("_lo = _hi").select(*answer)
    while True:
        n, large = at.agg(F.count_if(F.expr("_lo < _hi")), F.count_if(F.expr(f"_lo < _hi and _c > {limit}"))).first()
        if not n:
            break
        at = at.where("_lo < _hi")
        buckets = at.select(*keys, "_in", "_c", "_lo", "_hi").distinct()
        here = join_null_safe(rows, F.broadcast(buckets) if n <= _BROADCAST_ROWS else buckets, [*keys, "_in"])
        few = here.where(F.col("_c") <= limit).select(*keys, "_in", "v")
        rank = F.row_number().over(Window.partitionBy(*keys, "_in").orderBy("v")) - 1
        sorted_ = join_null_safe(few.withColumn("_at", rank), at.where(F.col("_c") <= limit), [*keys, "_in"]).where("_at = _r")
        found = found.unionByName(sorted_.select(*keys, "_p", "_side", "_frac", "v"))
        if not large:
            break
        at = at.where(F.col("_c") > limit)
        # halves first, so that the width of a bucket cannot overflow
        part = F.floor(((F.col("v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)) * _SPLIT)
        part = F.when(F.col("v") == F.col("_lo"), 0).when(F.col("v") == F.col("_hi"), _SPLIT).otherwise(F.least(part, F.lit(_SPLIT)).cast("long"))
        split = here.where(F.col("_c") > limit).withColumn("_b", part)
        ranks = at.select(*keys, "_in", "_p", "_side", "_frac", "_r")
        at = _held(join_null_safe(ranks, _offsets(_histogram(split, keys), keys), [*keys, "_in"]), keys)
        rows = split.select(*keys, "v", F.concat_ws("/", "_in", "_b").alias("_in"))
        found = found.unionByName(at.where("_lo = _hi").select(*answer))
    res = found.groupBy(*keys, F.col("_p").alias("p")).agg(
        F.max(F.when(F.col("_side") == 0, F.col("v"))).alias("_lo"),
        F.max(F.when(F.col("_side") == 1, F.col("v"))).alias("_hi"),
        F.max("_frac").alias("_frac"),
    )
    between = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac"))
    return res.select(*keys, "p", between.alias("value"))


def quantile_wide(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """``exact_quantiles`` pivoted to one column per probability: (*by, column, q_<name>...)."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    long = exact_quantiles(df, cols, probs, by)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(n) for p, n in zip(probs, names)]
    return long.groupBy(*by, "column").agg(*aggs)


def with_positions(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "row_pos", partitions: int | None = None
) -> DataFrame:
    """Add 1-based positions in ``order_by`` order without a single-task window.

    Ties are broken by a hash of the whole row so equal sort keys still spread
    over range partitions."""
    parts = partitions or shuffle_partitions(df)
    cols = list(df.columns)
    order = [q(o) if isinstance(o, str) else o for o in order_by]
    base = df.withColumn("__tie", row_hash(df))
    sort = [*order, F.col("__tie")]
    parted = _pin(base.repartitionByRange(parts, *sort).withColumn("__pid", F.spark_partition_id()))
    local = parted.withColumn("__lrn", F.row_number().over(Window.partitionBy("__pid").orderBy(*sort)))
    counts = parted.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    # one row per partition: a bounded, single-task window is fine here
    offs = counts.select(
        "__pid",
        F.coalesce(
            F.sum("__c").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
    )
    out = local.join(F.broadcast(offs), "__pid")
    return out.select(*[q(c) for c in cols], (F.col("__off") + F.col("__lrn")).cast("long").alias(name))


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row; maps, which Spark does not hash, as JSON."""
    fields = df.schema.fields
    has_map = [f.name for f in fields if "map<" in f.dataType.simpleString()]
    return F.xxhash64(*[F.to_json(F.struct(q(f.name))) if f.name in has_map else q(f.name) for f in fields])


def nth_row(df: DataFrame, n: int, order_by: Sequence[str], splits: int = 16, small: int = 65_536) -> DataFrame:
    """The ``n``-th row (1-based) in ascending order, nulls first, ties by a
    hash of the row; no row if there is none. Found by counting: each round
    counts the rows below some sampled keys and goes on between two of them,
    so no row is shuffled or stored until ``small`` are left. A key that holds
    the wanted rank with all its copies is the answer at once."""
    base = df.withColumn("__tie", row_hash(df))
    names = [*order_by, "__tie"]
    key = F.struct(*[q(c).alias(f"k{i}") for i, c in enumerate(names)])
    types = [base.schema[c].dataType for c in names]
    rest, skip, size = base, n - 1, base.count()
    if not 0 <= skip < size:
        return df.where(F.lit(False))
    for seed in range(32):
        if size <= small:
            break
        some = rest.sample(min(1.0, 32 * splits / size), seed).select(key.alias("k")).orderBy("k").collect()
        keys = [r["k"] for r in some[:: max(len(some) // splits, 1)]]
        if not keys:
            continue
        bounds = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(k, types, strict=True))]) for k in keys]
        below = rest.agg(*[F.count_if(key < b) for b in bounds], *[F.count_if(key <= b) for b in bounds]).first()
        under, upto = list(below)[: len(bounds)], list(below)[len(bounds) :]
        hit = [b for b, lo, hi in zip(bounds, under, upto, strict=True) if lo <= skip < hi]
        if hit:
            rest, skip = rest.where((key >= hit[0]) & (key <= hit[0])), 0
            return rest.limit(1).drop("__tie")
        lo = [i for i, c in enumerate(upto) if c <= skip]
        hi = [i for i, c in enumerate(under) if c > skip]
        if hi:
            rest, size = rest.where(key < bounds[hi[0]]), under[hi[0]]
        if lo:
            rest, skip, size = rest.where(key > bounds[lo[-1]]), skip - upto[lo[-1]], size - upto[lo[-1]]
    return rest.orderBy(key).offset(skip).limit(1).drop("__tie")


def top_k_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_name: str | None = None,
) -> DataFrame:
    """Top-k rows per group: ``row_number() <= k`` over a per-group window.

    Spark plans this filter with a partial ``WindowGroupLimit`` before the
    shuffle (each map task keeps only its top k per group), so a hot group
    sends at most k rows per map partition to its final sort. Ties must be
    broken by ``order`` itself."""
    w = Window.partitionBy(*[q(g) for g in group_cols]).orderBy(*order)
    rn = rank_name or "__rank"
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k)
    return out if rank_name else out.drop(rn)


def with_running_sum(
    df: DataFrame, order_by: Sequence[str | Column], value: str, name: str = "running", partitions: int | None = None
) -> DataFrame:
    """Add an inclusive running sum of ``value`` in ``order_by`` order over the
    whole frame, via range partitions and per-partition offsets (no single-task
    window). Ties are broken by a hash of the row."""
    parts = partitions or shuffle_partitions(df)
    cols = list(df.columns)
    order = [q(o) if isinstance(o, str) else o for o in order_by]
    base = df.withColumn("__tie", row_hash(df))
    sort = [*order, F.col("__tie")]
    parted = _pin(base.repartitionByRange(parts, *sort).withColumn("__pid", F.spark_partition_id()))
    wl = Window.partitionBy("__pid").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    local = parted.withColumn("__lc", F.sum(q(value)).over(wl))
    sums = parted.groupBy("__pid").agg(F.sum(q(value)).alias("__s"))
    offs = sums.select(
        "__pid",
        F.coalesce(F.sum("__s").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
    )
    out = local.join(F.broadcast(offs), "__pid")
    return out.select(*[q(c) for c in cols], (F.col("__off") + F.col("__lc")).alias(name))
