"""Links to groups: pairs out of buckets in linear rounds, and distributed
union-find.

Nothing here collects links or components: every step is a grouped minimum
(pre-aggregated before its shuffle) and a join in which hot keys are handled
apart (see :func:`tabulark.llm.common.join_groups`)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, mix64, multiplied, shared

#: standard deviations below the threshold at which a sketch rules a pair out
DEVIATIONS = 6
#: links that one task joins by itself (16 bytes each); more go on in steps
ONE_TASK = 1 << 20
#: buckets of at most so many members are compared in full
SMALL = 64
#: fresh pivots of a larger bucket in one round
PIVOTS = 8
#: least share of the open members that a round must link for another one
YIELD = 1 / 16
#: pairs whose rows are picked by a broadcast (16 bytes each)
FEW = 1 << 16
#: members of one slice of a bucket whose pairs are compared in full
SLICE = 2048
#: least bits of a parity map for each value of its set, and words of its first part
PARITY, HEAD = 3, 8


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find inside one partition: a star to the least node for each of
    its components replaces its links."""
    got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not got:
        return
    nodes, flat = np.unique(np.concatenate(got, axis=1), return_inverse=True)
    a, b = flat.reshape(2, -1)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(nodes))], np.int64)
    far = np.flatnonzero(roots != np.arange(len(nodes)))
    for i in range(0, len(far), 1 << 16):
        f = far[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[f]), pa.array(nodes[roots[f]])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``links`` (bigint a, b) to (node, root): every linked node with the
    least node it can reach. Union-find per partition; what is left of the
    links is joined in one task if its count is at most ``ONE_TASK``, else by
    large-star and small-star steps over all partitions until only stars are
    left."""
    edges = shared(links.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long"))
    few = edges.count() <= ONE_TASK
    if few:
        edges = shared(edges.repartition(1).mapInArrow(_forest, "a long, b long"))
    while not few and not _only_stars(edges):
        # large star: the larger neighbours of a node go to its least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = shared(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = join_groups(both, least, ["a"]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours go to the least of them
        low = large.distinct().withColumn("m", F.min("b").over(Window.partitionBy("a")))
        to = F.explode(F.array("a", "b"))
        edges = shared(low.select(to.alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node points to one other, which points nowhere."""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    nodes = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return nodes.where("out > 1 or out = 1 and in = 1").isEmpty()


def crowded(keys: DataFrame) -> DataFrame:
    """``keys`` (bigint node, key; distinct) in buckets of two or more, with
    one member as the bucket's ``pivot``, another one in each bucket, and the
    bucket's number of members."""
    any_ = F.xxhash64("node", "key")
    groups = keys.groupBy("key").agg(F.min_by("node", any_).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared(join_groups(keys, shared(groups), ["key"]).select("node", "key", "pivot", "n"))


def sketch(x: np.ndarray, first: np.ndarray, bits: int) -> pa.Array:
    """One bit of each of ``bits`` MinHash coordinates of sets of well-mixed
    32-bit values, as rows of bits / 64 longs; sets must not be empty. The
    least values are mixed first: an odd multiplier keeps a value's low bit, so
    in a small set the same few bits would come back in every coordinate."""
    words = np.empty((len(first) - 1, bits // 64), np.int64)
    # blocks whose mixed values stay small
    for i in range(0, len(words), 256):
        f = first[i : i + 257]
        low = (mix64(multiplied(x[f[0] : f[-1]], f - f[0], bits).astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
        words[i : i + 256] = np.packbits(low, axis=1, bitorder="little").view(np.int64)
    ends = np.arange(len(words) + 1, dtype=np.int32) * (bits // 64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(words.reshape(-1)))


def most_apart(percent: int, n: int) -> int:
    """Most of ``n`` sketch bits in which :func:`plausible` lets a pair differ."""
    q = (1 + percent / 100) / 2
    return int(n * (1 - q) + DEVIATIONS * (n * q * (1 - q)) ** 0.5)


def plausible(na, sa, nb, sb, percent: int, bits: int) -> Column:
    """False only where set sizes rule a Jaccard similarity of ``percent``
    hundredths out, or the share of equal sketch bits does, which for a pair
    at that similarity is (1 + percent / 100) / 2, by more than ``DEVIATIONS``
    standard deviations, over its first 512 bits or all (a tail of about one in
    10^8 such pairs at 6). That holds for sets of any size, since mixed bits
    vary like independent ones."""
    # a few words decide most pairs; spelling all out makes the compiled join too long to be optimised
    head = min(bits, 512)
    few = sum((F.bit_count(F.col(sa)[i].bitwiseXOR(F.col(sb)[i])) for i in range(head // 64)), F.lit(0))
    every = F.aggregate(F.zip_with(sa, sb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return F.when(sizes & (few <= most_apart(percent, head)), F.lit(True) if bits <= head else every <= most_apart(percent, bits)).otherwise(F.lit(False))


def parity(owner: np.ndarray, x: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Parity maps of sets, as rows of longs: each of a set's values flips one
    bit. ``x``: well-mixed distinct 64-bit values, ``owner`` the set of each,
    ``sizes`` their number in each set. Every set has a map of ``HEAD`` words;
    where these are fewer than ``PARITY`` bits for each value, one of the next
    power of two that is not follows."""
    need = np.maximum(PARITY * sizes, 1) / 64
    more = np.where(need > HEAD, 1 << np.ceil(np.log2(need)).astype(np.int64), 0)
    ends = np.concatenate([[0], np.cumsum(HEAD + more)])
    first = 64 * ends[:-1][owner]
    at = first + (x & np.uint64(64 * HEAD - 1)).astype(np.int64)
    long = more[owner] > 0
    at = np.append(at, first[long] + 64 * HEAD + (x[long].astype(np.int64) & (64 * more[owner][long] - 1)))
    odd = (np.bincount(at, minlength=64 * ends[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def close_parity(na: str, sa: str, nb: str, sb: str, percent: int, whole: bool = True) -> Column:
    """False only where set sizes or parity maps rule a Jaccard similarity of
    ``percent`` hundredths out. Two maps differ in no more bits than their sets
    have values of their own, so no similar pair is lost; with few of these to
    a bit they differ in nearly as many. Without ``whole`` only the first
    ``HEAD`` words are compared, which compiles better. The larger one of
    whole maps is folded to the size of the smaller, which keeps the bound."""

    def folded(s, t):
        n = F.size(t)
        halves = F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, n + 1, n), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(s) > n, halves).otherwise(s)

    # own / (na + nb) is (1 - J) / (1 + J) at a similarity of J
    most = (100 - percent) * (F.col(na) + F.col(nb))
    few = sum((F.bit_count(F.col(sa)[i].bitwiseXOR(F.col(sb)[i])) for i in range(HEAD)), F.lit(0))
    near = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * few <= most)
    if not whole:
        return near
    short, wide = F.least(F.size(sa), F.size(sb)) - HEAD, F.greatest(F.size(sa), F.size(sb)) - HEAD
    ta, tb = (F.slice(s, F.lit(HEAD + 1), F.size(s) - HEAD) for s in (sa, sb))
    differ = F.aggregate(F.zip_with(folded(ta, tb), folded(tb, ta), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.when(near, (short == 0) | (wide > 2 * short) | ((100 + percent) * differ <= most)).otherwise(F.lit(False))


def possible(pairs: DataFrame, sketches: DataFrame, percent: int, bits: int | None) -> DataFrame:
    """The different ``pairs`` (a, b) whose ``sketches`` (node, size of the
    set, sketch) leave them possible: MinHash sketches of so many ``bits``, or
    parity maps for None."""
    return _still_possible(pairs.distinct(), sketches, percent, bits)


def of_pairs(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (a, b), materialised, and ``rows`` (node, ...) to join them
    with. For few pairs these are only the rows of their nodes, found by a
    broadcast of at most 2 * ``FEW`` nodes, so the others are not shuffled. A
    node has one row, so its side can be hashed, and neither side is sorted."""
    pairs = shared(pairs)
    if pairs.limit(FEW + 1).count() <= FEW:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        rows = rows.join(F.broadcast(nodes), "node", "left_semi")
    return pairs, rows.hint("shuffle_hash")


def _still_possible(pairs: DataFrame, sketches: DataFrame, percent: int, bits: int | None) -> DataFrame:
    if bits is None:
        pairs, sketches = of_pairs(pairs, sketches.select("node", "size", "sketch"))
    a = sketches.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb"))
    near = close_parity("na", "sa", "nb", "sb", percent) if bits is None else plausible("na", "sa", "nb", "sb", percent, bits)
    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def small_pairs(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs inside buckets of at most ``SMALL`` members that star pairs
    leave open: of different components, each pair in the first of the small
    buckets that its members share."""
    small = members.where(F.col("n") <= SMALL).join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("comp"))
    small = shared(small)
    split = small.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    known = join_groups(small, shared(split.select("key")), ["key"])
    keys = known.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    known = shared(known.join(keys, "node"))
    a = known.select("key", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("keys").alias("ka"))
    b = known.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("keys").alias("kb"))
    first = F.array_min(F.array_intersect("ka", "kb")) == F.col("key")
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & first).select("a", "b")


def near_pairs(members: DataFrame, sketches: DataFrame, percent: int, roots: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) inside buckets of at most ``SMALL`` members which the heads
    of their parity maps leave possible: for each member the nearest one before
    it, or with ``roots`` (node, root) every pair of different components.
    Buckets come sorted; those of a batch are compared at once."""
    heads = sketches.select("node", F.col("node").alias("comp"), "size", F.slice("sketch", 1, HEAD).alias("sketch"))
    if roots is not None:
        heads = heads.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    small = members.where(F.col("n") <= SMALL).select("node", "key")
    dealt = small.join(heads.hint("shuffle_hash"), "node").select("key", "node", "comp", "size", "sketch").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_near_pairs(percent, roots is not None), "a long, b long")


def _near_pairs(percent: int, every: bool):
    def pairs(rows: pa.Table) -> pa.RecordBatch:
        key, node, comp, size = (rows.column(c).to_numpy() for c in ("key", "node", "comp", "size"))
        words = pa.concat_arrays([x.flatten() for x in rows.column("sketch").chunks]).to_numpy().view(np.uint64).reshape(len(key), HEAD)
        size, met, found = size.astype(np.int64), np.zeros(len(key), bool), [np.zeros((2, 0), np.int64)]
        for d in range(1, SMALL):
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            i = i[(comp[i] != comp[i + d]) & ~met[i + d] & (100 * np.minimum(size[i], size[i + d]) >= percent * np.maximum(size[i], size[i + d]))]
            apart = np.bitwise_count(words[i] ^ words[i + d]).sum(axis=1, dtype=np.int64)
            i = i[(100 + percent) * apart <= (100 - percent) * (size[i] + size[i + d])]
            met[i + d] = not every
            found.append(np.sort([node[i], node[i + d]], axis=0))
        a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            rows = pa.Table.from_batches([*rest, b])
            key = rows.column("key").to_numpy()
            # the last bucket may go on in the next batch
            cut = int(np.argmax(key == key[-1])) if len(key) else 0
            rest = rows.slice(cut).combine_chunks().to_batches()
            if cut:
                yield pairs(rows.slice(0, cut))
        if rest:
            yield pairs(pa.Table.from_batches(rest))

    return run


def _open(members: DataFrame, roots: DataFrame, links: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(``members`` (node, key) with their component, materialised; the buckets
    that hold more than one, with ``PIVOTS`` fresh pivots and the number of
    members). Pivots are any members, but ones with many links rather than
    few, since those are near the middle of a component."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    known = members.join(roots, "node", "left").join(degree, "node", "left")
    known = shared(known.select("node", "key", F.coalesce("root", "node").alias("comp"), F.coalesce("degree", F.lit(0)).alias("degree")))

    def pivot(k: int) -> Column:
        luck = (F.pmod(F.xxhash64(F.lit(turn * PIVOTS + k), "node", "key"), F.lit(1 << 30)) + 1) / (1 << 30)
        return F.min(F.struct(-F.log(luck) / (F.col("degree") + 1), "node", "comp"))

    picked = F.array(*[pivot(k) for k in range(PIVOTS)])
    picked = F.transform(picked, lambda p: F.struct(p["node"].alias("node"), p["comp"].alias("comp"))).alias("pivots")
    groups = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), picked).where("lo < hi")
    return known.drop("degree"), shared(groups.select("key", "n", "pivots"))


def rest_pairs(known: DataFrame, sizes: DataFrame, sketches: DataFrame, percent: int, bits: int | None) -> DataFrame:
    """All possible pairs of different components inside buckets: ``known``
    (node, key, comp) of the buckets ``sizes`` (key, n), with ``sketches``.
    A pair meets in the first of these buckets that both members share. Members
    are dealt to slices of about ``SLICE``, and each two slices of a bucket
    meet as a group of their own, so no task holds a bucket and no group needs
    to be split. Slices carry the head of a parity map; what it leaves possible
    meets the whole maps after."""
    keys = known.join(sizes.select("key"), "key", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    dealt = join_groups(known, sizes.select("key", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")), ["key"])
    dealt = dealt.join(sketches.select("node", "size", "sketch" if bits is not None else F.slice("sketch", 1, HEAD).alias("sketch")), "node").join(keys, "node")
    dealt = shared(dealt.withColumn("slice", F.pmod(F.xxhash64("node"), "slices").cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    dealt = dealt.select("key", other.alias("other"), "slice", "node", "comp", "size", "sketch", "keys")
    cells = dealt.groupBy("key", F.least("slice", "other").alias("lo"), F.greatest("slice", "other").alias("hi"))
    met = cells.applyInArrow(_cell_pairs(percent, bits), "a long, b long").distinct()
    return met if bits is not None else _still_possible(met, sketches, percent, None)


def _cell_pairs(percent: int, bits: int | None):
    """The possible pairs of two slices of a bucket (or inside one): of
    different components, near enough by sizes and sketches (the test of
    :func:`plausible`, or that of :func:`close_parity` on the heads of maps),
    and with no earlier bucket in common."""

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        key, lo, hi = (x.as_py() for x in group)
        node, comp, size, part = (rows.column(c).to_numpy() for c in ("node", "comp", "size", "slice"))
        size = size.astype(np.int64)
        words = pa.concat_arrays(rows.column("sketch").chunks).flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        earlier = [frozenset(k for k in ks if k < key) for ks in rows.column("keys").to_pylist()]
        x, y = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        found = [(np.zeros(0, np.int64),) * 2]
        step = max(1, (1 << 17) // max(len(y), 1))
        for i in range(0, len(x), step):
            p, q = x[i : i + step, None], y[None, :]
            near = (comp[p] != comp[q]) & (100 * np.minimum(size[p], size[q]) >= percent * np.maximum(size[p], size[q]))
            if lo == hi:
                near &= p < q
            p, q = np.nonzero(near)
            p, q = x[i + p], y[q]
            for n in dict.fromkeys((HEAD, words.shape[1])):
                apart = np.bitwise_count(words[p, :n] ^ words[q, :n]).sum(axis=1, dtype=np.int64)
                keep = (100 + percent) * apart <= (100 - percent) * (size[p] + size[q]) if bits is None else apart <= most_apart(percent, 64 * n)
                p, q = p[keep], q[keep]
            keep = np.array([earlier[u].isdisjoint(earlier[v]) for u, v in zip(p.tolist(), q.tolist(), strict=True)], bool)
            u, v = node[p[keep]], node[q[keep]]
            found.append((np.minimum(u, v), np.maximum(u, v)))
        return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def linked(members: DataFrame, sketches: DataFrame, percent: int, bits: int | None, confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components (node, root) of the similar pairs of ``members`` (as
    :func:`crowded` gives them); ``confirm`` keeps the pairs that are similar.

    Every member meets its bucket's pivot, or with parity maps in buckets of at
    most ``SMALL`` members the nearest one that its map leaves possible. In
    these buckets all pairs of different components follow, so there each pair
    is verified, already connected or ruled out. Larger buckets go on in rounds
    in which fresh pivots meet the members of other components, for as long as
    a round links a fair share of them. These steps are linear in the members.
    Then all pairs of different components that large buckets still hold
    follow, so no link is left out there either: the square of what no pivot
    joined, compared slice by slice."""
    star = members.where("node <> pivot")
    if bits is None:
        first = near_pairs(members, sketches, percent)
        star = star.where(F.col("n") > SMALL).select(*_pair("pivot", "node")).unionByName(first)
    else:
        star = star.select(*_pair("pivot", "node"))
    links = shared(confirm(possible(star, sketches, percent, bits)))
    roots = components(links)

    def after(found: DataFrame) -> DataFrame:
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))

    left = small_pairs(members, roots) if bits is not None else near_pairs(members, sketches, percent, roots)
    found = shared(confirm(possible(left, sketches, percent, bits)))
    if not found.isEmpty():
        links, roots = links.unionByName(found), after(found)
    large = members.where(F.col("n") > SMALL).select("node", "key")
    turn = 0
    while True:
        turn += 1
        known, open_ = _open(large, roots, links, turn)
        n = open_.agg(F.sum("n")).first()[0]
        if not n:
            return roots
        here = join_groups(known, open_, ["key"])
        met = here.select("node", "comp", F.explode("pivots").alias("p")).where("comp <> p.comp").select("node", F.col("p.node").alias("pivot"))
        found = shared(confirm(possible(met.select(*_pair("pivot", "node")), sketches, percent, bits)))
        new = found.count()
        if new:
            links, roots = links.unionByName(found), after(found)
        large = here.select("node", "key")
        if new < YIELD * n:
            break
    known, open_ = _open(large, roots, links, turn + 1)
    found = shared(confirm(rest_pairs(known, open_.select("key", "n"), sketches, percent, bits)))
    return roots if found.isEmpty() else after(found)
