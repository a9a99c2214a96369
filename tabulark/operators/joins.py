"""Joins and set operations.

Joins are plain equi-joins: Catalyst/AQE choose broadcast vs sort-merge from
runtime sizes (a broadcast only happens under the configured, checked
threshold) and split skewed partitions. Key inference never collects value
sets: both sides are unpivoted to distinct (column, value) rows and joined
once on the value."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric, is_string, is_temporal, q, scalar_columns
from ..functions.ordering import top_k_per_group

JOIN_HOWS = ("inner", "left", "right", "outer")


def _kind(dt: T.DataType) -> str:
    if is_numeric(dt):
        return "number"
    if is_string(dt):
        return "string"
    if is_temporal(dt):
        return "time"
    return dt.typeName()


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    null_keys: str = "match",
    suffixes: tuple[str, str] = ("_left", "_right"),
) -> DataFrame:
    """One-key equi-join with pandas-merge output naming.

    Overlapping non-key columns get ``_left``/``_right``; a key with the same
    name on both sides is emitted once (coalesced for outer joins); keys with
    different names are both kept. ``null_keys="match"`` (default, like pandas)
    pairs null keys with null keys via ``<=>``; ``"drop"`` uses plain ``=``."""
    if how not in JOIN_HOWS:
        raise ValueError(f"how must be one of {JOIN_HOWS}")
    if left_key not in left.columns:
        raise KeyError(f"column {left_key!r} not in left table")
    if right_key not in right.columns:
        raise KeyError(f"column {right_key!r} not in right table")
    lk_t, rk_t = _kind(left.schema[left_key].dataType), _kind(right.schema[right_key].dataType)
    if lk_t != rk_t:
        raise TypeError(f"key types differ: {lk_t} vs {rk_t}")
    same = left_key == right_key
    overlap = (set(left.columns) & set(right.columns)) - ({left_key} if same else set())
    lname = {c: (c + suffixes[0] if c in overlap else c) for c in left.columns}
    rname = {c: (c + suffixes[1] if c in overlap else c) for c in right.columns}
    l2 = left.select(*[q(c).alias("__l_" + c) for c in left.columns])
    r2 = right.select(*[q(c).alias("__r_" + c) for c in right.columns])
    lk, rk = q("__l_" + left_key), q("__r_" + right_key)
    cond = lk.eqNullSafe(rk) if null_keys == "match" else lk == rk
    j = l2.join(r2, cond, {"outer": "full_outer"}.get(how, how))
    out = []
    for c in left.columns:
        if same and c == left_key:
            e = F.coalesce(lk, rk) if how in ("outer", "right") else lk
            out.append(e.alias(c))
        else:
            out.append(q("__l_" + c).alias(lname[c]))
    for c in right.columns:
        if same and c == right_key:
            continue
        out.append(q("__r_" + c).alias(rname[c]))
    return j.select(*out)


def join_audit(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", null_keys: str = "match") -> DataFrame:
    """Rows left, rows right, rows after the join (one row)."""
    joined = join_tables(left, right, left_key, right_key, how, null_keys)
    return left.agg(F.count(F.lit(1)).alias("left_rows")).select(
        "left_rows",
        right.agg(F.count(F.lit(1))).scalar().alias("right_rows"),
        joined.agg(F.count(F.lit(1))).scalar().alias("rows_after"),
    )


def _distinct_values(df: DataFrame, side: str) -> DataFrame:
    cols = scalar_columns(df)
    sel = [F.trim(q(c).cast("string")).alias(f"__c{i}") for i, c in enumerate(cols)]
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', {i}, `__c{i}`" for i, c in enumerate(cols))
    long = df.select(*sel).select(F.expr(f"stack({len(cols)}, {pairs}) as (col, pos, value)"))
    return long.where(F.col("value").isNotNull()).distinct().select(
        F.col("col").alias(f"column_{side}"), F.col("pos").alias(f"pos_{side}"), "value"
    )


def infer_join_keys(left: DataFrame, right: DataFrame, k: int = 5, samples: int = 3) -> DataFrame:
    """Candidate key pairs scored by value overlap and names.

    score = round(min(1, 0.6*max(common/distinct_1, common/distinct_2)
    + 0.3*[same name] + 0.1*[either name ends in "id"]), 2); kept when >= 0.2;
    top ``k`` by score (column order breaks ties)."""
    v1, v2 = _distinct_values(left, "1"), _distinct_values(right, "2")
    n1 = v1.groupBy("column_1", "pos_1").agg(F.count(F.lit(1)).alias("n1"))
    n2 = v2.groupBy("column_2", "pos_2").agg(F.count(F.lit(1)).alias("n2"))
    common = v1.join(v2, "value")
    g = common.groupBy("column_1", "pos_1", "column_2", "pos_2").agg(F.count(F.lit(1)).alias("matched_unique_count"))
    smp = top_k_per_group(common.select("column_1", "column_2", "value"), ["column_1", "column_2"], [F.col("value")], samples)
    smp = smp.groupBy("column_1", "column_2").agg(F.array_sort(F.collect_list("value")).alias("sample_matches"))
    g = g.join(n1, ["column_1", "pos_1"]).join(n2, ["column_2", "pos_2"]).join(smp, ["column_1", "column_2"])
    r1 = F.col("matched_unique_count") / F.col("n1")
    r2 = F.col("matched_unique_count") / F.col("n2")
    l1, l2 = F.lower("column_1"), F.lower("column_2")
    name_match = l1 == l2
    id_like = l1.endswith("id") | l2.endswith("id")
    score = F.round(
        F.least(F.lit(1.0), F.greatest(r1, r2) * 0.6 + F.when(name_match, 0.3).otherwise(0.0) + F.when(id_like, 0.1).otherwise(0.0)),
        2,
    )
    scored = g.select(
        "column_1",
        "column_2",
        score.alias("score"),
        "matched_unique_count",
        F.round(r1 * 100, 1).alias("overlap_pct_1"),
        F.round(r2 * 100, 1).alias("overlap_pct_2"),
        "sample_matches",
        "pos_1",
        "pos_2",
    ).where(F.col("score") >= 0.2)
    top = scored.orderBy(F.col("score").desc(), "pos_1", "pos_2").limit(k)
    return top.select(
        "column_1",
        "column_2",
        "score",
        F.when(F.col("score") >= 0.7, "High").when(F.col("score") >= 0.4, "Medium").otherwise("Low").alias("confidence_label"),
        "matched_unique_count",
        "overlap_pct_1",
        "overlap_pct_2",
        "sample_matches",
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed."""
    return df.dropDuplicates()


def union_tagged(frames: Mapping[str, DataFrame], tag_col: str = "kind") -> DataFrame:
    """Append frames by column name, tagging each row with its frame's key."""
    out = None
    for tag, frame in frames.items():
        f = frame.withColumn(tag_col, F.lit(tag))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames")
    return out


def value_overlap(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """Distinct trimmed-text values on each side and their intersection (one row)."""
    a = left.select(F.trim(q(left_col).cast("string")).alias("value")).where(F.col("value").isNotNull()).distinct()
    b = right.select(F.trim(q(right_col).cast("string")).alias("value")).where(F.col("value").isNotNull()).distinct()
    common = a.join(b, "value").agg(F.count(F.lit(1))).scalar()
    na = a.agg(F.count(F.lit(1))).scalar()
    nb = b.agg(F.count(F.lit(1))).scalar()
    one = left.sparkSession.range(1)
    return one.select(
        na.alias("left_distinct"),
        nb.alias("right_distinct"),
        common.alias("common"),
    ).select(
        "left_distinct",
        "right_distinct",
        "common",
        F.round(F.try_divide(F.col("common") * 100.0, F.col("left_distinct")), 1).alias("overlap_pct_left"),
        F.round(F.try_divide(F.col("common") * 100.0, F.col("right_distinct")), 1).alias("overlap_pct_right"),
    )
