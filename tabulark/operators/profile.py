"""The two shared fact tables most operators derive from.

``column_stats``: one pass over the table for counts/moments, plus the
distributed exact quartiles. ``value_freq``: every cell unpivoted to
(column, value-as-text) and counted, which yields distinct counts, modes, top
values, samples and allowed-value sets without one ``countDistinct`` per
column (Spark's Expand would replicate every row once per distinct column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import numeric_columns, q, scalar_columns
from ..functions.ordering import long_values, quantile_wide, top_k_per_group
from ..functions.stats import kurt_expr, skew_expr


def value_freq(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value string, count) for every distinct value (null included as
    a null value). Map-side combine keeps hot values cheap to shuffle."""
    cols = list(cols) if cols else scalar_columns(df)
    if not cols:
        raise ValueError("no scalar columns")
    sel = [q(c).cast("string").alias(f"__c{i}") for i, c in enumerate(cols)]
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', `__c{i}`" for i, c in enumerate(cols))
    long = df.select(*sel).select(F.expr(f"stack({len(cols)}, {pairs}) as (column, value)"))
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def modes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, mode, mode_count): most frequent non-null value, smallest text on ties.
    An aggregate (bounded buffer), not a sort of all distinct values."""
    vf = value_freq(df, cols).where(F.col("value").isNotNull())
    return vf.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode"), F.max("count").alias("mode_count")
    )


def samples(df: DataFrame, cols: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """(column, samples array): the ``k`` smallest distinct non-null values as text
    (deterministic; the reference shows the first rows instead)."""
    vf = value_freq(df, cols).where(F.col("value").isNotNull())
    top = top_k_per_group(vf, ["column"], [F.col("value")], k)
    return top.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def column_stats(df: DataFrame, cols: Sequence[str] | None = None, quartiles: bool = True) -> DataFrame:
    """One row per numeric column: count, nulls, mean, std, min, max, skew,
    kurtosis, and (optionally) exact quartiles."""
    cols = list(cols) if cols else numeric_columns(df)
    if not cols:
        raise ValueError("no numeric columns")
    long = long_values(df, cols)
    n = df.agg(F.count(F.lit(1))).scalar()
    base = long.groupBy("column").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.stddev_pop("v").alias("std_pop"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        skew_expr(F.col("v")).alias("skew"),
        kurt_expr(F.col("v")).alias("kurtosis"),
        F.count_if(F.col("v") == 0).alias("zeros"),
    )
    allc = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in cols])).alias("column")
    )
    out = allc.join(base, "column", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    out = out.withColumn("nulls", n - F.col("count"))
    if quartiles:
        qs = quantile_wide(df, cols, [0.25, 0.5, 0.75], names=["q1", "median", "q3"])
        out = out.join(qs, "column", "left")
    return out


def schema_frame(df: DataFrame) -> DataFrame:
    """The table's schema as a small DataFrame (one row per column): name,
    position and type classes. Metadata only: its size is the column count."""
    from ..functions.columns import is_integral, is_numeric, is_string, is_temporal

    rows = [
        (f.name, i, f.dataType.simpleString(), is_numeric(f.dataType), is_integral(f.dataType), is_string(f.dataType),
         is_temporal(f.dataType), f.dataType.typeName() == "boolean")
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, position int, dtype string, is_numeric boolean, is_integer boolean, is_string boolean, "
        "is_temporal boolean, is_boolean boolean",
    )


def comparable(df: DataFrame, name: str) -> Column:
    """The column as something that can be hashed: maps, which cannot, as JSON
    of their sorted entries."""
    c, kind = q(name), df.schema[name].dataType
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c))) if "map<" not in kind.valueType.simpleString() else F.to_json(c)
    return F.to_json(c) if "map<" in kind.simpleString() else c


def row_hashes(df: DataFrame) -> list[Column]:
    """128 bits of a whole row. Nulls count: a bare hash would skip them."""
    cells = [x for c in df.columns for x in (comparable(df, c), q(c).isNull())]
    return [F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)]


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, rows: bool = False) -> DataFrame:
    """(column, distinct, non_null) of the scalar columns' values as text and,
    with ``rows``, of whole rows under a null name. Values travel as 128 bits,
    whatever their length; with D different values a clash has a probability
    of about D^2 / 2^129."""
    cols = list(cols) if cols is not None else scalar_columns(df)
    cells = [(i, q(c).cast("string")) for i, c in enumerate(cols)]
    hashed = [F.struct(F.lit(i).alias("i"), F.when(c.isNotNull(), F.xxhash64(c)).alias("h1"), F.when(c.isNotNull(), F.xxhash64(F.lit(1), c)).alias("h2")) for i, c in cells]
    if rows:
        h1, h2 = row_hashes(df)
        hashed.append(F.struct(F.lit(-1).alias("i"), h1.alias("h1"), h2.alias("h2")))
    long = df.select(F.explode(F.array(*hashed)).alias("c")).select("c.*")
    counted = long.groupBy("i", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("i").agg(F.count("h1").alias("distinct"), F.coalesce(F.sum(F.when(F.col("h1").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1) if cols else F.lit(None)
    return totals.select(F.when(F.col("i") >= 0, name).alias("column"), "distinct", "non_null")


def column_facts(df: DataFrame, counts: DataFrame | None = None, rows: int | Column | None = None) -> DataFrame:
    """Schema frame + rows, non-null and distinct counts per column (complex
    columns get null counts). ``counts`` and ``rows`` where they are known."""
    n = df.agg(F.count(F.lit(1))).scalar() if rows is None else F.lit(rows).cast("long")
    counts = distinct_counts(df) if counts is None else counts.where(F.col("column").isNotNull())
    return schema_frame(df).join(counts, "column", "left").select("*", n.alias("rows")).withColumn("nulls", F.col("rows") - F.col("non_null"))
