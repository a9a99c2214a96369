"""Sorting, top-k, extremes and row lookups (T1-T8; T9 is in ``roles``).

Spark rows have no inherent order: every position-based operator takes an
explicit ``order_by``; ``functions.ordering`` finds a rank by counting or
numbers rows in range partitions (never a single-task global window)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_numeric, is_string, numeric_columns, q, resolve
from ..functions.columns import value as cell
from ..functions.ordering import long_values, nth_row, quantile_wide, row_hash, with_positions
from .filters import numeric_condition


def sort_rows(df: DataFrame, col: str, direction: str = "asc") -> DataFrame:
    """Sort by one column, nulls last in both directions."""
    c = cell(df, resolve(df, col))
    return df.orderBy(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last())


def top_rows(df: DataFrame, col: str, n: int = 10, descending: bool = True, tie_break: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows by a column (a distributed TakeOrderedAndProject)."""
    c = cell(df, resolve(df, col))
    key = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return df.orderBy(key, *[q(resolve(df, t)).asc_nulls_last() for t in tie_break]).limit(n)


def extreme(df: DataFrame, col: str, op: str = "max") -> DataFrame:
    """Max or min value and the non-null count (one row)."""
    col = resolve(df, col)
    x = cell(df, col)
    e = F.max(x) if op == "max" else F.min(x)
    return df.agg(e.alias("value"), F.count(x).alias("non_null")).select(F.lit(col).alias("column"), F.lit(op).alias("op"), "value", "non_null")


def extreme_rows(
    df: DataFrame, col: str, op: str, order_by: Sequence[str], return_cols: Sequence[str] = ()
) -> DataFrame:
    """T4: every row holding the extreme value (all ties), with its 1-based
    position in ``order_by`` order and the tie count."""
    col = resolve(df, col)
    x = cell(df, col)
    best = df.agg(F.max(x) if op == "max" else F.min(x)).scalar()
    keep = [resolve(df, c) for c in return_cols] or list(df.columns)
    pos = with_positions(df.select(*[q(c) for c in dict.fromkeys([*keep, col, *order_by])]), list(order_by), name="position")
    hits = pos.where(x == best)
    ties = hits.agg(F.count(F.lit(1))).scalar()
    return hits.select("position", *[q(c) for c in keep if c != col], x.alias("value"), ties.alias("tie_count"))


def extreme_first(df: DataFrame, col: str, op: str, label_col: str, order_by: Sequence[str]) -> DataFrame:
    """T5: the first row (in ``order_by`` order) holding the extreme value, with its label."""
    col, label_col = resolve(df, col), resolve(df, label_col)
    x = cell(df, col)
    best = df.agg(F.max(x) if op == "max" else F.min(x)).scalar()
    hits = df.where(x == best)
    order = F.struct(*[q(resolve(df, o)) for o in order_by])
    return hits.agg(F.min_by(q(label_col), order).alias("label"), F.first(x).alias("value")).select(
        F.lit(col).alias("column"), F.lit(op).alias("op"), F.col("label").cast("string").alias("label"), "value"
    )


def row_at(df: DataFrame, n: int, order_by: Sequence[str], k_std: float = 1.2, digits: int = 4) -> DataFrame:
    """The ``n``-th row (1-based) as long ``(field, value, mean, std, flag)``;
    numeric values more than ``k_std`` sample stds from the mean are flagged
    high/low. Out of range -> no rows."""
    nums = numeric_columns(df)
    row = nth_row(df, n, [resolve(df, o) for o in order_by])
    cols = list(df.columns)
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', cast(`{c}` as string)" for c in cols)
    long = row.select(F.expr(f"stack({len(cols)}, {pairs}) as (field, value)"))
    if not nums:
        return long.select("field", "value", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"), F.lit(None).cast("string").alias("flag"))
    st = long_values(df, nums).groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    # one row per numeric column: bounded by the schema
    out = long.join(F.broadcast(st), long["field"] == st["column"], "left")
    v = out["value"].try_cast("double")
    flag = F.when(F.col("std").isNull() | v.isNull(), F.lit(None)).when(v > F.col("mean") + k_std * F.col("std"), "high").when(
        v < F.col("mean") - k_std * F.col("std"), "low"
    ).otherwise("typical")
    return out.select("field", "value", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"), flag.alias("flag"))


def lookup(df: DataFrame, id_col: str, value, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows whose identifier equals ``value``: text match on the trimmed
    string form, or numeric match when the column is numeric. A miss is an
    empty result (never a positional fallback)."""
    id_col = resolve(df, id_col)
    c, dt = q(id_col), df.schema[id_col].dataType
    text = str(value).strip()
    if is_numeric(dt):
        # one literal of the column's own type, so the comparison reaches the scan
        cond = numeric_condition(c, dt, "==", text)
    elif is_string(dt):
        cond = F.trim(c) == text
    else:
        cond = F.trim(c.cast("string")) == text
    out = df.where(cond)
    return out.select(*[q(resolve(df, x)) for x in cols]) if cols else out


def compare_to_median(df: DataFrame, id_col: str, value, k: int = 4, digits: int = 4) -> DataFrame:
    """Compare one row (by identifier) with column medians. Identifier and
    constant columns are excluded; the ``k`` largest |diff| / max(std, 1) win.
    Of several rows with the identifier the one with the least row hash counts.
    Long ``(field, value, median, diff, direction, score)``."""
    from .roles import identifier_flags

    id_col = resolve(df, id_col)
    flags = identifier_flags(df)
    nums = numeric_columns(df)
    cand = flags.where(F.col("is_numeric") & ~F.col("is_identifier") & (F.col("distinct") > 1) & (F.col("column") != id_col))
    found = lookup(df, id_col, value)
    target = found.orderBy(row_hash(found)).limit(1)
    long = long_values(target, nums).select(F.col("column").alias("field"), F.col("v").alias("value"))
    st = long_values(df, nums).groupBy("column").agg(F.stddev_samp("v").alias("std"))
    med = quantile_wide(df, nums, [0.5], names=["median"])
    facts = cand.select("column").join(st, "column").join(med, "column")
    # one row per numeric column: bounded by the schema
    j = long.join(F.broadcast(facts), long["field"] == facts["column"])
    diff = F.col("value") - F.col("median")
    score = F.abs(diff) / F.greatest(F.coalesce(F.col("std"), F.lit(0.0)), F.lit(1.0))
    out = j.select(
        "field",
        F.round("value", digits).alias("value"),
        F.round("median", digits).alias("median"),
        F.round(diff, digits).alias("diff"),
        F.when(diff > 0, "above").when(diff < 0, "below").otherwise("equal").alias("direction"),
        F.round(score, digits).alias("score"),
    )
    return out.orderBy(F.col("score").desc(), "field").limit(k)
