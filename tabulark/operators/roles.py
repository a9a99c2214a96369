"""Column roles and identifier detection (Q2, T9 helpers, A5).

Rules read only the column name, its type class and its distinct count; they
are evaluated as Spark expressions over ``column_facts`` (one row per column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .profile import column_facts

# Name words (substring match on the lower-cased name) per role.
METRIC_TERMS = ("revenue", "sales", "profit", "cost", "amount", "quantity", "price", "rating", "score", "value", "total", "margin")
TIME_TERMS = ("date", "time", "month", "year", "timestamp", "created", "updated")
DIMENSION_TERMS = ("category", "region", "segment", "product", "department", "channel", "city", "country", "state", "status", "group")
# Words that mark a display (label) column.
DISPLAY_TERMS = ("name", "title", "label")


def _has_any(name: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | name.contains(t)
    return out


def role_flags(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row per column with boolean role flags: metric, target_candidate,
    time, id, dimension (before the no-metric fallback). ``facts``: the
    table's ``column_facts``, where they are known."""
    f = column_facts(df) if facts is None else facts
    name = F.lower("column")
    compact = F.regexp_replace(name, "[^a-z0-9]+", "")
    rows = F.greatest(F.col("rows"), F.lit(1))
    is_time = _has_any(name, TIME_TERMS)
    id_name = (name == "id") | name.endswith("_id") | name.endswith(" id") | compact.endswith("id")
    id_numeric = F.col("is_numeric") & (F.col("distinct") > 0.95 * rows) & (
        compact.endswith("id") | compact.isin("id", "identifier") | compact.endswith("number")
    )
    is_id = ~is_time & (id_name | id_numeric)
    metric = F.col("is_numeric") & _has_any(name, METRIC_TERMS)
    target = F.col("is_numeric") & ~metric & ~name.endswith("id") & (name != "id") & (
        F.col("distinct") < F.greatest(F.col("rows") * 0.95, F.lit(2))
    )
    dim = ~is_time & ~is_id & ~F.col("is_numeric") & (
        _has_any(name, DIMENSION_TERMS) | F.col("distinct").between(2, 50)
    )
    return f.select(
        "*",
        metric.alias("is_metric"),
        target.alias("is_target_candidate"),
        is_time.alias("is_time"),
        is_id.alias("is_id"),
        dim.alias("is_dimension"),
    )


def column_roles(df: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Q2: long ``(column, role, rank)``; a column may hold several roles.
    Without any metric-named column, the first three numeric non-ids are metrics;
    without target candidates, the first three metrics are."""
    fl = role_flags(df) if flags is None else flags
    any_metric = fl.agg(F.count_if("is_metric")).scalar()
    fallback = F.col("is_numeric") & ~F.col("is_id")
    w = Window.orderBy("position")  # one row per column: bounded by the schema
    fl = fl.withColumn("_fb_rank", F.sum(F.when(fallback, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    metric = F.when(any_metric > 0, F.col("is_metric")).otherwise(fallback & (F.col("_fb_rank") <= 3))
    fl = fl.withColumn("is_metric_final", metric)
    fl = fl.withColumn("_m_rank", F.sum(F.when(F.col("is_metric_final"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    any_target = fl.agg(F.count_if("is_target_candidate")).scalar()
    target = F.when(any_target > 0, F.col("is_target_candidate")).otherwise(F.col("is_metric_final") & (F.col("_m_rank") <= 3))
    roles = F.array_compact(
        F.array(
            F.when(F.col("is_metric_final"), F.lit("metrics")),
            F.when(F.col("is_time"), F.lit("time")),
            F.when(F.col("is_dimension"), F.lit("dimensions")),
            F.when(F.col("is_id"), F.lit("ids")),
            F.when(F.col("is_numeric"), F.lit("numeric")),
            F.when(target, F.lit("target_candidates")),
        )
    )
    long = fl.select("column", "position", F.explode(roles).alias("role"))
    wr = Window.partitionBy("role").orderBy("position")
    return long.select("column", "role", F.row_number().over(wr).alias("rank"))


def identifier_flags(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(column, is_identifier): an id role, a name ending in "id", or >= 95%
    unique (numeric columns also need a number/key/identifier name)."""
    fl = role_flags(df, facts)
    name = F.regexp_replace(F.lower("column"), "[^a-z0-9]+", "")
    ratio = F.col("distinct") / F.greatest(F.col("rows"), F.lit(1))
    numeric_rule = (ratio >= 0.95) & (name.endswith("number") | name.endswith("key") | (name == "identifier"))
    ident = F.col("is_id") | (name == "id") | name.endswith("id") | F.when(F.col("is_numeric"), numeric_rule).otherwise(ratio >= 0.95)
    return fl.select("column", "position", ident.alias("is_identifier"), "is_dimension", "is_numeric", "distinct", "rows")


def entity_columns(df: DataFrame, entity: str | None = None) -> DataFrame:
    """Identifier candidates and display candidates, long
    ``(kind, column, rank)`` with kind in {identifier, display}."""
    known = cut_lineage(column_facts(df))
    fl = identifier_flags(df, known).join(role_flags(df, known).select("column", "is_id"), "column")
    norm = F.regexp_replace(F.lower("column"), "[^a-z0-9]+", "")
    any_id = fl.agg(F.count_if("is_id")).scalar()
    preferred = F.lit(False)
    if entity:
        e = "".join(ch for ch in entity.lower() if ch.isalnum())
        preferred = norm.isin(f"{e}id", f"{e}number", f"{e}no")
    ident = preferred | F.when(any_id > 0, F.col("is_id")).otherwise(F.col("is_identifier"))
    words = F.split(F.regexp_replace(F.lower("column"), "[^a-z0-9]+", " "), " ")
    disp_word = F.lit(False)
    for t in DISPLAY_TERMS:
        disp_word = disp_word | F.array_contains(words, t) | F.lower("column").endswith(t)
    display = disp_word | (F.col("is_dimension") & ~ident)
    w_i = Window.orderBy(F.when(preferred, 0).otherwise(1), "position")
    w_d = Window.orderBy(F.when(disp_word, 0).otherwise(1), "position")
    ids = fl.where(ident).select(F.lit("identifier").alias("kind"), "column", F.row_number().over(w_i).alias("rank"))
    ds = fl.where(display).select(F.lit("display").alias("kind"), "column", F.row_number().over(w_d).alias("rank"))
    return ids.unionByName(ds)
