"""Projection, filters and predicates.

All predicates are Catalyst expressions, so simple comparisons on parquet
columns reach the scan as pushed filters."""

from __future__ import annotations

import operator
import uuid
from collections.abc import Mapping, Sequence
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_integral, is_numeric, is_string, present, q, resolve, scalar_columns
from ..functions.coerce import number, to_number, to_timestamp_mixed

FILTER_OPS = ("==", "!=", ">", "<", ">=", "<=", "contains", "in")


def _literal_matches(dt, value) -> bool:
    """Would pandas' ``==`` ever be true between this column and value?"""
    if isinstance(value, bool):
        return dt.typeName() == "boolean"
    if isinstance(value, (int, float)):
        return is_numeric(dt)
    if isinstance(value, str):
        return is_string(dt)
    return True


COMPARE = {"==": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def numeric_condition(c: Column, dt, op: str, value) -> Column:
    """``c op value`` with a literal of the column's own type, so that the
    column is not cast and the comparison is pushed to the scan. A value that
    is no number raises ValueError for an ordering and matches nothing for
    ``==``; NaN in the column matches nothing."""
    try:
        v = Decimal(str(value).strip())
    except ArithmeticError:
        v = None
    if v is None or not v.is_finite():
        # nothing equals such a value, and nothing compares with NaN
        if op == "==" or float(value) != float(value):
            return F.lit(False)
        return COMPARE[op](c.cast("double"), F.lit(float(value))) & ~F.isnan(c.cast("double"))
    if is_integral(dt):
        # between two integers: compare with the one on the side that decides
        whole = v.to_integral_value(ROUND_FLOOR)
        if v != whole:
            if op == "==":
                return F.lit(False)
            op = {">": ">", ">=": ">", "<": "<=", "<=": "<="}[op]
        bound = 2 ** (8 * {"byte": 1, "short": 2, "integer": 4, "long": 8}[dt.typeName()] - 1)
        if not -bound <= whole < bound:
            high = whole >= bound
            return c.isNotNull() if (op in ("<", "<=")) == high and op != "==" else F.lit(False)
        return COMPARE[op](c, F.lit(int(whole)).cast(dt))
    if isinstance(dt, T.DecimalType):
        return COMPARE[op](c, F.lit(v))
    hit = COMPARE[op](c, F.lit(float(v)))
    # NaN sorts above every number
    return hit & ~F.isnan(c) if op in (">", ">=") else hit


def filter_condition(df: DataFrame, col: str, op: str, value, regex: bool = False) -> Column:
    """One F1 predicate as a Column. Raises KeyError / ValueError when invalid."""
    name = resolve(df, col)
    dt = df.schema[name].dataType
    c = q(name)
    if op not in FILTER_OPS:
        raise ValueError(f"unknown operator {op!r}")
    if op == "==":
        return c == F.lit(value) if _literal_matches(dt, value) else F.lit(False)
    if op == "!=":
        # pandas keeps missing values for "!=": null-safe negation
        return ~c.eqNullSafe(F.lit(value)) if _literal_matches(dt, value) else F.lit(True)
    if op in (">", "<", ">=", "<="):
        if is_numeric(dt):
            return numeric_condition(c, dt, op, value)
        return COMPARE[op](to_number(c), F.lit(float(value)))
    if op == "contains":
        s = c.cast("string")
        if regex:
            return F.coalesce(s.rlike("(?i)" + str(value)), F.lit(False))
        return F.coalesce(F.lower(s).contains(str(value).lower()), F.lit(False))
    vals = list(value) if isinstance(value, (list, tuple, set)) else [value]
    keep = [v for v in vals if _literal_matches(dt, v)]
    return c.isin(*keep) if keep else F.lit(False)


def apply_filters(df: DataFrame, filters: Sequence, on_error: str = "raise", regex: bool = False) -> DataFrame:
    """AND of ``(column, op, value)`` filters.

    ``on_error="skip"`` reproduces the reference's silent skipping of unknown
    columns and unparsable values; the default raises."""
    conds = []
    for f in filters:
        col, op, value = (f["column"], f["operator"], f["value"]) if isinstance(f, Mapping) else f
        try:
            conds.append(filter_condition(df, col, op, value, regex=regex))
        except (KeyError, ValueError, TypeError):
            if on_error == "skip":
                continue
            raise
    out = df
    for c in conds:
        out = out.where(c)
    return out


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """rows with every column in ``cols`` present."""
    cols = [resolve(df, c) for c in cols]
    return df.dropna(subset=cols) if cols else df


def support(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """row support of a column subset: rows, complete rows, missing %."""
    cols = [resolve(df, c) for c in cols]
    complete = F.lit(True)
    for c in cols:
        complete = complete & present(df, c)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(complete).alias("complete_rows")).select(
        "rows",
        "complete_rows",
        F.round(
            F.when(F.col("rows") > 0, (F.col("rows") - F.col("complete_rows")) * 100.0 / F.col("rows")).otherwise(0.0),
            digits,
        ).alias("missing_pct"),
    )


def search_condition(df: DataFrame, text: str, cols: Sequence[str] | None = None) -> Column:
    """F5 predicate: literal, case-insensitive substring in any scalar column."""
    needle = text.lower()
    cols = list(cols) if cols else scalar_columns(df)
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(q(c).cast("string")).contains(needle), F.lit(False))
    return cond


def search_rows(df: DataFrame, text: str, cols: Sequence[str] | None = None) -> DataFrame:
    """rows where any column contains ``text`` (case-insensitive, literal)."""
    return df.where(search_condition(df, text, cols))


def coerce_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F6 over columns: bad values become null."""
    names = {resolve(df, c) for c in cols}
    return df.select(*[number(df, c).alias(c) if c in names else q(c) for c in df.columns])


def coerce_dates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F7 over columns: mixed-format text dates, bad values become null."""
    names = {resolve(df, c) for c in cols}
    return df.select(*[to_timestamp_mixed(q(c)).alias(c) if c in names else q(c) for c in df.columns])


def above_average(df: DataFrame, col: str) -> DataFrame:
    """F8: rows whose value is above the column's own mean (mean as a scalar
    subquery: computed once, no cross join)."""
    col = resolve(df, col)
    mean = df.agg(F.avg(number(df, col))).scalar()
    return df.where(number(df, col) > mean)


# The parts of a query, by Spark's names of their parsed nodes.
QUERY_NODES = frozenset(
    """Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
    OneRowRelation Pivot Project Repartition RepartitionByExpression Sample Sort SubqueryAlias Tail Union Unpivot UnpivotTransformer
    UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith Window
    WithWindowDefinition""".split()
)
# Functions that run code by name or read what is not a table.
REFUSED_FUNCTIONS = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length".split())


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check_expressions(jvm, node, allowed: frozenset[str], builtin: frozenset[str]) -> None:
    """Functions must be Spark's own; queries inside expressions are checked."""
    holds_query = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    todo = _items(node.expressions())
    while todo:
        e = todo.pop()
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = [str(x).lower() for x in _items(e.nameParts())]
            if len(name) != 1 or name[0] not in builtin or name[0] in REFUSED_FUNCTIONS:
                raise ValueError(f"function {'.'.join(name)!r} is not allowed")
        if holds_query.isInstance(e):
            _check_plan(jvm, e.plan(), allowed, builtin)
        todo += _items(e.children())


def _check_plan(jvm, node, allowed: frozenset[str], builtin: frozenset[str]) -> None:
    kind = node.getClass().getSimpleName()
    if kind not in QUERY_NODES:
        raise ValueError(f"only SELECT or WITH queries over the given tables are allowed, not {kind}")
    if kind == "UnresolvedRelation":
        name = [str(x).lower() for x in _items(node.multipartIdentifier())]
        if len(name) != 1 or name[0] not in allowed:
            raise ValueError(f"relation {'.'.join(name)!r} is not allowed")
    if kind == "UnresolvedWith":
        # a name holds from where it is given, and only inside this query
        for part in _items(node.cteRelations()):
            own = frozenset({str(part.productElement(0)).lower()})
            _check_plan(jvm, part.productElement(1), allowed | own if node.allowRecursion() else allowed, builtin)
            allowed = allowed | own
    _check_expressions(jvm, node, allowed, builtin)
    for child in _items(node.children()):
        _check_plan(jvm, child, allowed, builtin)


def check_read_only(spark: SparkSession, sql: str, tables: Sequence[str] = ("data",)) -> str:
    """F9 guard: one query, no command or insert, that reads ``tables``, its
    own WITH names and nothing else: no files, catalog tables, other views or
    table functions, and calls only Spark's own functions (none that runs code
    by its name). Spark's parser reads the text and its tree is checked node
    by node, so words in names and texts do not matter."""
    text = sql.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValueError(f"not one SELECT or WITH query: {e}") from e
    names = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().listFunction().mkString("\n")
    builtin = frozenset(n.strip("`").lower() for n in names.split("\n"))
    _check_plan(spark._jvm, plan, frozenset(t.lower() for t in tables), builtin)
    return text


def sql_select(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """one read-only statement over the given DataFrames and nothing else.

    The frames are bound under names of their own, so views of the caller are
    neither read nor replaced, and those names are dropped again."""
    text = check_read_only(spark, sql, list(tables))
    views = {t: f"_t{uuid.uuid4().hex}" for t in tables}
    for t, view in views.items():
        tables[t].createOrReplaceTempView(view)
    try:
        bound = ", ".join(f"`{t}` AS (SELECT * FROM {view})" for t, view in views.items())
        return spark.sql(f"WITH {bound} SELECT * FROM (\n{text}\n)" if bound else text)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
