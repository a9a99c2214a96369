"""Data contracts: type inference, contract inference, row validation (Q13-Q15).

The contract is a small DataFrame (one row per column). Validation turns it
into per-row column expressions, so checking works unchanged on a batch or a
streaming DataFrame (Q16) and never gathers rows anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import is_blank, to_number, to_timestamp_mixed
from ..functions.columns import q, scalar_columns
from .profile import value_freq
from .roles import role_flags

# Text accepted as a boolean token by contracts (lower-cased, trimmed).
BOOL_TOKENS = ("true", "false", "yes", "no", "0", "1")
MAX_ALLOWED = 20


def infer_types(df: DataFrame) -> DataFrame:
    """Q13: ``(column, type)`` with type in string/boolean/integer/number/date.
    Text columns: >= .9 boolean tokens -> boolean, else >= .8 parse as dates
    -> date, else >= .9 parse as numbers -> number, else string. Ratios for
    all text columns come from one aggregate."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = q(f.name)
        nn = c.isNotNull()
        aggs.append(F.count_if(nn).alias(f"n{i}"))
        if f.dataType.typeName() == "string":
            # only text needs sniffing; typed columns have a fixed contract type
            s = F.trim(c)
            aggs += [
                F.count_if(nn & F.lower(s).isin(*BOOL_TOKENS)).alias(f"b{i}"),
                F.count_if(nn & to_timestamp_mixed(c).isNotNull()).alias(f"d{i}"),
                F.count_if(nn & to_number(c).isNotNull()).alias(f"x{i}"),
            ]
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        t = f.dataType.typeName()
        n, b, d, x = F.col(f"n{i}"), F.col(f"b{i}"), F.col(f"d{i}"), F.col(f"x{i}")
        if t == "boolean":
            kind = F.lit("boolean")
        elif t in ("byte", "short", "integer", "long"):
            kind = F.lit("integer")
        elif t in ("float", "double") or t.startswith("decimal"):
            kind = F.lit("number")
        elif t in ("date", "timestamp", "timestamp_ntz"):
            kind = F.lit("date")
        elif t == "string":
            kind = (
                F.when(b >= 0.9 * n, "boolean").when(d >= 0.8 * n, "date").when(x >= 0.9 * n, "number").otherwise("string")
            )
        else:
            kind = F.lit("string")
        kind = F.when(n == 0, F.lit("string")).otherwise(kind)
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("position"), kind.alias("type")))
    return wide.select(F.inline(F.array(*rows)))


def infer_contract(df: DataFrame) -> DataFrame:
    """Q14: one row per column: type, role, required, nullable, completeness %,
    unique count, min/max (numbers and dates, as text), allowed values (text
    columns with 1-20 distinct values, sorted) and rules."""
    types = infer_types(df)
    facts = role_flags(df).select("column", "rows", "nulls", "distinct", "is_id", "is_time", "is_metric", "is_dimension")
    vf = value_freq(df, scalar_columns(df)).where(F.col("value").isNotNull())
    small = vf.groupBy("column").agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") <= MAX_ALLOWED)
    allowed = vf.join(small, "column").groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("_allowed"))
    mm_parts = []
    for f in df.schema.fields:
        c = q(f.name)
        t = f.dataType.typeName()
        num_ok = t == "string" or (t not in ("date", "timestamp", "timestamp_ntz", "boolean") and t != "binary")
        date_src = c if t in ("date", "timestamp", "timestamp_ntz") else (to_timestamp_mixed(c) if t == "string" else None)
        mm_parts.append(
            F.struct(
                F.lit(f.name).alias("column"),
                (F.min(to_number(c)) if num_ok else F.lit(None).cast("double")).alias("nmin"),
                (F.max(to_number(c)) if num_ok else F.lit(None).cast("double")).alias("nmax"),
                (F.date_format(F.min(date_src), "yyyy-MM-dd") if date_src is not None else F.lit(None).cast("string")).alias("dmin"),
                (F.date_format(F.max(date_src), "yyyy-MM-dd") if date_src is not None else F.lit(None).cast("string")).alias("dmax"),
            )
        )
    mm = df.agg(F.array(*mm_parts).alias("a")).select(F.inline("a"))
    j = types.join(facts, "column").join(allowed, "column", "left").join(mm, "column", "left")
    rows = F.greatest(F.col("rows"), F.lit(1))
    is_num = F.col("type").isin("integer", "number")
    is_date = F.col("type") == "date"
    role = (
        F.when(F.col("is_id"), "identifier").when(F.col("is_time"), "time").when(F.col("is_metric"), "metric")
        .when(F.col("is_dimension"), "dimension").otherwise("attribute")
    )
    num_txt = lambda c: F.when(F.col(c) == F.floor(F.col(c)), F.col(c).cast("long").cast("string")).otherwise(F.col(c).cast("string"))
    mn = F.when(is_num, num_txt("nmin")).when(is_date, F.col("dmin"))
    mx = F.when(is_num, num_txt("nmax")).when(is_date, F.col("dmax"))
    allowed_col = F.when((F.col("type") == "string") & F.col("_allowed").isNotNull(), F.col("_allowed"))
    rules = F.array_compact(
        F.array(
            F.when(is_num & mn.isNotNull(), F.lit("must_parse_as_number")),
            F.when(is_date & mn.isNotNull(), F.lit("must_parse_as_date")),
            F.when(allowed_col.isNotNull(), F.lit("prefer_known_category")),
            F.when(F.col("nulls") == 0, F.lit("required")),
        )
    )
    return j.select(
        "column",
        "position",
        "type",
        role.alias("role"),
        (F.col("nulls") == 0).alias("required"),
        (F.col("nulls") > 0).alias("nullable"),
        F.round((F.col("rows") - F.col("nulls")) * 100.0 / rows, 1).alias("completeness_pct"),
        F.col("distinct").alias("unique_count"),
        mn.alias("min"),
        mx.alias("max"),
        allowed_col.alias("allowed_values"),
        rules.alias("rules"),
    )


def _type_error(c: Column, kind: str) -> Column | None:
    if kind in ("integer", "number"):
        x = to_number(c)
        bad = x.isNull()
        if kind == "integer":
            bad = bad | (x != F.floor(x))
        return bad
    if kind == "date":
        return to_timestamp_mixed(c).isNull()
    if kind == "boolean":
        return ~F.lower(F.trim(c.cast("string"))).isin(*BOOL_TOKENS)
    return None


def validate(df: DataFrame, contract: DataFrame | list, row_id: str) -> DataFrame:
    """Q15: issues ``(row, column, severity, code)``. missing_required and
    type_mismatch are errors; unknown_category and extra_column warnings;
    min/max are not enforced; blank text counts as missing. ``row_id`` names
    the caller's row identifier column.

    The contract is read once on the driver (one row per column, at most 20
    allowed values each) to build the per-row expressions."""
    spec = contract.collect() if isinstance(contract, DataFrame) else contract
    cols = {r["column"]: r for r in spec}
    temporal = {f.name for f in df.schema.fields if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")}
    checks = []
    for name, r in cols.items():
        present = name in df.columns
        c = q(name) if present else F.lit(None).cast("string")
        blank = is_blank(c)
        mk = lambda sev, code: F.struct(F.lit(name).alias("column"), F.lit(sev).alias("severity"), F.lit(code).alias("code"))
        if r["required"]:
            checks.append(F.when(blank, mk("error", "missing_required")))
        if not present:
            continue
        bad = _type_error(c, r["type"]) if not (r["type"] == "date" and name in temporal) else None
        if bad is not None:
            checks.append(F.when(~blank & bad, mk("error", "type_mismatch")))
        allowed = r["allowed_values"]
        if allowed:
            checks.append(F.when(~blank & ~c.cast("string").isin(*allowed), mk("warning", "unknown_category")))
    for extra in sorted(set(df.columns) - set(cols) - {row_id}):
        checks.append(F.struct(F.lit(extra).alias("column"), F.lit("warning").alias("severity"), F.lit("extra_column").alias("code")))
    if not checks:
        return df.select(q(row_id).alias("row"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("code")).where(F.lit(False))
    issues = df.select(q(row_id).alias("row"), F.explode(F.array_compact(F.array(*checks))).alias("i"))
    return issues.select("row", "i.column", "i.severity", "i.code")


def validation_summary(df: DataFrame, issues: DataFrame, row_id: str) -> DataFrame:
    """Q15 summary: total, valid and invalid rows, error and warning counts."""
    bad_rows = issues.where(F.col("severity") == "error").select("row").distinct()
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    invalid = bad_rows.agg(F.count(F.lit(1))).scalar()
    errors = issues.agg(F.count_if(F.col("severity") == "error")).scalar()
    warns = issues.agg(F.count_if(F.col("severity") == "warning")).scalar()
    return total.select(
        "total_rows", (F.col("total_rows") - invalid).alias("valid_rows"), invalid.alias("invalid_rows"),
        errors.alias("errors"), warns.alias("warnings"),
    )
