"""Registered analyses: rows and lookups, profiling and quality, cleaning,
contracts and streaming validation, version drift."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import contract as C
from ..operators import quality as Q
from ..operators import roles as RO
from ..operators import rows as T
from ..session import checkpoint_dir
from ..streaming.validate import run_validation
from . import quality_sql as QS
from .catalog import load, register
from .derived import dirty_events

# ---- T ------------------------------------------------------------------------


@register("t1_sort_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST")
def t1_sort(spark, sf):
    return T.sort_rows(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "desc")


@register(
    "t2_top_rows",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 10",
)
def t2_top(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return T.top_rows(li, "l_extendedprice", 10, tie_break=["l_orderkey", "l_linenumber"])


@register(
    "t3_extreme",
    "SELECT 'c_acctbal' AS \"column\", 'max' AS op, max(c_acctbal) AS value, count(c_acctbal) AS non_null FROM customer",
)
def t3_extreme(spark, sf):
    return T.extreme(load(spark, sf, "customer"), "c_acctbal", "max")


@register(
    "t4_extreme_rows_ties",
    """
    WITH p AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS position,
                      l_orderkey, l_linenumber, l_quantity FROM lineitem),
    h AS (SELECT * FROM p WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem))
    SELECT position, l_orderkey, l_linenumber, l_quantity AS value, (SELECT count(*) FROM h) AS tie_count FROM h
    """,
)
def t4_ties(spark, sf):
    li = load(spark, sf, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return T.extreme_rows(li, "l_quantity", "max", order, ["l_orderkey", "l_linenumber"])


@register(
    "t5_extreme_first",
    """
    SELECT 'c_acctbal' AS "column", 'min' AS op, CAST(arg_min(c_name, c_custkey) AS VARCHAR) AS label, min(c_acctbal) AS value
    FROM customer WHERE c_acctbal = (SELECT min(c_acctbal) FROM customer)
    """,
)
def t5_first(spark, sf):
    return T.extreme_first(load(spark, sf, "customer"), "c_acctbal", "min", "c_name", ["c_custkey"])


_T6_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@register(
    "t6_row_at",
    """
    WITH r AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 99),
    long AS ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM r" for c in _T6_COLS)
    + """),
    st AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    )
    + """)
    SELECT field, value, round(mean, 4) AS mean, round(std, 4) AS std,
           CASE WHEN std IS NULL OR try_cast(value AS DOUBLE) IS NULL THEN NULL
                WHEN CAST(value AS DOUBLE) > mean + 1.2 * std THEN 'high'
                WHEN CAST(value AS DOUBLE) < mean - 1.2 * std THEN 'low' ELSE 'typical' END AS flag
    FROM long LEFT JOIN st ON field = col
    """,
)
def t6_row(spark, sf):
    return T.row_at(load(spark, sf, "orders"), 100, ["o_orderkey"])


@register(
    "t7_lookup",
    "SELECT * FROM customer WHERE trim(CAST(c_custkey AS VARCHAR)) = '42' OR CAST(c_custkey AS DOUBLE) = 42.0",
)
def t7_lookup(spark, sf):
    return T.lookup(load(spark, sf, "customer"), "c_custkey", "42")


@register(
    "t8_compare_to_median",
    """
    WITH r AS (SELECT * FROM customer WHERE trim(CAST(c_custkey AS VARCHAR)) = '42' OR CAST(c_custkey AS DOUBLE) = 42.0 LIMIT 1),
    f AS (SELECT 'c_nationkey' AS field, CAST(c_nationkey AS DOUBLE) AS value FROM r UNION ALL SELECT 'c_acctbal', c_acctbal FROM r),
    st AS (SELECT 'c_nationkey' AS col, median(c_nationkey) AS med, stddev_samp(c_nationkey) AS std FROM customer
           UNION ALL SELECT 'c_acctbal', median(c_acctbal), stddev_samp(c_acctbal) FROM customer),
    j AS (SELECT field, value, med, value - med AS diff, abs(value - med) / greatest(coalesce(std, 0), 1.0) AS score FROM f JOIN st ON field = col)
    SELECT field, round(value, 4) AS value, round(med, 4) AS median, round(diff, 4) AS diff,
           CASE WHEN diff > 0 THEN 'above' WHEN diff < 0 THEN 'below' ELSE 'equal' END AS direction, round(score, 4) AS score
    FROM j ORDER BY score DESC, field LIMIT 4
    """,
)
def t8_compare(spark, sf):
    return T.compare_to_median(load(spark, sf, "customer"), "c_custkey", 42)


_T9_COLS = (("c_custkey", True), ("c_name", False), ("c_nationkey", True), ("c_acctbal", True), ("c_mktsegment", False))


def _t9_sql() -> str:
    """Entity columns of the customer table in SQL: identifier rule, display
    words, dimension rule; distinct counts from the data."""
    time_ = " OR ".join(f"contains(name, '{t}')" for t in RO.TIME_TERMS)
    dim = " OR ".join(f"contains(name, '{t}')" for t in RO.DIMENSION_TERMS)
    disp = " OR ".join(f"list_contains(words, '{t}') OR suffix(name, '{t}')" for t in RO.DISPLAY_TERMS)
    facts = " UNION ALL ".join(
        f"SELECT '{c}' AS name, {i} AS position, {str(num).lower()} AS is_numeric, count(DISTINCT {c}) AS nunique, count(*) AS n FROM customer"
        for i, (c, num) in enumerate(_T9_COLS)
    )
    return f"""
    WITH f AS ({facts}),
    g AS (SELECT *, regexp_replace(name, '[^a-z0-9]+', '', 'g') AS compact, nunique * 1.0 / greatest(n, 1) AS ratio,
                 string_split(regexp_replace(name, '[^a-z0-9]+', ' ', 'g'), ' ') AS words FROM f),
    r AS (SELECT *, ({time_}) AS is_time,
                 NOT ({time_}) AND (name = 'id' OR suffix(name, '_id') OR suffix(name, ' id') OR suffix(compact, 'id')
                   OR (is_numeric AND nunique > 0.95 * greatest(n, 1) AND (suffix(compact, 'id') OR compact IN ('id', 'identifier') OR suffix(compact, 'number')))) AS is_id
          FROM g),
    r2 AS (SELECT *,
                  is_id OR compact = 'id' OR suffix(compact, 'id')
                    OR CASE WHEN is_numeric THEN ratio >= 0.95 AND (suffix(compact, 'number') OR suffix(compact, 'key') OR compact = 'identifier')
                            ELSE ratio >= 0.95 END AS is_identifier,
                  NOT is_time AND NOT is_id AND NOT is_numeric AND (({dim}) OR nunique BETWEEN 2 AND 50) AS is_dim,
                  ({disp}) AS disp_word
           FROM r),
    a AS (SELECT count_if(is_id) AS any_id FROM r2),
    e AS (SELECT r2.*, CASE WHEN any_id > 0 THEN is_id ELSE is_identifier END AS ident FROM r2, a)
    SELECT 'identifier' AS kind, name AS "column", CAST(row_number() OVER (ORDER BY position) AS INTEGER) AS rank FROM e WHERE ident
    UNION ALL
    SELECT 'display', name, CAST(row_number() OVER (ORDER BY CASE WHEN disp_word THEN 0 ELSE 1 END, position) AS INTEGER)
    FROM e WHERE disp_word OR (is_dim AND NOT ident)
    """


@register("t9_entity_columns", _t9_sql())
def t9_entity(spark, sf):
    return RO.entity_columns(load(spark, sf, "customer"))


# ---- Q profile / quality ------------------------------------------------------------


@register(
    "q1_profile",
    """
    WITH d AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
                      CASE WHEN event_type = 'view' THEN NULL ELSE props END AS props FROM events),
    m AS (SELECT count(*) AS rows, count_if(value IS NULL OR isnan(value)) + count_if(props IS NULL) AS missing FROM d),
    g AS (SELECT count(*) AS c FROM d GROUP BY ALL)
    SELECT rows, 6 AS columns, 3 AS numeric_features, CAST(missing AS BIGINT) AS missing_total,
           round(CASE WHEN rows * 6 > 0 THEN missing * 100.0 / (rows * 6) ELSE 0 END, 1) AS missing_pct,
           CAST((SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM d GROUP BY event_id, ts, user_id, event_type, value, props)) AS BIGINT) AS duplicate_rows
    FROM m
    """,
)
def q1_profile(spark, sf):
    return Q.profile(dirty_events(spark, sf))


_Q1N = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register(
    "q1_numeric_profile",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", round(avg({c}), 2) AS mean, round(median({c}), 2) AS median, round(stddev_samp({c}), 2) AS std, "
        f"round(min({c}), 2) AS min, round(max({c}), 2) AS max FROM lineitem"
        for c in _Q1N
    ),
)
def q1_numeric(spark, sf):
    return Q.numeric_profile(load(spark, sf, "lineitem"))


_Q2_COLS = (("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True),
            ("o_orderdate", False), ("o_orderpriority", False))


def _q2_sql() -> str:
    """Role rules of Q2 in SQL: name words and type from the schema, distinct
    counts from the data."""
    metric = " OR ".join(f"contains(name, '{t}')" for t in RO.METRIC_TERMS)
    time_ = " OR ".join(f"contains(name, '{t}')" for t in RO.TIME_TERMS)
    dim = " OR ".join(f"contains(name, '{t}')" for t in RO.DIMENSION_TERMS)
    facts = " UNION ALL ".join(
        f"SELECT '{c}' AS name, {i} AS position, {str(num).lower()} AS is_numeric, count(DISTINCT {c}) AS nunique, count(*) AS n FROM orders"
        for i, (c, num) in enumerate(_Q2_COLS)
    )
    return f"""
    WITH f AS ({facts}),
    g AS (SELECT *, regexp_replace(name, '[^a-z0-9]+', '', 'g') AS compact FROM f),
    r AS (SELECT name, position, is_numeric,
                 is_numeric AND ({metric}) AS is_metric,
                 is_numeric AND NOT ({metric}) AND NOT suffix(name, 'id') AND name <> 'id' AND nunique < greatest(n * 0.95, 2) AS is_target,
                 ({time_}) AS is_time,
                 NOT ({time_}) AND (name = 'id' OR suffix(name, '_id') OR suffix(name, ' id') OR suffix(compact, 'id')
                      OR (is_numeric AND nunique > 0.95 * greatest(n, 1) AND (suffix(compact, 'id') OR compact IN ('id', 'identifier') OR suffix(compact, 'number')))) AS is_id
          FROM g),
    r2 AS (SELECT r.*, NOT r.is_time AND NOT r.is_id AND NOT r.is_numeric AND (({dim.replace('name', 'r.name')}) OR g.nunique BETWEEN 2 AND 50) AS is_dim
           FROM r JOIN g USING (name)),
    roles AS (
      SELECT name, position, 'metrics' AS role FROM r2 WHERE is_metric
      UNION ALL SELECT name, position, 'time' FROM r2 WHERE is_time
      UNION ALL SELECT name, position, 'dimensions' FROM r2 WHERE is_dim
      UNION ALL SELECT name, position, 'ids' FROM r2 WHERE is_id
      UNION ALL SELECT name, position, 'numeric' FROM r2 WHERE is_numeric
      UNION ALL SELECT name, position, 'target_candidates' FROM r2 WHERE is_target)
    SELECT name AS "column", role, CAST(row_number() OVER (PARTITION BY role ORDER BY position) AS INTEGER) AS rank FROM roles
    """


@register("q2_column_roles", _q2_sql())
def q2_roles(spark, sf):
    """Roles of the orders table. (The oracle encodes the case where metric
    and target words are present, which holds for orders; the no-metric
    fallbacks are covered by tests.)"""
    return RO.column_roles(load(spark, sf, "orders"))


_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
_CUSTOMER_KINDS = [(c, {"bigint": "integer", "int": "integer"}.get(t, t)) for c, t in _CUSTOMER.items()]


@register("q3_semantic_schema", QS.semantic_schema_sql("SELECT * FROM customer", _CUSTOMER_KINDS, _CUSTOMER))
def q3_semantic(spark, sf):
    f = Q.semantic_schema(load(spark, sf, "customer"))
    return f.withColumns({"samples": F.array_join("samples", "|"), "candidate_roles": F.array_join("candidate_roles", ",")})


@register("q4_quality_issues", QS.ISSUES)
def q4_issues(spark, sf):
    return Q.quality_issues(dirty_events(spark, sf))


@register("q5_quality_score", QS.SCORE)
def q5_score(spark, sf):
    return Q.quality_score(dirty_events(spark, sf))


def dirty_table(spark, sf):
    """Events made dirty by rule: padded text, an all-null column, missing
    values and exact copies of every click row."""
    d = dirty_events(spark, sf).select(
        "event_id",
        "user_id",
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("  "), F.col("event_type"))).otherwise(F.col("event_type")).alias("event_type"),
        "value",
        "props",
        F.lit(None).cast("string").alias("empty_col"),
    )
    return d.unionByName(d.where(F.col("event_type") == "click"))


_DIRTY_SQL = """
d0 AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN '  ' || event_type ELSE event_type END AS event_type,
              CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
              CASE WHEN event_type = 'view' THEN NULL ELSE props END AS props, CAST(NULL AS VARCHAR) AS empty_col FROM events),
d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE event_type = 'click')
"""


_DIRTY_COLUMNS = (("event_id", "integer"), ("user_id", "integer"), ("event_type", "text"), ("value", "double"), ("props", "text"), ("empty_col", "text"))
_DIRTY_TYPES = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string", "empty_col": "string"}
_CLEANED = f"""WITH {_DIRTY_SQL},
    x AS (SELECT DISTINCT event_id, user_id, regexp_replace(event_type, '^\\s+|\\s+$', '', 'g') AS event_type, value, props FROM d)
    SELECT event_id, user_id, event_type, coalesce(value, (SELECT median(value) FROM x)) AS value, props FROM x"""


@register("q6_cleaning_plan", QS.cleaning_sql(f"WITH {_DIRTY_SQL} SELECT * FROM d", _DIRTY_COLUMNS, _CLEANED, _DIRTY_COLUMNS[:-1]))
def q6_plan(spark, sf):
    return Q.cleaning_plan(dirty_table(spark, sf)).withColumn("columns", F.array_join("columns", "|"))


@register(
    "q7_clean_all_actions",
    "WITH "
    + _DIRTY_SQL
    + """,
    t AS (SELECT DISTINCT event_id, user_id, regexp_replace(event_type, '^\\s+|\\s+$', '', 'g') AS event_type, value, props FROM d),
    m AS (SELECT median(value) AS mv FROM t),
    mo AS (SELECT props AS mp FROM t WHERE props IS NOT NULL GROUP BY props ORDER BY count(*) DESC, props LIMIT 1)
    SELECT event_id, user_id, event_type, coalesce(value, mv) AS value, coalesce(props, mp) AS props FROM t, m, mo
    """,
)
def q7_clean(spark, sf):
    cleaned, _ = Q.clean(dirty_table(spark, sf), list(Q.CLEAN_ORDER))
    return cleaned


@register(
    "q9_dedupe_only",
    "WITH " + _DIRTY_SQL + " SELECT DISTINCT * FROM d",
)
def q9_dedupe(spark, sf):
    cleaned, _ = Q.clean(dirty_table(spark, sf), ["remove_duplicate_rows"])
    return cleaned


@register("q12_column_dictionary", QS.dictionary_sql(f"WITH {_DIRTY_SQL} SELECT * FROM d", _DIRTY_COLUMNS, _DIRTY_TYPES))
def q12_dict(spark, sf):
    lists = {c: F.array_join(c, "|") for c in ("sample_values", "warnings")}
    return Q.column_dictionary(dirty_table(spark, sf)).withColumns(lists)


@register("q13_infer_types", QS.TYPES)
def q13_types(spark, sf):
    return C.infer_types(load(spark, sf, "events"))


@register("q14_infer_contract", QS.CONTRACT)
def q14_contract(spark, sf):
    lists = {c: F.array_join(c, "|") for c in ("allowed_values", "rules")}
    return C.infer_contract(load(spark, sf, "events")).withColumns(lists)


def new_event_rows(spark, sf):
    """Rows to validate, derived from events by rule: an unseen category, an
    unparsable number, a missing required value and an extra column."""
    ev = load(spark, sf, "events")
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        F.when(F.col("value") > 95, F.lit("other")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("string")).otherwise(F.col("props")).alias("props"),
        F.lit("x").alias("extra"),
    )


_Q15_SQL = """
WITH n AS (SELECT event_id, ts, user_id, CASE WHEN value > 95 THEN 'other' ELSE event_type END AS event_type,
                  CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value,
                  CASE WHEN event_type = 'view' THEN NULL ELSE props END AS props, 'x' AS extra FROM events)
SELECT event_id AS "row", 'props' AS "column", 'error' AS severity, 'missing_required' AS code FROM n WHERE props IS NULL OR trim(props) = ''
UNION ALL SELECT event_id, 'value', 'error', 'type_mismatch' FROM n
  WHERE NOT (value IS NULL OR trim(value) = '') AND try_cast(trim(value) AS DOUBLE) IS NULL
UNION ALL SELECT event_id, 'event_type', 'warning', 'unknown_category' FROM n
  WHERE NOT (event_type IS NULL OR trim(event_type) = '') AND event_type NOT IN (SELECT DISTINCT event_type FROM events)
UNION ALL SELECT event_id, 'extra', 'warning', 'extra_column' FROM n
"""


@register("q15_validate_rows", _Q15_SQL)
def q15_validate(spark, sf):
    contract = C.infer_contract(load(spark, sf, "events"))
    return C.validate(new_event_rows(spark, sf), contract, "event_id")


@register(
    "q15_validation_summary",
    "WITH i AS (" + _Q15_SQL + """)
    SELECT (SELECT count(*) FROM events) AS total_rows,
           (SELECT count(*) FROM events) - (SELECT count(DISTINCT "row") FROM i WHERE severity = 'error') AS valid_rows,
           (SELECT count(DISTINCT "row") FROM i WHERE severity = 'error') AS invalid_rows,
           (SELECT count(*) FROM i WHERE severity = 'error') AS errors,
           (SELECT count(*) FROM i WHERE severity = 'warning') AS warnings
    """,
)
def q15_summary(spark, sf):
    rows = new_event_rows(spark, sf)
    issues = C.validate(rows, C.infer_contract(load(spark, sf, "events")), "event_id")
    return C.validation_summary(rows, issues, "event_id")


@register("q16_validate_stream", _Q15_SQL)
def q16_stream(spark, sf):
    """The events file is read as a file-source stream (availableNow) and
    validated into a parquet sink in the shared checkpoint folder; the sink is
    then read back as a batch."""
    base = os.path.join(checkpoint_dir(spark), f"q16-{uuid.uuid4().hex}")
    contract = C.infer_contract(load(spark, sf, "events")).collect()
    ev_schema = load(spark, sf, "events").schema
    stream = spark.readStream.schema(ev_schema).option("pathGlobFilter", "events.parquet").parquet(sf.rstrip("/"))
    rows = stream.select(
        "event_id",
        "ts",
        "user_id",
        F.when(F.col("value") > 95, F.lit("other")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("string")).otherwise(F.col("props")).alias("props"),
        F.lit("x").alias("extra"),
    )
    qry = run_validation(rows, contract, "event_id", f"{base}/out", f"{base}/ckpt")
    qry.awaitTermination()
    return spark.read.schema("row bigint, column string, severity string, code string").parquet(f"{base}/out")


@register(
    "q17_drift",
    """
    WITH a AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
         b AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
    s AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT avg({c}) FROM a) AS m1, (SELECT stddev_samp({c}) FROM a) AS s1, (SELECT median({c}) FROM a) AS med1, "
        f"(SELECT avg({c}) FROM b) AS m2, (SELECT stddev_samp({c}) FROM b) AS s2, (SELECT median({c}) FROM b) AS med2"
        for c in _Q1N
    )
    + """)
    SELECT "column", round(m1, 2) AS v1_mean, round(m2, 2) AS v2_mean, round(med1, 2) AS v1_median, round(med2, 2) AS v2_median,
           round(m2 - m1, 2) AS mean_delta, round((m2 - m1) / greatest(1e-5, abs(m1)) * 100, 1) AS pct_shift,
           least(1.0, round(abs(m2 - m1) / greatest(1e-5, (s1 + s2) / 2), 2)) AS drift_score,
           CASE WHEN least(1.0, round(abs(m2 - m1) / greatest(1e-5, (s1 + s2) / 2), 2)) > 0.5 THEN 'Significant'
                WHEN least(1.0, round(abs(m2 - m1) / greatest(1e-5, (s1 + s2) / 2), 2)) > 0.2 THEN 'Moderate'
                WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN 'Low' END AS drift_level
    FROM s
    """,
)
def q17_drift(spark, sf):
    li = load(spark, sf, "lineitem")
    a = li.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    b = li.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return Q.drift(a, b)


_Q17_COLUMNS = {
    "l_orderkey": ("bigint",) * 2, "l_partkey": ("bigint",) * 2, "l_suppkey": ("bigint",) * 2, "l_linenumber": ("int", "bigint"),
    "l_quantity": ("double",) * 2, "l_extendedprice": ("double",) * 2, "l_discount": ("double",) * 2, "l_tax": ("double", None),
    "l_returnflag": ("string",) * 2, "l_linestatus": ("string",) * 2, "l_shipdate": ("timestamp_ntz",) * 2, "l_net": (None, "double"),
}
_Q17_SQL = (
    "WITH n AS (SELECT count_if(l_shipdate < TIMESTAMP '1998-01-01') AS a, count_if(l_shipdate >= TIMESTAMP '1998-01-01') AS b FROM lineitem), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {f"'{x}'" if x else 'CAST(NULL AS VARCHAR)'} AS v1_type, {f"'{y}'" if y else 'CAST(NULL AS VARCHAR)'} AS v2_type"
        for c, (x, y) in _Q17_COLUMNS.items()
    )
    + """)
    SELECT "column", v1_type, v2_type,
           CASE WHEN v1_type IS NULL THEN 'added' WHEN v2_type IS NULL THEN 'removed' WHEN v1_type <> v2_type THEN 'type_changed' ELSE 'same' END AS change,
           CAST(a AS BIGINT) AS v1_rows, CAST(b AS BIGINT) AS v2_rows, CAST(b - a AS BIGINT) AS row_delta, round((b - a) * 100.0 / greatest(a, 1), 1) AS row_pct_change
    FROM c, n"""
)


@register("q17_compare_schemas", _Q17_SQL)
def q17_schema(spark, sf):
    li = load(spark, sf, "lineitem")
    a = li.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    b = li.where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    b = b.withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount"))).drop("l_tax").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    return Q.compare_schemas(a, b)


@register("q18_fingerprint")
def q18_fp(spark, sf):
    return Q.fingerprint(load(spark, sf, "lineitem"))


def _a5_sql() -> str:
    """Identifier rule (role id, a name ending in "id", or >= 95% unique, with
    a number/key/identifier name for numerics) and the op table in SQL."""
    time_ = " OR ".join(f"contains(name, '{t}')" for t in RO.TIME_TERMS)
    facts = " UNION ALL ".join(
        f"SELECT '{c}' AS name, {str(num).lower()} AS is_numeric, count(DISTINCT {c}) AS nunique, count(*) AS n FROM orders"
        for c, num in _Q2_COLS
    )
    ops = ", ".join(f"('{o}')" for o in Q.AGG_OPS)
    return f"""
    WITH f AS ({facts}),
    g AS (SELECT *, regexp_replace(name, '[^a-z0-9]+', '', 'g') AS compact, nunique * 1.0 / greatest(n, 1) AS ratio FROM f),
    r AS (SELECT name, is_numeric,
                 (NOT ({time_}) AND (name = 'id' OR suffix(name, '_id') OR suffix(name, ' id') OR suffix(compact, 'id')
                   OR (is_numeric AND nunique > 0.95 * greatest(n, 1) AND (suffix(compact, 'id') OR compact IN ('id', 'identifier') OR suffix(compact, 'number')))))
                 OR compact = 'id' OR suffix(compact, 'id')
                 OR CASE WHEN is_numeric THEN ratio >= 0.95 AND (suffix(compact, 'number') OR suffix(compact, 'key') OR compact = 'identifier')
                         ELSE ratio >= 0.95 END AS ident
          FROM g),
    o AS (SELECT * FROM (VALUES {ops}) t(op))
    SELECT name AS "column", op,
           CASE WHEN ident THEN op IN ('count', 'count_distinct') WHEN NOT is_numeric THEN op NOT IN ('sum', 'mean', 'median') ELSE true END AS allowed,
           CASE WHEN ident AND op NOT IN ('count', 'count_distinct') THEN 'identifier'
                WHEN NOT ident AND NOT is_numeric AND op IN ('sum', 'mean', 'median') THEN 'not_numeric' ELSE 'ok' END AS reason
    FROM r, o
    """


@register("a5_measure_eligibility", _a5_sql())
def a5_elig(spark, sf):
    return Q.measure_eligibility(load(spark, sf, "orders"))


# ---- single cleaning actions and coercions -----------------------------------------


@register("q8_drop_empty_columns", "WITH " + _DIRTY_SQL + " SELECT event_id, user_id, event_type, value, props FROM d")
def q8_drop_empty(spark, sf):
    cleaned, _ = Q.clean(dirty_table(spark, sf), ["drop_empty_columns"])
    return cleaned


@register(
    "q10_fill_numeric_median",
    "WITH " + _DIRTY_SQL + ", m AS (SELECT median(value) AS mv FROM d) "
    "SELECT event_id, user_id, event_type, coalesce(value, mv) AS value, props, empty_col FROM d, m",
)
def q10_median(spark, sf):
    cleaned, _ = Q.clean(dirty_table(spark, sf), ["fill_numeric_median"])
    return cleaned


@register(
    "q11_fill_categorical_mode",
    "WITH " + _DIRTY_SQL + """,
    mo AS (SELECT props AS mp FROM d WHERE props IS NOT NULL GROUP BY props ORDER BY count(*) DESC, props LIMIT 1),
    me AS (SELECT event_type AS me FROM d WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)
    SELECT event_id, user_id, coalesce(event_type, me) AS event_type, value, coalesce(props, mp) AS props, empty_col FROM d, mo, me
    """,
)
def q11_mode(spark, sf):
    cleaned, _ = Q.clean(dirty_table(spark, sf), ["fill_categorical_mode"])
    return cleaned


@register(
    "s8_clean_export",
    "WITH " + _DIRTY_SQL + """
    SELECT (SELECT count(*) FROM d) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS rows_after,
           (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS rows_removed,
           6 AS columns_before, 5 AS columns_after, 1 AS columns_removed
    """,
)
def s8_export(spark, sf):
    from ..sources.io import clean_export

    path = os.path.join(checkpoint_dir(spark), f"s8-{uuid.uuid4().hex}")
    return clean_export(dirty_table(spark, sf), ["drop_empty_columns", "remove_duplicate_rows"], path)


@register(
    "f6_to_number",
    """
    SELECT event_id, try_cast(trim(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END) AS DOUBLE) AS value
    FROM events
    """,
)
def f6_number(spark, sf):
    from ..operators.filters import coerce_numbers

    ev = load(spark, sf, "events")
    txt = ev.select("event_id", F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"))
    return coerce_numbers(txt, ["value"])


@register(
    "f7_to_date_mixed",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus IS DISTINCT FROM 'F' AND o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders
    """,
)
def f7_dates(spark, sf):
    """Order dates written as text in three layouts (one unparsable) and
    parsed back with the mixed-format coercion."""
    from ..operators.filters import coerce_dates

    o = load(spark, sf, "orders")
    txt = o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("someday"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("o_orderdate"),
    )
    return coerce_dates(txt, ["o_orderdate"]).select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
