"""SQL twins of the quality rules: the facts, issues and score of a table as
common table expressions, for the queries that build on them."""

from __future__ import annotations

from collections.abc import Sequence

from ..operators import contract as CO
from ..operators import roles as RO


def _any(name: str, terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({name}, '{t}')" for t in terms) + ")"


def quality_ctes(source: str, columns: Sequence[tuple[str, str]]) -> str:
    """``t`` (the table, from SQL text ``source``), ``n``, ``cols`` (a row per
    column), ``prof``, ``num``, ``outl``, ``issues``, ``listed`` (missing values
    as one issue) and ``scored``. ``columns``: (name, kind) in order; kind is
    "double", "integer" or any other."""
    numeric = [c for c, k in columns if k in ("double", "integer")]
    absent = {c: f'"{c}" IS NULL' + (f' OR isnan("{c}")' if k == "double" else "") for c, k in columns}
    cols = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, '{k}' IN ('double', 'integer') AS is_num, count_if({absent[c]}) AS missing, "
        f'count(DISTINCT CAST("{c}" AS VARCHAR)) AS uniq, count("{c}") AS filled FROM t'
        for i, (c, k) in enumerate(columns)
    )
    num = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, skewness(v) AS skew "
        f'FROM (SELECT CASE WHEN {absent[c]} THEN NULL ELSE CAST("{c}" AS DOUBLE) END AS v FROM t)'
        for c in numeric
    )
    outl = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count_if(CAST(\"{c}\" AS DOUBLE) < q1 - 1.5 * (q3 - q1) OR CAST(\"{c}\" AS DOUBLE) > q3 + 1.5 * (q3 - q1)) AS outliers "
        f"FROM t, num WHERE num.\"column\" = '{c}' AND num.n >= 8 AND q3 - q1 <> 0 AND NOT ({absent[c]})"
        for c in numeric
    )
    name, compact = 'lower("column")', "regexp_replace(lower(\"column\"), '[^a-z0-9]+', '', 'g')"
    return f"""
    t AS ({source}),
    n AS (SELECT count(*) AS rows FROM t),
    c0 AS ({cols}),
    c1 AS (SELECT *, {name} AS name, {compact} AS compact, greatest(rows, 1) AS r FROM c0, n),
    cols AS (SELECT *, {_any("name", RO.TIME_TERMS)} AS is_time,
                    NOT {_any("name", RO.TIME_TERMS)} AND (name = 'id' OR ends_with(name, '_id') OR ends_with(name, ' id') OR ends_with(compact, 'id')
                      OR (is_num AND uniq > 0.95 * r AND (ends_with(compact, 'id') OR compact IN ('id', 'identifier') OR ends_with(compact, 'number')))) AS is_id,
                    is_num AND {_any("name", RO.METRIC_TERMS)} AS is_metric,
                    {_any("name", RO.DIMENSION_TERMS)} AS dim_word FROM c1),
    p0 AS (SELECT rows, {len(columns)} AS columns, {len(numeric)} AS numeric_features, (SELECT CAST(sum(missing) AS BIGINT) FROM cols) AS missing_total,
                  rows - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows FROM n),
    prof AS (SELECT *, CASE WHEN rows > 0 THEN round(missing_total * 100.0 / (rows * {len(columns)}), 1) ELSE 0 END AS missing_pct FROM p0),
    num AS ({num}),
    outl AS ({outl}),
    i0 AS (SELECT 0 AS g, 0 AS pos, 0 AS sub, 'warn' AS severity, 'missing_values' AS code, "column", CAST(missing AS DOUBLE) AS "value" FROM cols WHERE missing > 0
           UNION ALL SELECT 1, 0, 0, 'warn', 'duplicate_rows', NULL, CAST(duplicate_rows AS DOUBLE) FROM prof WHERE duplicate_rows > 0
           UNION ALL SELECT 2, position, 0, 'info', 'identifier_columns', "column", NULL FROM cols WHERE is_id
           UNION ALL SELECT 3, position, 0, 'info', 'high_cardinality', "column", CAST(uniq AS DOUBLE) FROM cols
                     WHERE NOT is_num AND (uniq > 50 OR uniq > greatest(rows * 0.8, 20))
           UNION ALL SELECT 4, position, 0, 'warn', 'potential_outliers', "column", CAST(outliers AS DOUBLE) FROM outl JOIN cols USING ("column") WHERE outliers > 0
           UNION ALL SELECT 4, position, 1, 'info', 'skewed_distribution', "column", round(skew, 2) FROM num JOIN cols USING ("column") WHERE n >= 8 AND abs(skew) >= 1.5),
    issues AS (SELECT CAST(row_number() OVER (ORDER BY g, pos, sub, "column") AS INTEGER) AS seq, severity, code, "column", "value" FROM i0),
    listed AS (SELECT min(seq) AS seq, severity, code, arg_min("column", seq) AS "column", sum("value") AS "value" FROM issues WHERE code = 'missing_values' GROUP BY severity, code
               UNION ALL SELECT * FROM issues WHERE code <> 'missing_values'),
    w AS (SELECT count(*) AS issues, count_if(severity = 'warn') AS warnings FROM listed),
    s0 AS (SELECT prof.*, CAST(w.issues AS BIGINT) AS issues, CAST(w.warnings AS BIGINT) AS warnings,
                  CAST(greatest(35, 100 - least(35, floor(missing_pct * 2)) - least(25, floor(duplicate_rows * 100.0 / greatest(rows, 1))) - least(20, w.warnings * 5)) AS INTEGER) AS score
           FROM prof, w),
    scored AS (SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' ELSE 'needs_attention' END AS status FROM s0)"""


SALES = """SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, c_mktsegment, o_totalprice, c_acctbal
           FROM orders JOIN customer ON o_custkey = c_custkey"""
SALES_COLUMNS = (
    ("o_orderkey", "integer"), ("o_orderdate", "time"), ("o_orderstatus", "text"), ("o_orderpriority", "text"),
    ("c_mktsegment", "text"), ("o_totalprice", "double"), ("c_acctbal", "double"),
)

EVENTS = """SELECT event_id, ts, user_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
            CASE WHEN event_type = 'view' THEN NULL ELSE props END AS props FROM events"""
EVENTS_COLUMNS = (("event_id", "integer"), ("ts", "time"), ("user_id", "integer"), ("event_type", "text"), ("value", "double"), ("props", "text"))

_SCORED = f"WITH {quality_ctes(SALES, SALES_COLUMNS)}"
_EVENTS = f"WITH {quality_ctes(EVENTS, EVENTS_COLUMNS)}"

ISSUES = f'{_EVENTS} SELECT seq, severity, code, "column", "value" FROM issues'
SCORE = f"{_EVENTS} SELECT score, status, issues, warnings FROM scored"

READINESS = f"""{_SCORED},
    r AS (SELECT *, greatest(0, least(100, score - CASE WHEN rows < 30 THEN 10 ELSE 0 END - CASE WHEN status = 'needs_attention' THEN 10 ELSE 0 END)) AS ready FROM scored)
    SELECT CAST(ready AS INTEGER) AS readiness_score, CASE WHEN ready >= 85 THEN 'ready' WHEN ready >= 65 THEN 'caution' ELSE 'not_ready' END AS readiness,
           score AS health_score, concat_ws(',', CASE WHEN rows < 30 THEN 'small_sample' END, CASE WHEN status = 'needs_attention' THEN 'quality_needs_attention' END) AS risk_flags
    FROM r"""

KPIS = f"""{_SCORED}
    SELECT scored.rows, score AS health_score, 'o_totalprice' AS metric, round(total, 2) AS metric_total, round(mean, 2) AS metric_mean
    FROM scored, (SELECT sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM t)"""

PROFILE = f"{_SCORED} SELECT rows, CAST(columns AS INTEGER) AS columns, CAST(numeric_features AS INTEGER) AS numeric_features, missing_total, missing_pct, duplicate_rows FROM prof"

TREND = f"""WITH t AS ({SALES})
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS total, count(*) AS rows
    FROM t WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1"""

TOTALS = f"""WITH t AS ({SALES})
    SELECT c_mktsegment, round(coalesce(sum(o_totalprice), 0), 4) AS value FROM t WHERE c_mktsegment IS NOT NULL
    GROUP BY 1 ORDER BY value DESC, c_mktsegment LIMIT 15"""

COUNTS = f"""WITH t AS ({SALES})
    SELECT c_mktsegment AS value, count(*) AS count FROM t WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count DESC, value LIMIT 10"""

HISTOGRAM = f"""WITH t AS ({SALES}), b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM t),
    x AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 10)) AS INTEGER), 9) END AS bin, lo, hi
          FROM t, b WHERE o_totalprice IS NOT NULL)
    SELECT bin, round(min(lo) + bin * (min(hi) - min(lo)) / 10, 4) AS lower,
           round(CASE WHEN bin = 9 THEN min(hi) ELSE min(lo) + (bin + 1) * (min(hi) - min(lo)) / 10 END, 4) AS upper, count(*) AS count
    FROM x GROUP BY bin"""

PAIR = f"WITH t AS ({SALES}) SELECT o_totalprice, o_orderkey FROM t"

METRIC = f"WITH t AS ({SALES}) SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM t"

BREAKDOWNS = f"""WITH t AS ({SALES}),
    long AS (SELECT 'c_mktsegment' AS dimension, c_mktsegment AS label, o_totalprice AS m FROM t
             UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_totalprice FROM t),
    g AS (SELECT dimension, label, sum(m) AS total FROM long WHERE label IS NOT NULL AND m IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, label) AS rank FROM g)
    SELECT dimension, label, round(total, 2) AS total, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""

_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 3) + 0.0 AS corr, count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM t"
    for a, b in (("o_orderkey", "o_totalprice"), ("o_orderkey", "c_acctbal"), ("o_totalprice", "c_acctbal"))
)
_STRENGTH = "CASE WHEN abs(corr) >= 0.6 THEN 'High' WHEN abs(corr) >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength"
PAIRS = f"""WITH t AS ({SALES}), c AS ({_PAIRS})
    SELECT "left", "right", corr, CAST(n AS BIGINT) AS n, {_STRENGTH} FROM c WHERE corr IS NOT NULL ORDER BY abs(corr) DESC, "left", "right" LIMIT 3"""

_SEGMENTS = """g AS (SELECT c_mktsegment AS label, sum(o_totalprice) AS total FROM t WHERE c_mktsegment IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1),
    lead AS (SELECT label, round(total / (SELECT sum(total) FROM g) * 100, 2) AS share FROM g ORDER BY total DESC, label LIMIT 1)"""

INSIGHTS = f"""{_SCORED}, {_SEGMENTS}, c AS ({_PAIRS}),
    k AS (SELECT round(sum(o_totalprice), 2) AS v, round(avg(o_totalprice), 2) AS m FROM t)
    SELECT 'profile' AS kind, 'rows' AS subject, CAST(rows AS DOUBLE) AS value, 'columns=' || columns || ' numeric=' || numeric_features AS detail FROM prof
    UNION ALL SELECT 'kpi', 'o_totalprice', v, 'mean=' || m FROM k
    UNION ALL SELECT 'segment', label, share, 'leader_share_pct' FROM lead WHERE (SELECT count(*) FROM g) >= 2
    UNION ALL SELECT 'quality', 'missing_cells', CAST(missing_total AS DOUBLE), 'duplicate_rows=' || duplicate_rows FROM prof
    UNION ALL SELECT * FROM (SELECT 'relationship', "left" || ' ~ ' || "right", corr, {_STRENGTH} FROM c WHERE abs(corr) >= 0.3 ORDER BY abs(corr) DESC, "left", "right" LIMIT 1)
    UNION ALL SELECT 'anomaly', "column", CAST(outliers AS DOUBLE), 'iqr_outliers' FROM outl WHERE "column" = 'o_totalprice' AND outliers > 0"""

TRIGGERS = f"""{_SCORED}, {_SEGMENTS},
    d AS (SELECT o_orderdate AS day, sum(o_totalprice) AS total FROM t WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1),
    e AS (SELECT count(*) AS periods, arg_min(total, day) AS fv, arg_max(total, day) AS lv FROM d),
    ch AS (SELECT periods, round(CASE WHEN fv <> 0 THEN (lv - fv) / abs(fv) * 100 ELSE 0 END, 2) AS pct FROM e)
    SELECT 'concentration' AS trigger, CASE WHEN share >= 40 THEN 'high' ELSE 'medium' END AS level, label AS subject, CAST(share AS DOUBLE) AS value
    FROM lead WHERE (SELECT count(*) FROM g) >= 2
    UNION ALL SELECT 'trend', CASE WHEN pct < -10 THEN 'high' ELSE 'medium' END, 'o_totalprice', pct FROM ch WHERE periods >= 3 AND abs(pct) >= 5
    UNION ALL SELECT 'quality', 'high', code, "value" FROM (SELECT * FROM listed ORDER BY seq LIMIT 2) WHERE severity = 'warn'
    UNION ALL SELECT 'model_ready', 'medium', 'o_totalprice', CAST(rows AS DOUBLE) FROM prof WHERE rows >= 50 AND numeric_features >= 2"""


def samples_cte(columns: Sequence[tuple[str, str]], k: int = 3) -> str:
    """``smp``: the ``k`` smallest different values of each column as text."""
    long = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS \"column\", CAST(\"{c}\" AS VARCHAR) AS v FROM t WHERE \"{c}\" IS NOT NULL" for c, _ in columns)
    return f"""sm AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v) AS r FROM ({long})),
    smp AS (SELECT "column", string_agg(v, '|' ORDER BY v) AS samples FROM sm WHERE r <= {k} GROUP BY 1)"""


def semantic_schema_sql(source: str, columns: Sequence[tuple[str, str]], dtypes: dict[str, str]) -> str:
    kinds = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in dtypes.items())
    times = ", ".join(f"'{c}'" for c, k in columns if k == "time") or "''"
    return f"""WITH {quality_ctes(source, columns)}, {samples_cte(columns)},
    f AS (SELECT *, CASE "column" {kinds} END AS dtype, round(uniq / r, 3) AS ratio FROM cols)
    SELECT f."column", dtype, ratio AS unique_ratio, round((rows - filled) * 100.0 / r, 1) AS null_pct, coalesce(samples, '') AS samples,
           CASE WHEN f."column" IN ({times}) THEN 'temporal'
                WHEN ends_with(compact, 'id') OR (NOT is_num AND ratio >= 0.90) THEN 'identifier'
                WHEN NOT is_num AND ratio < 0.25 THEN 'dimension'
                WHEN is_num AND ratio >= 0.40 THEN 'measure' WHEN is_num THEN 'measure,dimension' ELSE 'unknown' END AS candidate_roles
    FROM f LEFT JOIN smp ON f."column" = smp."column\""""


_ROLE = """CASE WHEN is_id THEN 'identifier' WHEN is_time THEN 'time' WHEN is_metric THEN 'metric'
                WHEN NOT is_num AND (dim_word OR uniq BETWEEN 2 AND 50) THEN 'dimension' ELSE 'attribute' END"""


def types_cte(source: str, columns: Sequence[str]) -> str:
    """``types``: column, position and contract type of each column of ``source``."""
    tokens = ", ".join(f"'{x}'" for x in CO.BOOL_TOKENS)
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, any_value(typeof({c})) AS dt, count({c}) AS n, count_if(lower(trim(CAST({c} AS VARCHAR))) IN ({tokens})) AS b, "
        f"count(TRY_CAST(CAST({c} AS VARCHAR) AS TIMESTAMP)) AS d, count(TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE)) AS x FROM {source}"
        for i, c in enumerate(columns)
    )
    return f"""types AS (SELECT "column", position, CASE WHEN n = 0 THEN 'string' WHEN dt = 'BOOLEAN' THEN 'boolean' WHEN dt IN ('INTEGER', 'BIGINT') THEN 'integer'
                WHEN dt IN ('FLOAT', 'DOUBLE') THEN 'number' WHEN dt IN ('DATE', 'TIMESTAMP') THEN 'date' WHEN b >= 0.9 * n THEN 'boolean'
                WHEN d >= 0.8 * n THEN 'date' WHEN x >= 0.9 * n THEN 'number' ELSE 'string' END AS type FROM ({long}))"""


_NAMES = [c for c, _ in EVENTS_COLUMNS]
TYPES = f'WITH {types_cte("events", _NAMES)} SELECT "column", position, type FROM types'


def contract_sql(source: str, columns: Sequence[tuple[str, str]]) -> str:
    bounds = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", "
        + ", ".join(
            f"strftime({e}({c}), '%Y-%m-%d') AS {e}_" if k == "time" else f"CASE WHEN {e}({c}) = floor({e}({c})) THEN CAST(CAST({e}({c}) AS BIGINT) AS VARCHAR) ELSE CAST({e}({c}) AS VARCHAR) END AS {e}_"
            for e in ("min", "max")
        )
        + " FROM t"
        for c, k in columns
        if k != "text"
    )
    allowed = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", string_agg(v, '|' ORDER BY v) AS allowed FROM (SELECT DISTINCT {c} AS v FROM t WHERE {c} IS NOT NULL) HAVING count(*) BETWEEN 1 AND {CO.MAX_ALLOWED}"
        for c, k in columns
        if k == "text"
    )
    return f"""WITH {quality_ctes(source, columns)}, {types_cte("t", [c for c, _ in columns])},
    bounds AS ({bounds}), allowed AS ({allowed})
    SELECT c."column", types.position, type, {_ROLE} AS role, missing = 0 AS required, missing > 0 AS nullable,
           round((rows - missing) * 100.0 / r, 1) AS completeness_pct, uniq AS unique_count, min_ AS min, max_ AS max, allowed AS allowed_values,
           concat_ws('|', CASE WHEN type IN ('integer', 'number') AND min_ IS NOT NULL THEN 'must_parse_as_number' END,
                     CASE WHEN type = 'date' AND min_ IS NOT NULL THEN 'must_parse_as_date' END,
                     CASE WHEN allowed IS NOT NULL THEN 'prefer_known_category' END, CASE WHEN missing = 0 THEN 'required' END) AS rules
    FROM cols c JOIN types ON types."column" = c."column" LEFT JOIN bounds ON bounds."column" = c."column" LEFT JOIN allowed ON allowed."column" = c."column\""""


CONTRACT = contract_sql("SELECT * FROM events", EVENTS_COLUMNS)


def dictionary_sql(source: str, columns: Sequence[tuple[str, str]], dtypes: dict[str, str]) -> str:
    kinds = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in dtypes.items())
    return f"""WITH {quality_ctes(source, columns)}, {samples_cte(columns)}
    SELECT c."column", CASE c."column" {kinds} END AS dtype, {_ROLE} AS role, round((rows - missing) * 100.0 / r, 1) AS completeness_pct, uniq AS unique_count,
           coalesce(samples, '') AS sample_values,
           concat_ws('|', CASE WHEN missing > 0 THEN 'missing' END, CASE WHEN is_id THEN 'identifier' END,
                     CASE WHEN uniq > 50 OR uniq > greatest(rows * 0.8, 20) THEN 'many_values' END, CASE WHEN num.n >= 8 AND abs(skew) >= 1.5 THEN 'skewed' END) AS warnings
    FROM cols c LEFT JOIN smp ON smp."column" = c."column" LEFT JOIN num ON num."column" = c."column\""""


def cleaning_sql(source: str, columns: Sequence[tuple[str, str]], cleaned: str, kept: Sequence[tuple[str, str]]) -> str:
    """``cleaned``: SQL of the table after the default actions."""
    padded = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\" FROM t WHERE {c} <> regexp_replace({c}, '^\\s+|\\s+$', '', 'g')" for i, (c, k) in enumerate(columns) if k == "text")
    names = "string_agg(\"column\", '|' ORDER BY position)"
    return f"""WITH {quality_ctes(source, columns)},
    padded AS (SELECT DISTINCT * FROM ({padded})),
    steps AS (
      SELECT 1 AS o, 'drop_empty_columns' AS action, {names} AS columns, true AS "default" FROM cols WHERE filled = 0
      UNION ALL SELECT 2, 'remove_duplicate_rows', '', true FROM prof WHERE duplicate_rows > 0
      UNION ALL SELECT 3, 'trim_string_whitespace', {names}, true FROM padded
      UNION ALL SELECT 4, 'fill_numeric_median', {names}, true FROM cols WHERE is_num AND missing > 0 AND filled > 0
      UNION ALL SELECT 5, 'fill_categorical_mode', {names}, false FROM cols WHERE NOT is_num AND missing > 0 AND filled > 0)
    SELECT *, (WITH {quality_ctes(cleaned, kept)} SELECT score FROM scored) AS estimated_score_after FROM steps WHERE columns IS NOT NULL"""
