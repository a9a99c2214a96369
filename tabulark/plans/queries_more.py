"""Registered analyses: insight bundles, models, documents, sources/sinks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import docs as D
from ..operators import insight as I
from ..operators import ml as M
from ..session import checkpoint_dir
from ..sources import io as S
from . import quality_sql as QS
from .catalog import load, register
from .queries_stats import M12_SQL

# ---- insight bundles --------------------------------------------------------------


def sales_frame(spark, sf):
    """Orders joined to customers: a table with time, segment and metric columns."""
    o = load(spark, sf, "orders")
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "c_mktsegment", "o_totalprice", "c_acctbal"
    )


@register("q20_readiness", QS.READINESS)
def q20(spark, sf):
    return I.readiness(sales_frame(spark, sf)).withColumn("risk_flags", F.array_join("risk_flags", ","))


@register("q21_kpis", QS.KPIS)
def q21(spark, sf):
    return I.kpis(sales_frame(spark, sf), metric="o_totalprice")


def _dashboard(spark, sf):
    return I.dashboard_series(sales_frame(spark, sf), metric="o_totalprice", dim="c_mktsegment", date="o_orderdate")


@register("q22_dashboard_trend", QS.TREND)
def q22_trend(spark, sf):
    return _dashboard(spark, sf)["trend"]


@register("q22_dashboard_segments", QS.TOTALS)
def q22(spark, sf):
    return _dashboard(spark, sf)["segment_totals"]


@register("q22_dashboard_counts", QS.COUNTS)
def q22_counts(spark, sf):
    return _dashboard(spark, sf)["segment_counts"]


@register("q22_dashboard_histogram", QS.HISTOGRAM)
def q22_histogram(spark, sf):
    h = _dashboard(spark, sf)["histogram"]
    return h.select("bin", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "count")


@register("q22_dashboard_pair", QS.PAIR)
def q22_pair(spark, sf):
    return _dashboard(spark, sf)["metric_pair"]


@register("q23_insights", QS.INSIGHTS)
def q23(spark, sf):
    return I.insights(sales_frame(spark, sf), metric="o_totalprice", dim="c_mktsegment")


@register("q24_investigate")
def q24(spark, sf):
    return I.investigate(sales_frame(spark, sf), metric="o_totalprice", dim="c_mktsegment", date="o_orderdate")


def _story(spark, sf):
    return I.story_facts(sales_frame(spark, sf), metric="o_totalprice", dims=["c_mktsegment", "o_orderpriority"])


@register("q25_story_profile", QS.PROFILE)
def q25_profile(spark, sf):
    return _story(spark, sf)["profile"]


@register("q25_story_metric", QS.METRIC)
def q25_metric(spark, sf):
    return _story(spark, sf)["metric"]


@register("q25_story_breakdowns", QS.BREAKDOWNS)
def q25(spark, sf):
    return _story(spark, sf)["breakdowns"]


@register("q25_story_pairs", QS.PAIRS)
def q25_pairs(spark, sf):
    return _story(spark, sf)["pairs"]


@register("q26_decision_triggers", QS.TRIGGERS)
def q26(spark, sf):
    return I.decision_triggers(sales_frame(spark, sf), metric="o_totalprice", dim="c_mktsegment", date="o_orderdate")


# ---- models -----------------------------------------------------------------------

#: as many as the models are meant to have
TREES = 200


def part_model(spark, sf):
    """Regression forest: part retail price from size and type (brand has more
    than 15 levels, so it is left out by the feature rules)."""
    part = load(spark, sf, "part").drop("p_name")
    return M.train(part, "p_retailprice", trees=TREES)


def labels_frame(spark, sf):
    """Documents joined to their quality labels, with numeric text features."""
    d = load(spark, sf, "documents")
    lab = load(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        "lang", "source", "n_chars", F.size(F.split("text", r"\s+")).alias("n_words"), F.col("quality").cast("string").alias("quality")
    )


@register("m1_feature_columns")
def m1(spark, sf):
    part = load(spark, sf, "part").drop("p_name")
    num, cat = M.select_features(part, "p_retailprice")
    rows = [(c, "numeric") for c in num] + [(c, "categorical") for c in cat]
    # one row per chosen feature column: metadata of the table
    return spark.createDataFrame(rows, "feature string, kind string")


@register("m2_m3_classifier_metrics")
def m2_cls(spark, sf):
    model, test = M.train(labels_frame(spark, sf), "quality", trees=TREES)
    return M.evaluate(model, test)


@register("m3_regressor_metrics")
def m3_reg(spark, sf):
    model, test = part_model(spark, sf)
    return M.evaluate(model, test)


@register("m4_importances")
def m4(spark, sf):
    model, _ = part_model(spark, sf)
    return M.importances(model)


@register("m5_permutation_importance")
def m5(spark, sf):
    model, test = part_model(spark, sf)
    return M.permutation_importance(model, test, repeats=5)


@register("m6_partial_dependence")
def m6(spark, sf):
    model, _ = part_model(spark, sf)
    return M.leading_dependence(model, load(spark, sf, "part"), k=2, grid=20)


@register("m7_batch_scoring")
def m7(spark, sf):
    model, _ = M.train(labels_frame(spark, sf), "quality", trees=TREES)
    return M.score(model, labels_frame(spark, sf)).select("lang", "source", "n_chars", "quality", "predicted", "confidence")


@register("m8_prediction_interval")
def m8(spark, sf):
    model, test = part_model(spark, sf)
    return M.score_with_interval(model, test)


@register("m9_scenario")
def m9(spark, sf):
    model, _ = part_model(spark, sf)
    part = load(spark, sf, "part")
    return M.scenario(model, part, [("p_size", "percent", 10), ("p_type", "set", "PROMO")])


_M10_SQL = """
SELECT 'p_size' AS feature, 'numeric' AS kind, CAST(median(p_size) AS VARCHAR) AS "default", CAST(NULL AS VARCHAR) AS options FROM part
UNION ALL
SELECT 'p_type', 'categorical',
       (SELECT p_type FROM part WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1),
       (SELECT array_to_string(list_sort(list(DISTINCT p_type)), ',') FROM part WHERE p_type IS NOT NULL)
"""


@register("m10_feature_defaults", _M10_SQL)
def m10(spark, sf):
    part = load(spark, sf, "part")
    d = M.feature_defaults(part, ["p_size", "p_type"])
    return d.select("feature", "kind", "default", F.array_join("options", ",").alias("options"))


@register(
    "m11_model_task",
    """
    WITH v AS (SELECT CAST(quality AS VARCHAR) AS value, count(*) AS c FROM labels WHERE quality IS NOT NULL GROUP BY 1)
    SELECT 'quality' AS target, 'classification' AS task, count(*) AS classes,
           CASE WHEN count(*) = 2 THEN round(min(c) * 100.0 / sum(c), 1) END AS minority_pct,
           coalesce(CASE WHEN count(*) = 2 THEN round(min(c) * 100.0 / sum(c), 1) END < 40, false) AS imbalanced
    FROM v
    """,
)
def m11(spark, sf):
    return M.model_task(load(spark, sf, "labels"), "quality")


@register(
    "m12_forecast_metrics",
    f"""
    WITH fc AS ({M12_SQL}),
    e AS (SELECT arg_max(value, period) FILTER (kind = 'historical') AS last_historical_value, arg_max(value, period) FILTER (kind = 'forecast') AS projected_final_value FROM fc),
    g AS (SELECT *, round((projected_final_value - last_historical_value) / greatest(1e-5, abs(last_historical_value)) * 100, 1) AS growth_rate_pct FROM e)
    SELECT *, CASE WHEN growth_rate_pct > 2 THEN 'upward' WHEN growth_rate_pct < -2 THEN 'downward' ELSE 'flat' END AS trend_direction FROM g
    """,
)
def m12m(spark, sf):
    from ..operators import forecast as FC

    return FC.forecast_metrics(FC.forecast_linear(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", periods=12))


# ---- documents --------------------------------------------------------------------

_WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_D1_SQL = f"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, t, unnest(generate_series(0, length(t) - 1, 520)) AS start FROM t WHERE length(t) > 0),
c AS (SELECT doc_id, CAST(start / 520 AS INTEGER) AS chunk_idx, start, substring(t, start + 1, 600) AS text FROM s)
SELECT doc_id, chunk_idx, CAST(start AS INTEGER) AS start, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM c
WHERE length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) > 40
"""


@register("d1_chunk_documents", _D1_SQL)
def d1(spark, sf):
    ch = D.chunk(load(spark, sf, "documents"))
    return ch.select("doc_id", "chunk_idx", "start", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("d2_embed_hash")
def d2(spark, sf):
    ch = D.chunk(load(spark, sf, "documents"))
    return D.embed_hash(ch)


@register("d3_search_benchmark")
def d3(spark, sf):
    ch = D.chunk(load(spark, sf, "documents"))
    cv = D.embed_arrays(ch)
    qv = D.embed_arrays(load(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), id_cols=("query_id",))
    return D.search(cv, qv, k=4)


@register(
    "d4_doc_summary",
    "WITH c AS (" + _D1_SQL + ") SELECT doc_id, count(*) AS chunks FROM c GROUP BY doc_id",
)
def d4(spark, sf):
    return D.doc_summary(D.chunk(load(spark, sf, "documents")))


# ---- sources and sinks ------------------------------------------------------------


def _scratch(spark, tag: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


@register(
    "s1_csv_roundtrip",
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def s1(spark, sf):
    """S7/S8 write then S1 read: the customer table through CSV text and back
    with pandas-style type inference."""
    path = _scratch(spark, "s1")
    S.write_csv(load(spark, sf, "customer"), path)
    return S.read_csv(spark, path)


@register(
    "s2_delimited_roundtrip",
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def s2(spark, sf):
    """Semicolon-separated text; the separator is sniffed."""
    path = _scratch(spark, "s2")
    load(spark, sf, "customer").write.option("header", True).option("sep", ";").csv(path)
    return S.read_delimited(spark, path)


def _as_array(batches):
    """The rows of a partition as the lines of one JSON array."""
    import pyarrow as pa

    mark = "["
    for b in batches:
        rows = b.column("value").to_pylist()
        if rows:
            lines = [mark + rows[0], *("," + r for r in rows[1:])]
            mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"], pa.string())], ["value"])


@register("s4_json_array", "SELECT event_id, event_type, value, props AS \"in.props\" FROM events")
def s4(spark, sf):
    path = _scratch(spark, "s4")
    ev = load(spark, sf, "events").select("event_id", "event_type", "value", F.struct("props").alias("in"))
    ev.select(F.to_json(F.struct(*ev.columns)).alias("value")).mapInArrow(_as_array, "value string").write.text(path)
    return S.read_json(spark, path).select("event_id", "event_type", "value", "`in.props`")


@register(
    "s5_jsonl_roundtrip",
    "SELECT event_id, event_type, value FROM events",
)
def s5(spark, sf):
    path = _scratch(spark, "s5")
    load(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return S.read_jsonl(spark, path).select("event_id", "event_type", "value")


@register(
    "s6_flatten_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events",
)
def s6(spark, sf):
    ev = load(spark, sf, "events")
    nested = ev.select("event_id", F.from_json("props", "k bigint").alias("props"))
    return S.flatten(nested)


@register("s7_parquet_roundtrip", "SELECT * FROM region")
def s7(spark, sf):
    path = _scratch(spark, "s7")
    S.write_dataset(load(spark, sf, "region"), path)
    return S.read_parquet(spark, path)


@register(
    "s9_page",
    """
    WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_number FROM orders),
    f AS (SELECT * FROM n WHERE contains(lower(CAST(o_orderkey AS VARCHAR)), 'urgent') OR contains(lower(CAST(o_custkey AS VARCHAR)), 'urgent')
          OR contains(lower(o_orderstatus), 'urgent') OR contains(lower(CAST(o_totalprice AS VARCHAR)), 'urgent')
          OR contains(lower(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')), 'urgent') OR contains(lower(o_orderpriority), 'urgent')),
    s AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, row_number) AS pos FROM f)
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, row_number FROM s
    WHERE pos > 100 AND pos <= 150
    """,
)
def s9(spark, sf):
    return _urgent_page(spark, sf)[0]


def _urgent_page(spark, sf):
    return S.page(load(spark, sf, "orders"), ["o_orderkey"], page=3, page_size=50, search="URGENT", sort_col="o_totalprice", sort_dir="desc")


@register(
    "s9_page_info",
    """
    SELECT count(*) AS filtered_rows, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages, 3 AS page FROM orders
    WHERE contains(lower(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority)), 'urgent')
    """,
)
def s9_info(spark, sf):
    return _urgent_page(spark, sf)[1]
