"""Physical-plan properties the operators rely on (read from ``explain``)."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from tabulark.functions.ordering import exact_quantiles, top_k_per_group
from tabulark.operators import aggregate as A
from tabulark.operators import filters as FL
from tabulark.operators import joins as J

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_filters_and_projection_reach_the_scan(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_linestatus")
    p = plan(FL.apply_filters(li, [("l_linestatus", "==", "O"), ("l_quantity", ">=", 10)]))
    assert "EqualTo(l_linestatus,O)" in p and "GreaterThanOrEqual(l_quantity,10.0)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_linestatus:string>" in p


def test_grouped_aggregate_is_partial_then_final(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    p = plan(A.group_agg(o, "o_orderstatus", "sum", "o_totalprice"))
    assert "partial_sum" in p


def test_top_k_limits_before_the_shuffle(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    top = top_k_per_group(li, ["l_returnflag"], [F.col("l_extendedprice").desc(), F.col("l_orderkey")], 3)
    p = plan(top, "simple")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_small_side_join_is_broadcast_at_runtime(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    c = spark.read.parquet(f"{SF}/customer.parquet")
    j = J.join_tables(o, c, "o_custkey", "c_custkey").groupBy("c_mktsegment").count()
    j.collect()
    assert "BroadcastHashJoin" in plan(j)


def test_exact_quantiles_avoid_single_buffer_percentile(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = plan(exact_quantiles(li, ["l_extendedprice"], [0.5], by=["l_returnflag"]), "simple").lower()
    assert "percentile" not in p and "collect_list" not in p
