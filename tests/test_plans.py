"""Shapes of plans: what is pushed down, broadcast, folded, and what must not appear."""

import os

import pytest
from pyspark.sql import functions as F

from attest.functions.dates import TimeRange
from attest.operators.filters import Condition
from attest.operators.metric import Join, MetricQuery, run
from attest.operators.overlap import key_overlap
from attest.plans.cross_table import keyed
from attest.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def t(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return Tables(spark, FOLDER)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(t):
    query = MetricQuery(("orders",), "o_totalprice", filters=(Condition("o_totalprice", ">", 100.0),),
                        time=TimeRange(year=1997), date_column="o_orderdate", group_by=("o_orderpriority",))
    text = plan(run(query, t.named("orders")))
    assert "GreaterThan(o_totalprice,100.0)" in text and "GreaterThanOrEqual(o_orderdate,1997-01-01" in text
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text


def test_small_side_is_broadcast_and_top_is_taken(t):
    query = MetricQuery(("lineitem", "part"), "l_extendedprice", group_by=("p_type",),
                        join=Join("l_partkey", "p_partkey"), limit=3)
    text = plan(run(query, t.named("lineitem", "part")))
    assert "BroadcastHashJoin" in text and "TakeOrderedAndProject" in text and "SortMergeJoin" not in text


def test_large_side_is_joined_after_folding(spark, t):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        query = MetricQuery(("lineitem", "orders"), "l_extendedprice", group_by=("o_orderpriority",),
                            join=Join("l_orderkey", "o_orderkey"), scale=2)
        text = plan(run(query, t.named("lineitem", "orders")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = text[text.index("SortMergeJoin"):]
    # the fold per key and the join share one exchange of the lines
    assert left.count("hashpartitioning(l_orderkey") == 1 and "partial_sum" in left


def test_pairs_are_never_formed_from_values(t):
    text = plan(key_overlap(keyed(t)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_row_count_reads_no_column(t):
    text = plan(t.orders.agg(F.count("*")))
    assert "ReadSchema: struct<>" in text


def test_copies_and_totals_are_folded_together(t):
    query = MetricQuery(("orders",), "o_totalprice", dedup=True, filters=(Condition("o_totalprice", ">", 10),))
    text = plan(run(query, t.named("orders")))
    # the rows once, and a count that reads no column
    assert text.count("FileScan parquet") == 2 and text.count("ReadSchema: struct<>") == 1
    assert text.count("Exchange hashpartitioning") == 1
