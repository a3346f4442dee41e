"""Every registered query against its SQL in DuckDB."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from attest.plans import all_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()
SQL = {name: sql for name, sql in entry_points.oracle_sql().items() if name in QUERIES}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    if name in SQL:
        assert differences(df, con, SQL[name]) == []


def test_queries_without_sql():
    assert sorted(set(QUERIES) - set(SQL)) == ["column_profile_screen", "key_overlap_sketch"]


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["p_type", "value"]


def test_screen_is_close_to_exact(spark):
    screen = QUERIES["column_profile_screen"](spark, FOLDER).filter("table_name = 'orders'").collect()
    exact = {r["column_name"]: r["distinct_count"] for r in QUERIES["column_profile_orders"](spark, FOLDER).collect()}
    for row in screen:
        assert abs(row["distinct_count"] - exact[row["column_name"]]) <= 0.1 * exact[row["column_name"]]


def test_sketch_is_close_to_exact(spark):
    def by_pair(name):
        return {(r["table_a"], r["table_b"], r["join_key"]): r for r in QUERIES[name](spark, FOLDER).collect()}

    exact, sketch = by_pair("key_overlap"), by_pair("key_overlap_sketch")
    assert exact.keys() == sketch.keys()
    for pair, row in exact.items():
        assert abs(sketch[pair]["overlap_count"] - row["overlap_count"]) <= 0.05 * row["overlap_count"] + 1
        assert sketch[pair]["is_recommended"] == row["is_recommended"]
