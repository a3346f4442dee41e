"""Result comparison, contradictions, join reports, contracts."""

import pytest
from pyspark.sql import functions as F

from attest.operators import contract, joins, profile, reconcile

INF, NAN = float("inf"), float("nan")


def compare(spark, pairs, kind="double"):
    rows = [(i, a) for i, (a, _) in enumerate(pairs)], [(i, b) for i, (_, b) in enumerate(pairs)]
    sides = [spark.createDataFrame(r, f"k int, v {kind}") for r in rows]
    return [r["status"] == "match" for r in reconcile.compare_results(*sides, ["k"], ["v"]).orderBy("k").collect()]


def test_number_tolerance(spark):
    pairs = [(1.0, 1.0 + 1e-10), (0.0, 1e-9), (0.0, 2e-9), (1e6, 1e6 + 0.5), (1e6, 1e6 + 2), (NAN, NAN), (INF, INF),
             (INF, -INF), (None, None), (None, 0.0), (NAN, 1.0), (INF, 1e308)]
    assert compare(spark, pairs) == [True, True, False, True, False, True, True, False, True, False, False, False]


def test_integers_are_exact_and_texts_trimmed(spark):
    assert compare(spark, [(10**12, 10**12 + 1), (5, 5)], "bigint") == [False, True]
    pairs = [("1.0", "1"), (" a", "a "), ("a", "A"), ("1e3", "1000.0001"), ("1x", "1"), (None, "")]
    assert compare(spark, pairs, "string") == [True, True, False, True, False, False]


def test_keys_on_one_side_and_repeated(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (None, 4.0)], "k int, v double")
    right = spark.createDataFrame([(1, 1.0), (1, 1.0), (3, 9.0), (4, 4.0), (None, 4.0)], "k int, v double")
    compared = reconcile.compare_results(left, right, ["k"], ["v"])
    assert {r["k"]: r["status"] for r in compared.collect()} == {
        1: "repeated_key", 2: "only_left", 3: "differs", 4: "only_right", None: "match"}
    total = reconcile.summary(compared).collect()[0]
    assert (total["key_count"], total["match"], total["agrees"]) == (5, 1, False)
    assert reconcile.mismatches(compared).filter("first_difference = 'v'").count() == 1


def test_ordered(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "o int, v string")
    right = spark.createDataFrame([(10, "a"), (20, "x")], "o int, v string")
    rows = reconcile.compare_ordered(left, right, ["o"], ["o"], ["v"]).orderBy("position").collect()
    assert [r["status"] for r in rows] == ["match", "differs", "only_left"]


def test_rerun_of_doubles_agrees(spark):
    df = spark.range(50000).select((F.col("id") % 3).alias("k"), (F.rand(3) * 1e6).alias("v"), F.lit("x").alias("other"))
    again = reconcile.rerun(lambda d: d.groupBy("k").agg(F.sum("v").alias("s")), df, ["k", "v"], ["k"], ["s"])
    assert reconcile.summary(again).collect()[0]["agrees"]


def test_contradiction_is_strictly_more_than_five_percent(spark):
    rows = [("a", "revenue", "USD", 100.0), ("b", "revenue", "usd", 95.0), ("c", "revenue", "USD", 94.9),
            ("d", "revenue", "INR", 1.0), ("e", "revenue", "USD", -3.0)]
    totals = spark.createDataFrame(rows, "table_name string, metric string, currency string, value double")
    found = reconcile.contradictions(totals).collect()
    assert [(r["table_a"], r["table_b"], r["difference_pct"]) for r in found] == [("a", "c", 5.1)]


def test_revenue_column(spark):
    df = spark.createDataFrame([], "x int, Total_Sales double")
    assert reconcile.revenue_column(df) == "Total_Sales"
    assert reconcile.revenue_column(spark.createDataFrame([], "revenue string")) is None


def test_sanity(spark):
    df = spark.createDataFrame([(1.0, 5), (-1.0, 5), (0.0, 0), (NAN, 5), (None, 5), (INF, 5)], "value double, rows_used int")
    flags = [tuple(r[2:]) for r in reconcile.sanity_flags(df).collect()]
    assert flags == [(False, False, False, False), (False, False, True, False), (False, False, True, True),
                     (True, False, False, False), (False, True, False, False), (True, False, False, False)]


def test_join_report(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 5.0), (2, 1.0), (None, 7.0), (9, 2.0)], "k int, v double")
    right = spark.createDataFrame([(1,), (1,), (2,), (None,), (4,)], "k int")
    row = joins.join_report(left, right, "k", metric="v").collect()[0].asDict()
    assert row["joined_rows"] == left.join(right, "k").count() == 5
    assert (row["matched_rows"], row["match_pct"], row["null_key_rows"], row["right_only_keys"]) == (3, 60.0, 1, 1)
    assert (row["max_right_copies"], row["fans_out"], row["total_before"], row["total_after"]) == (2, True, 25.0, 31.0)
    assert joins.unmatched_rows(left, right, "k").count() == 2
    empty = joins.join_report(left.limit(0), right.limit(0), "k").collect()[0]
    assert (empty["left_rows"], empty["joined_rows"], empty["match_pct"]) == (0, 0, 0.0)


def test_contract(spark):
    df = spark.createDataFrame([], "A int, b string, c double, extra date")
    promised = contract.TableContract("t", {"a": "integer", "b": "datetime", "c": "float", "d": "string"})
    rows = contract.contract_violations(promised, profile.column_profile(df, "t")).collect()
    assert {(r["column_name"], r["problem"]) for r in rows} == {
        ("b", "wrong type"), ("d", "missing column"), ("extra", "extra column")}
    with pytest.raises(ValueError):
        contract.TableContract("t", {"a": "number"})


def test_metric_identity(spark):
    df = spark.createDataFrame([(3, 0.1, 0.3), (2, 19.99, 39.98), (2, 5.0, 10.01), (None, 5.0, 1.0)],
                               "quantity int, unit_price double, revenue double")
    row = contract.metric_identity(df, "revenue", "quantity", "unit_price").collect()[0]
    assert (row["checked_rows"], row["broken_rows"], row["max_difference"]) == (3, 1, 0.01)
