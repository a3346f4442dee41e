"""Column names with dots and other signs, in every operator that takes names."""

import datetime

import pytest

from attest.functions.dates import TimeRange
from attest.operators import coverage, duplicates, gates, money_units, overlap, profile, reconcile
from attest.operators.filters import Condition
from attest.operators.metric import Join, MetricQuery, MonthOf, run
from attest.sources.files import undecodable_rows

DAY = datetime.date


@pytest.fixture(scope="module")
def odd(spark):
    rows = [("a.1", 10.0, DAY(2025, 1, 5), "$5", 1), ("a.1", 10.0, DAY(2025, 1, 5), "$5", 1), ("b", 2.5, DAY(2025, 3, 1), "2 kg", 2)]
    return spark.createDataFrame(rows, "`item.key` string, `net.price` double, `sold at.day` date, `list.price ``x``` string, `n.o` int")


@pytest.fixture(scope="module")
def tables(spark, odd):
    return {"odd": odd, "items": spark.createDataFrame([("a.1", "T"), ("b", "U")], "`item.key` string, `kind.of` string")}


def test_profiles(odd):
    assert {r["column_name"]: r["distinct_count"] for r in profile.column_profile(odd, "t").collect()}["net.price"] == 2
    assert profile.column_profile(odd, "t", distinct="exact").count() == 5
    assert profile.missing_profile(odd, "t").count() == 5
    assert profile.id_candidates(odd, "t").count() == 5
    assert profile.repeated_keys(odd, ["item.key"]).collect()[0]["row_count"] == 2
    assert [r["quantile_value"] for r in profile.column_quantiles(odd, "t", ["net.price"], (0.5,)).collect()] == [10.0]
    assert profile.table_profiles({"t": odd}).collect()[0]["missing_months"] == 1
    assert [r["column_name"] for r in coverage.date_columns(coverage.date_profile(odd, "t")).collect()] == ["sold at.day"]
    assert [r["month"] for r in coverage.missing_months(odd, "sold at.day").collect()] == ["2025-02"]
    assert coverage.ambiguous_dates(odd, "list.price `x`").collect()[0]["value_count"] == 3
    assert money_units.currency_profile(odd, "t").count() > 0 and money_units.unit_profile(odd, "t").count() > 0
    assert {r["row_count"] for r in undecodable_rows(odd).collect()} == {0}


def test_duplicates(odd):
    assert duplicates.duplicate_profile(odd, "t").collect()[0]["duplicate_count"] == 1
    assert duplicates.duplicate_rows(odd).collect()[0]["copies"] == 2
    assert duplicates.duplicate_samples(odd).count() == 1
    assert duplicates.duplicate_impact(odd, "net.price").collect()[0]["total_clean"] == 12.5


def test_metric_queries(tables):
    def rows(**more):
        return [tuple(r) for r in run(MetricQuery(more.pop("tables", ("odd",)), "net.price", **more), tables).collect()]

    assert rows(group_by=("item.key",)) == [("a.1", 20.0), ("b", 2.5)]
    assert rows(group_by=("item.key",), dedup=True) == [("a.1", 10.0), ("b", 2.5)]
    assert rows(group_by=(MonthOf("sold at.day"),)) == [("2025-01", 20.0), ("2025-03", 2.5)]
    assert rows(filters=(Condition("item.key", "=", "B"),), time=TimeRange(year=2025), date_column="sold at.day")[0][0] == 2.5
    assert rows(tables=("odd", "items"), join=Join("item.key"), group_by=("kind.of",)) == [("T", 20.0), ("U", 2.5)]
    assert rows(aggregation="median")[0][0] == 10.0
    assert rows(aggregation="median", group_by=("item.key",)) == [("a.1", 10.0), ("b", 2.5)]


def test_across_tables(spark, tables):
    assert [r["join_key"] for r in overlap.key_overlap(tables).collect()] == ["item.key"]
    totals = reconcile.metric_totals({"a": tables["odd"], "b": tables["odd"].limit(1)}, {"a": "net.price", "b": "net.price"})
    assert reconcile.contradictions(totals).collect()[0]["column_a"] == "net.price"
    requests = spark.createDataFrame([(1, ["odd"], "net.price")], "request_id int, tables array<string>, metric string")
    assert gates.judge(requests, gates.table_facts(tables)).collect()[0]["rule"] is None
