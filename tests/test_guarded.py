"""From gate to ledger, and profiles of a whole collection."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.dates import TimeRange
from attest.operators import gates, ledger
from attest.operators.collection import profile_collection
from attest.operators.filters import Condition
from attest.operators.guarded import answer, ledger_record
from attest.operators.metric import Join, MetricQuery
from attest.session import checkpointed


@pytest.fixture(scope="module")
def tables(spark):
    sales = spark.createDataFrame(
        [(1, "2025-01-05", "p1", 10.0), (2, "2025-02-20", "p2", 4.5), (3, "2025-04-21", "p1", 15.0)],
        "order_id int, day string, product_id string, revenue double")
    return {"sales": sales, "copies": sales.unionByName(sales.limit(1)),
            "products": spark.createDataFrame([("p1", "Tools"), ("p2", "Toys")], "product_id string, category string")}


@pytest.fixture(scope="module")
def facts(tables):
    return gates.table_facts(tables)


def verdict(given):
    return given.verdict.collect()[0].asDict()


def test_answers_and_refusals(tables, facts):
    total = answer(MetricQuery(("sales",), "revenue"), tables, facts)
    assert (verdict(total)["verdict"], verdict(total)["verification"]) == ("ANSWERED", "PASSED")
    assert total.result.collect()[0]["value"] == 29.5
    march = answer(MetricQuery(("sales",), "revenue", time=TimeRange(month=3), date_column="day"), tables, facts)
    assert march.refused and verdict(march)["rule"] == "month" and verdict(march)["verification"] == "NOT_EXECUTED"
    copies = answer(MetricQuery(("copies",), "revenue", dedup=True), tables, facts)
    assert (verdict(copies)["verdict"], copies.result.collect()[0]["value"]) == ("ANSWERED_WITH_ASSUMPTIONS", 29.5)
    empty = answer(MetricQuery(("sales",), "revenue", filters=(Condition("product_id", "=", "zz"),)), tables, facts)
    assert (verdict(empty)["verdict"], empty.result.collect()[0]["value"]) == ("ANSWERED_WITH_ASSUMPTIONS", 0.0)
    joined = answer(MetricQuery(("sales", "products"), "revenue", group_by=("category",), join=Join("product_id")), tables, facts)
    assert [tuple(r) for r in joined.result.collect()] == [("Tools", 25.0), ("Toys", 4.5)]
    assert verdict(joined)["verification"] == "PASSED" and '"join_key":"product_id"' in verdict(joined)["evidence"]
    assert verdict(answer(MetricQuery(("sales",), "profit"), tables, facts))["rule"] == "metric"
    assert verdict(answer(MetricQuery(("sales",), "revenue"), tables, facts, intent="opinion"))["rule"] == "intent"


def test_answers_enter_the_ledger(spark, tables, facts):
    marks = reduce(DataFrame.unionByName, [ledger.fingerprint(df, name) for name, df in tables.items()])
    given = [answer(MetricQuery(("sales",), "revenue"), tables, facts), answer(MetricQuery(("sales",), "profit"), tables, facts)]
    rows = reduce(DataFrame.unionByName, [ledger_record(g, f"run{i}", marks) for i, g in enumerate(given)])
    records = checkpointed(rows.withColumn("chain", F.lit("day")))
    chained = checkpointed(ledger.chain(records, "chain", ["timestamp", "run_id"], ledger.PAYLOAD, 100))
    assert ledger.verify_chain(chained, "chain", ledger.PAYLOAD, 100).count() == 0
    found = {r["run_id"]: r for r in chained.collect()}
    assert found["run0"]["primary_result"].startswith('{"rows":1,"total":29.5,"content":"')
    assert found["run0"]["primary_result"] == found["run0"]["secondary_result"]
    assert (found["run1"]["verification_status"], found["run1"]["confidence"]) == ("NOT_EXECUTED", "LOW")
    better = chained.withColumn("confidence", F.lit("HIGH"))  # every stored field is hashed
    assert ledger.verify_chain(better, "chain", ledger.PAYLOAD, 100).filter("problem = 'broken_hash'").count() == 1


def test_collection(spark, tables, tmp_path):
    claims = {**tables, "summary_usd": spark.createDataFrame([("t", 100.0)], "name string, revenue double"),
              "summary2_usd": spark.createDataFrame([("t", 90.0)], "name string, revenue double")}
    found = profile_collection(claims)
    assert found.columns.filter("table_name = 'sales'").count() == 4
    assert [r["missing_months"] for r in found.dates.filter("table_name = 'sales'").collect()] == [["2025-03"]]
    pairs = {(r["table_a"], r["table_b"]) for r in found.contradictions.collect()}
    assert pairs == {("summary2_usd", "summary_usd"), ("copies", "sales")}  # sales and summaries share no currency
    assert {r["join_key"] for r in found.relationships.filter("table_b = 'sales' and table_a = 'products'").collect()} == {"product_id"}
    found.save(str(tmp_path / "profiles"))
    stored = spark.read.parquet(str(tmp_path / "profiles" / "tables"))
    assert {r["table_name"]: r["duplicate_count"] for r in stored.collect()}["copies"] == 1


def test_table_names_that_clash_are_refused(spark, tables):
    clash = {"Sales": tables["sales"], "sales": tables["sales"]}
    given = answer(MetricQuery(("sales",), "revenue"), clash, checkpointed(gates.table_facts(clash)))
    assert given.refused
