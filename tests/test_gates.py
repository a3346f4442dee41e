"""Gates: one request per rule, and the documented adversarial questions as structured requests."""

import pytest
from pyspark.sql import functions as F

from attest.operators import gates, overlap, reconcile
from attest.operators.filters import Condition
from attest.operators.metric import Join, MetricQuery, growth_by_month, run
from attest.session import checkpointed

SALES = [("o1", "2025-01-05", "p1", "East", 2, 10.0), ("o2", "2025-02-20", "p2", "West", 1, 4.5),
         ("o3", "2025-02-21", "p1", "East", 3, 15.0), ("o4", "2025-04-09", "p3", "North", 1, 7.25)]
SCHEMA = "order_id string, date string, product_id string, region string, quantity int, unit_price double"
REQUEST = ("request_id string, tables array<string>, metric string, aggregation string, months array<int>, year int, "
           "is_growth boolean, group_by array<string>, filter_columns array<string>, sort_column string, combines boolean, "
           "requires_join boolean, join_key string, authoritative_table string, intent string, answerable boolean, has_warning boolean")
NAMES = [part.split()[0] for part in REQUEST.split(", ")]
BASE = {"tables": ["sales"], "metric": "revenue", "aggregation": "sum", "months": [], "is_growth": False, "group_by": [],
        "filter_columns": [], "combines": False, "requires_join": False, "intent": "historical_analytics",
        "answerable": True, "has_warning": False}


@pytest.fixture(scope="module")
def tables(spark):
    sales = spark.createDataFrame(SALES, SCHEMA).withColumn("revenue", F.col("quantity") * F.col("unit_price"))
    money = spark.createDataFrame([("a", 100.0), ("b", 50.0)], "order_id string, revenue double")
    return {
        "sales": sales,
        "sales_copies": sales.unionByName(sales.limit(1)),
        "products": spark.createDataFrame([("p1", "Tools"), ("p2", "Toys"), ("p3", "Toys")], "product_id string, category string"),
        "sales_inr": money.withColumn("currency", F.lit("INR")),
        "sales_usd": money.withColumn("currency", F.lit("USD")),
        "summary": spark.createDataFrame([("total", 500.0)], "metric string, revenue double"),
        "solids": spark.createDataFrame([(1.0,)], "weight_kg double"),
        "liquids": spark.createDataFrame([("2.5 l",)], "volume string"),
    }


@pytest.fixture(scope="module")
def judge(spark, tables):
    facts = gates.table_facts(tables)
    relationships = overlap.key_overlap({n: tables[n].drop("date", "region") for n in ("sales", "products")})
    totals = reconcile.metric_totals(tables, {"sales": "revenue", "summary": "revenue"})
    claims = reconcile.contradictions(totals)

    def run_gate(*bodies):
        rows = [tuple({**BASE, **body, "request_id": str(i)}.get(n) for n in NAMES) for i, body in enumerate(bodies)]
        verdicts = gates.judge(spark.createDataFrame(rows, REQUEST), facts, relationships, claims)
        return [r.asDict() for r in verdicts.orderBy(F.col("request_id").cast("int")).collect()]

    return run_gate


def test_documented_questions(judge, tables):
    cases = [
        ({}, "ANSWERED"),                                                    # simple total
        ({"metric": "quantity", "aggregation": "mean"}, "ANSWERED"),
        ({"aggregation": "max"}, "ANSWERED"),
        ({"metric": "unit_price", "aggregation": "min"}, "ANSWERED"),
        ({"group_by": ["region"]}, "ANSWERED"),
        ({"group_by": ["region"], "sort_column": "revenue"}, "ANSWERED"),
        ({"months": [2], "filter_columns": ["month"]}, "ANSWERED"),          # code over documentation: no heavy assumption
        ({"months": [1, 2], "is_growth": True}, "ANSWERED"),
        ({"months": [8]}, "REFUSED"),                                        # missing month
        ({"metric": "csat", "aggregation": "mean"}, "REFUSED"),
        ({"tables": ["sales_copies"]}, "ANSWERED_WITH_ASSUMPTIONS"),         # duplicates
        ({"tables": ["sales_usd", "sales_inr"], "combines": True}, "REFUSED"),
        ({"tables": ["solids", "liquids"], "metric": "weight_kg", "combines": True}, "REFUSED"),
        ({"months": [2]}, "ANSWERED"),
        ({"tables": ["sales", "summary"]}, "REFUSED"),                       # contradicting sources
        ({"has_warning": True}, "ANSWERED_WITH_ASSUMPTIONS"),                # empty filter
        ({"has_warning": True, "filter_columns": ["product_id"]}, "ANSWERED_WITH_ASSUMPTIONS"),
        ({"tables": ["sales", "products"], "requires_join": True, "group_by": ["category"]}, "ANSWERED"),
        ({"group_by": ["region"], "filter_columns": ["region"], "has_warning": True}, "ANSWERED_WITH_ASSUMPTIONS"),
        ({"intent": "forecast", "metric": "stock price"}, "REFUSED"),
    ]
    found = judge(*[body for body, _ in cases])
    assert [v["verdict"] for v in found] == [wanted for _, wanted in cases]
    assert [v["rule"] for v in found if v["rule"]] == ["month", "metric", "currency", "units", "contradiction", "intent"]
    levels = {"ANSWERED": "HIGH", "ANSWERED_WITH_ASSUMPTIONS": "MEDIUM", "REFUSED": "LOW"}
    assert all(v["confidence"] == levels[v["verdict"]] for v in found)


def test_the_computations_behind_the_answers(tables):
    def total(**more):
        return run(MetricQuery(("sales",), more.pop("metric", "revenue"), **more), tables).collect()[0]["value"]

    assert total() == 76.75 and total(aggregation="max") == 45.0 and total(metric="unit_price", aggregation="min") == 4.5
    copies = run(MetricQuery(("sales_copies",), "revenue", dedup=True), tables).collect()[0]
    assert (copies["value"], copies["duplicates_excluded"]) == (76.75, 1)
    top = run(MetricQuery(("sales", "products"), "revenue", group_by=("category",), join=Join("product_id"), limit=1), tables)
    assert tuple(top.collect()[0]) == ("Tools", 65.0)
    empty = run(MetricQuery(("sales",), "revenue", filters=(Condition("product_id", "=", "none"),)), tables)
    assert reconcile.sanity_flags(empty).collect()[0]["is_empty_filter"]
    growth = {r["month"]: r["growth"] for r in growth_by_month(tables["sales"], "date", "revenue").collect()}
    assert growth["2025-02"] == pytest.approx((49.5 - 20) / 20) and growth["2025-04"] is None


def test_reasons_assumptions_and_evidence(judge):
    month, exact, growth, copies, key = judge(
        {"months": [3]}, {"months": [2], "year": 2024}, {"months": [2, 3], "is_growth": True},
        {"tables": ["sales_copies"], "months": [1]}, {"tables": ["products", "sales"], "requires_join": True})
    assert month["reason"] == "March is not in sales, which covers 2025-01-05 to 2025-04-09"
    assert exact["rule"] == "month"  # the month exists, but not in that year
    assert growth["reason"] == "March is missing, so growth cannot be computed"
    assert copies["assumptions"] == ["January is read as calendar month 1", "year is read as 2025", "1 duplicate rows are left out"]
    assert copies["advisories"] == ["[sales_copies] 1 duplicate rows (20.0 %)", "[sales_copies] date lacks 2025-03"]
    assert '"join_key":"product_id"' in key["evidence"] and '"rows":[3,4]' in key["evidence"]


def test_contradiction_needs_an_authority(judge):
    found = judge({"tables": ["sales", "summary"], "authoritative_table": "SALES"}, {"tables": ["sales", "summary"], "metric": "quantity"},
                  {"tables": ["summary"]})
    assert [v["verdict"] for v in found] == ["ANSWERED"] * 3


def test_first_rule_wins(judge):
    found = judge({"intent": "causal", "tables": ["nope"]}, {"tables": ["nope"], "metric": "zzz"},
                  {"tables": ["sales_usd", "sales_inr"], "metric": "zzz"}, {"tables": [], "metric": "x"},
                  {"tables": ["SALES_U"], "metric": "REVENUE"}, {"tables": ["sal"]})
    assert [v["rule"] for v in found] == ["intent", "table", "metric", "table", None, "table"]


def test_refusal_text_has_three_parts(spark, tables):
    requests = spark.createDataFrame([(1, ["products"], "churn rate")], "request_id int, tables array<string>, metric string")
    verdicts = gates.judge(requests, gates.table_facts({"products": tables["products"]}, ()))
    assert gates.refusal_text(verdicts).collect()[0]["text"].split("\n\n") == [
        "REFUSED", "Reason: no column is about 'churn'", "Data issue: the business metric is not recorded",
        "What would be needed: a table that records it"]


def test_contradiction_on_the_column_itself(spark):
    tables = {n: spark.createDataFrame([(1, v)], "id int, sales_total double") for n, v in (("plan", 100.0), ("Actual", 200.0))}
    claims = reconcile.contradictions(reconcile.metric_totals(tables, {"plan": "sales_total", "Actual": "sales_total"}))
    requests = spark.createDataFrame([(1, ["plan", "actual"], "Sales_Total"), (2, ["plan"], "sales_total"), (3, ["plan", "actual"], "id")],
                                     "request_id int, tables array<string>, metric string")
    found = gates.judge(requests, gates.table_facts(tables, ()), contradictions=claims).orderBy("request_id").collect()
    assert [v["rule"] for v in found] == ["contradiction", None, None]


def test_names_are_looked_up_by_their_parts(spark):
    facts = spark.createDataFrame([("Orders",), ("orders_old",), ("SALES",), ("sales",), ("x.y",)], "table_name string")
    found = {r["part"]: r["found"] for r in gates.name_index(facts).collect()}
    assert found["orders"] == "orders" and found["ders_"] == "orders_old" and found["."] == "x.y"
    assert not {"sales", "ale", "rder", "", "s"} & set(found)


def test_tables_missing_empty_or_repeated(spark, tables):
    facts = gates.table_facts({n: tables[n] for n in ("sales", "products")}, ())
    requests = spark.createDataFrame([(1, None, "revenue"), (2, [], "revenue"), (3, ["sales", None], "revenue"), (4, ["SALES", "sales", "ale"], "revenue"), (4, ["sales"], "revenue")],
                                     "request_id int, tables array<string>, metric string")
    found = gates.judge(requests, facts).orderBy("request_id", "evidence").collect()
    assert [v["rule"] for v in found] == ["table", "table", "table", None, None]
    assert gates.judge(requests.limit(0), facts).count() == 0


def test_no_value_of_the_catalog_in_the_plan(spark, tables):
    facts = gates.table_facts({n: tables[n] for n in ("sales", "products", "summary")}, ())
    relationships = checkpointed(overlap.key_overlap({n: tables[n].drop("date", "region") for n in ("sales", "products")}))
    claims = checkpointed(reconcile.contradictions(reconcile.metric_totals(tables, {"sales": "revenue", "summary": "revenue"})))
    requests = spark.createDataFrame([(1, ["sales"], "revenue")], "request_id int, tables array<string>, metric string")
    plan = gates.judge(requests, facts, relationships, claims)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in plan and "products" not in plan


def test_equal_requests_are_judged_once(spark, tables, monkeypatch):
    facts = gates.table_facts({"sales": tables["sales"]}, ())
    body = F.when(F.col("id") % 3 == 0, F.lit("revenue")).when(F.col("id") % 3 == 1, F.lit("nothing"))
    requests = spark.range(300).select(
        F.when(F.col("id") < 290, F.col("id") % 200).alias("request_id"), F.array(F.lit("sales")).alias("tables"), body.alias("metric"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("region"))).alias("group_by"), F.col("id").alias("verdict"))
    judged = []
    scope = gates.with_scope
    monkeypatch.setattr(gates, "with_scope", lambda asked, *rest: judged.append(asked.count()) or scope(asked, *rest))
    found = gates.judge(requests, facts).collect()
    assert judged == [3] and len(found) == 300
    named = {i: [(r["verdict"], r["rule"]) for r in found if r["request_id"] == i] for i in (150, 151, 152)}
    assert named[150] == [("ANSWERED", None)] and named[151] == [("REFUSED", "metric")] and len(named[152]) == 1
    assert {r["request_id"] for r in found} == {*range(200), None} and sum(r["request_id"] is None for r in found) == 10
    literal = spark.range(4).select(F.col("id").alias("request_id"), F.array(F.lit("sales")).alias("tables"), F.lit("revenue").alias("metric"))
    assert [r["verdict"] for r in gates.judge(literal, facts).collect()] == ["ANSWERED"] * 4
