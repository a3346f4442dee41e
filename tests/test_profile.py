"""Profiles: classes, missing values, keys, dates, currencies, units, overlap."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.dates import parse_date
from attest.functions.money_units import name_currency, name_unit, symbol_currencies, symbol_currency, value_unit
from attest.functions.text import (
    group_word,
    intent_label,
    metric_word,
    month_mention,
    months_mentioned,
    operation_word,
    redact_secrets,
    year_mention,
)
from attest.operators import coverage, money_units, overlap, profile


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        ("ORD-1", "2025-01-05", "P1", 100.0, "$5", 1.5, "ok"), ("ORD-2", "2025-02-15", "P2", 200.0, "$6", 2.5, None),
        ("ORD-3", "2025-01-20", "P1", float("nan"), "$7", 3.5, " \t"), ("ORD-1", "2025-01-05", "P1", 100.0, "$5", 1.5, "ok"),
    ]
    return spark.createDataFrame(rows, "order_id string, date string, product_id string, revenue double, "
                                       "price_usd string, weight_kg double, notes string")


def test_column_profile(frame):
    for distinct in ("approx", "exact"):
        rows = {r["column_name"]: r for r in profile.column_profile(frame, "t", distinct).collect()}
        assert [r["position"] for r in rows.values()] and len(rows) == 7
        revenue, notes = rows["revenue"], rows["notes"]
        assert (revenue["column_class"], revenue["min_value"], revenue["max_value"]) == ("numeric", 100.0, 200.0)
        assert revenue["mean_value"] == pytest.approx(400 / 3)
        assert (revenue["missing_count"], revenue["missing_pct"], revenue["distinct_count"]) == (1, 25.0, 2)
        assert (notes["column_class"], notes["missing_count"], notes["min_value"]) == ("categorical", 2, None)


def test_classes_and_empty_table(spark):
    df = spark.createDataFrame([], "a boolean, b array<int>, c date, d decimal(5,2), e map<string,int>")
    rows = {r["column_name"]: r for r in profile.column_profile(df, "t", "exact").collect()}
    assert [rows[c]["column_class"] for c in "abcde"] == ["categorical", "nested", "temporal", "numeric", "nested"]
    assert rows["d"]["missing_pct"] == 0.0 and rows["d"]["mean_value"] is None and rows["a"]["distinct_count"] == 0


def test_missing_and_health(spark, frame):
    summary = profile.missing_summary(profile.missing_profile(frame, "t")).collect()[0]
    assert (summary["columns_with_missing"], summary["empty_columns"], summary["total_missing"]) == ("notes,revenue", "", 3)
    tables = profile.table_profiles({"t": frame, "clean": frame.select("order_id").distinct()})
    health = {r["table_name"]: r["health"] for r in profile.table_health(tables).collect()}
    assert health == {"t": "1 duplicate rows; 3 missing values", "clean": "clean"}
    wide = spark.createDataFrame([(" ", "")], "a string, b string")  # a no-break space is white space
    assert profile.missing_profile(wide, "w").agg(F.sum("missing_count")).collect()[0][0] == 2


def test_ids(spark):
    df = spark.createDataFrame([(1, "a", 10, 1, None), (2, "b", 20, 1, "x"), (3, "c", 30, 2, "y")],
                               "order_id int, name string, paid int, price_code int, sku string")
    found = {r["column_name"]: (r["is_id_candidate"], r["is_pk_candidate"])
             for r in profile.id_candidates(df, "t").collect()}
    assert found == {"order_id": (True, True), "name": (True, True), "paid": (False, False),
                     "price_code": (False, False), "sku": (True, False)}
    assert profile.repeated_keys(df, ["price_code"]).collect()[0]["row_count"] == 2


def test_date_shapes(spark):
    texts = {
        "2025-01-05": "2025-01-05", "05/01/2025": "2025-05-01", "13/02/2025": "2025-02-13", "2025/3/7": "2025-03-07",
        "2025-01-05 10:11:12": "2025-01-05", "2025-01-05T10:11:12": "2025-01-05", "7-Mar-2025": "2025-03-07",
        "Mar 7, 2025": "2025-03-07", "2025-02": "2025-02-01", "ORD-1": None, "2025": None, "2025-02-30": None, "20250105": None,
    }
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    found = {r["t"]: r["d"] and str(r["d"]) for r in df.select("t", F.to_date(parse_date(F.col("t"))).alias("d")).collect()}
    assert found == texts


def test_date_profile(spark):
    df = spark.createDataFrame([("05/01/2025", "x"), ("13/02/2025", "2025-01-01"), ("2025-05-05", None), ("?", "y")], "d string, s string")
    rows = {r["column_name"]: r for r in coverage.date_profile(df, "t").collect()}
    assert (rows["d"]["parse_ratio"], rows["d"]["is_date"], rows["d"]["ambiguous_count"]) == (0.75, True, 1)
    assert rows["d"]["ambiguous_example"] == "05/01/2025" and rows["s"]["is_date"] is False
    columns = coverage.date_columns(coverage.date_profile(df, "t")).collect()
    assert len(columns) == 1 and columns[0]["missing_months"] == ["2025-03", "2025-04"]
    keyed = df.withColumn("k", F.lit(1)).filter("d <> '?'")
    assert [r["month"] for r in coverage.missing_months(keyed, "d", ["k"]).orderBy("month").collect()] == ["2025-03", "2025-04"]
    assert coverage.missing_months(keyed.limit(0), "d").count() == 0
    assert {r["month"]: r["row_count"] for r in coverage.present_months(keyed, "d").collect()} == {"2025-05": 2, "2025-02": 1}


def test_names():
    assert [name_currency(n) for n in ("price_usd", "sales_inr.csv", "pounds", "neural", "Revenue (EUR)", "amount")] == [
        "USD", "INR", "GBP", None, "EUR", None]
    assert [name_unit(n) for n in ("weight_kg", "volume (ml)", "load [lbs]", "a_gross", "x_m2", "distance_km")] == [
        "kilograms", "millilitres", "pounds", None, None, "kilometres"]


def test_symbols_and_units(spark):
    df = spark.createDataFrame([("A$5",), ("C$6",), ("$7",), ("₹8",), ("$1 or €2",), ("none",), (None,)], "s string")
    rows = df.select(symbol_currency(F.col("s")).alias("one"), symbol_currencies(F.col("s")).alias("all")).collect()
    assert [r["one"] for r in rows] == ["AUD", "CAD", "USD", "INR", "USD", None, None]
    assert rows[4]["all"] == ["EUR", "USD"] and rows[0]["all"] == ["AUD"] and rows[5]["all"] is None
    df = spark.createDataFrame([("5 kg",), ("2.5 l",), ("Apparel",), ("Small",), ("-3ML",), ("7",), (None,)], "s string")
    assert [r[0] for r in df.select(value_unit(F.col("s"))).collect()] == [
        "kilograms", "litres", None, None, "millilitres", None, None]


def test_table_currency(spark):
    mixed = spark.createDataFrame([("USD",), ("usd ",), ("INR",), ("",)], "currency string")
    plain = spark.createDataFrame([(1.0,), (2.0,)], "revenue double")
    tables = {"mixed": mixed, "plain": plain, "sales_usd": plain}
    found = reduce(DataFrame.unionByName, [money_units.currency_profile(d, n) for n, d in tables.items()])
    rows = {r["table_name"]: r for r in money_units.table_currency(found, list(tables)).collect()}
    assert (rows["mixed"]["currency"], rows["mixed"]["currencies"], rows["mixed"]["is_multi_currency"]) == ("USD", "INR,USD", True)
    assert rows["plain"]["currency"] == "UNKNOWN" and rows["sales_usd"]["currency"] == "USD"


def test_overlap_bounds_are_strict(spark):
    def keys(start, stop, kind="int"):
        return spark.range(start, stop).select(F.col("id").cast(kind).alias("k"))

    tables = {"a": keys(0, 10), "b": keys(9, 19), "c": keys(5, 15), "d": keys(0, 20, "string"), "e": keys(4, 14, "bigint")}
    rows = {(r["table_a"], r["table_b"]): r for r in overlap.key_overlap(tables).collect()}
    assert ("a", "b") not in rows  # a tenth, on both sides
    assert rows[("a", "c")]["is_recommended"] is False  # one half, on both sides
    assert rows[("a", "e")]["overlap_count"] == 6 and rows[("a", "e")]["is_recommended"] is True
    assert not any("d" in pair for pair in rows)  # a text is not a number
    best = overlap.recommended_joins(overlap.key_overlap(tables)).collect()
    assert {(r["table_a"], r["table_b"]) for r in best} == {("a", "e"), ("b", "c"), ("c", "e")}


def test_every_class_of_columns_can_be_a_key(spark):
    def table(*columns):
        return spark.sql(f"SELECT {', '.join(columns)} FROM (SELECT explode(array(1, 2, 3, 4, NULL)) AS i)")

    tables = {
        "a": table("CAST(i / 4 AS decimal(9,2)) AS price", "date_add(DATE'2024-01-31', i) AS day", "timestamp_micros(i * 1000001) AS at",
                   "CAST(i * 0.1BD AS double) AS rate", "i > 2 AS flag", "CAST(i AS decimal(38,4)) AS id", "CAST(i AS bigint) * 9007199254740993 AS wide"),
        "b": table("CAST((i + 1) / 4 AS decimal(20,7)) AS price", "date_add(DATE'2024-01-31', i + 1) AS day", "timestamp_micros((i + 1) * 1000001) AS at",
                   "CAST((i + 1) * 0.1BD AS decimal(9,3)) AS rate", "i < 9 AS flag", "CAST(i + 1 AS double) AS id", "CAST(i AS decimal(38,0)) * 9007199254740993 AS wide"),
        "c": table("nanvl(CAST('NaN' AS double), CAST('NaN' AS double)) AS rate", "i + 1 AS id", "CAST(i AS string) AS day"),
    }
    expected = {("a", "b", k): n for k, n in (("price", 3), ("day", 3), ("at", 3), ("rate", 3), ("flag", 1), ("id", 3), ("wide", 4))}
    expected |= {("a", "c", "id"): 3, ("b", "c", "id"): 4}
    for found in (overlap.key_overlap(tables), overlap.key_overlap_sketch(tables)):
        assert {(r["table_a"], r["table_b"], r["join_key"]): r["overlap_count"] for r in found.collect()} == expected
    only = overlap.key_overlap(tables, classes=("date", "boolean")).collect()
    assert {r["join_key"] for r in only} == {"day", "flag"}
    with pytest.raises(ValueError):
        overlap.key_overlap(tables, classes=("dates",))


def test_overlap_of_many_tables_and_a_hot_value(spark):
    tables = {f"t{i:02d}": spark.range(1000).select(F.when(F.col("id") < 700, 7).otherwise(F.col("id") + i).alias("k"))
              for i in range(0, 130, 2)}
    rows = overlap.key_overlap(tables).collect()
    held = {name: {7} | {i + int(name[1:]) for i in range(700, 1000)} for name in tables}
    assert len(rows) == 65 * 64 // 2
    for r in rows:
        assert r["overlap_count"] == len(held[r["table_a"]] & held[r["table_b"]])


def test_text_labels(spark):
    cases = [
        ("Will sales rise?", "forecast", None, "sum"), ("Why did sales drop in March", "causal", 3, "sum"),
        ("Should we buy", "opinion", None, "sum"), ("Average price in SEPT 2024", "historical_analytics", 9, "mean"),
        ("willow in mayor, édec", "historical_analytics", None, "sum"), (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, q string").orderBy("i")
    q = F.col("q")
    rows = df.select(intent_label(q), month_mention(q), operation_word(q), year_mention(q), months_mentioned(q)).collect()
    assert [tuple(r[:3]) for r in rows] == [c[1:] for c in cases]
    assert rows[3][3] == 2024 and rows[1][4] == [3] and rows[4][4] == []
    df = spark.createDataFrame([("monthly churn by region",), ("units per item",), ("Average discount",), ("total orders",),
                                ("sum of Tax-2 by month",)], "q string")
    assert [tuple(r) for r in df.select(metric_word(q), group_word(q)).collect()] == [
        ("churn", "region"), ("units", "product_id"), ("discount", None), ("revenue", None), ("tax-2", "month")]


def test_redaction(spark):
    cases = {
        "key sk-abcdefghijklmnopqrstuv end": "key [REDACTED_KEY] end", "sk-short": "sk-short",
        "API_KEY=abc; x": "API_KEY=[REDACTED_KEY]; x", "Bearer abcdefghij.k": "Bearer [REDACTED_TOKEN]",
        "password: 'hunter2' y": "password: '[REDACTED_PW]' y", 'token = "t1" z': 'token = "[REDACTED_TOKEN]" z',
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["r"] for r in df.select("t", redact_secrets(F.col("t")).alias("r")).collect()} == cases
