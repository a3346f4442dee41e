"""Metric queries on small frames: missing values, dedup, joins, growth, skew."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from attest.functions.dates import TimeRange
from attest.operators.duplicates import distinct_rows, duplicate_impact, duplicate_profile, duplicate_rows
from attest.operators.filters import Condition
from attest.operators.median import median_by, quantile_by
from attest.operators.metric import (
    AGGREGATIONS,
    Join,
    MetricQuery,
    MonthOf,
    combine,
    growth_by_month,
    join_tables,
    run,
    summarize,
)
from attest.operators.position import with_position

NAN = float("nan")


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        ("a", "2025-01-05", "p1", "East", 2, 10.0), ("b", "2025-01-20", "p2", "West", 1, 4.5),
        ("c", "2025-02-01", "p1", "East", 3, 15.0), ("d", "2025-04-09", "p3", None, 1, 7.25),
        ("e", "2025-04-10", "p2", "WEST", 5, None), ("f", "2025-04-11", None, "East", 1, NAN),
        ("c", "2025-02-01", "p1", "East", 3, 15.0),
    ]
    return spark.createDataFrame(rows, "id string, day string, product string, region string, quantity int, revenue double") \
        .withColumn("day", F.to_date("day"))


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([("p1", "Tools"), ("p2", "Toys"), ("p2", "Games"), (None, "Nothing")],
                                 "product string, category string")


def one(df):
    return df.collect()[0].asDict()


def value(sales, aggregation, **more):
    return one(run(MetricQuery(("sales",), "revenue", aggregation, **more), {"sales": sales}))


def test_ungrouped_aggregates(sales):
    assert value(sales, "sum", scale=2)["value"] == 51.75
    assert value(sales, "mean")["value"] == pytest.approx(51.75 / 5)
    assert value(sales, "median")["value"] == 10.0
    assert value(sales, "min")["value"] == 4.5
    assert value(sales, "max")["value"] == 15.0  # NaN is missing, not the largest number
    assert value(sales, "count")["value"] == 7  # rows, also where the metric is missing
    assert value(sales, "count_distinct")["value"] == 4


def test_summarize_agrees_with_single_queries(sales):
    row = one(summarize(sales, "revenue", scale=2))
    for name in AGGREGATIONS:
        key = {"count_distinct": "value_distinct"}.get(name, f"value_{name}")
        wanted = value(sales, name, scale=2)["value"]
        assert row["row_count" if name == "count" else key] == pytest.approx(wanted)


def test_empty_filter_gives_zero(sales):
    for name in AGGREGATIONS:
        row = value(sales, name, filters=(Condition("product", "=", "zzz"),))
        assert (row["value"], row["rows_total"], row["rows_used"]) == (0, 7, 0)


def test_groups_drop_missing_keys_and_count_values(sales):
    def grouped(name):
        rows = run(MetricQuery(("sales",), "revenue", name, group_by=("region",)), {"sales": sales}).collect()
        return {r["region"]: r["value"] for r in rows}

    assert grouped("count") == {"East": 3, "West": 1, "WEST": 0}
    assert grouped("sum") == {"East": 40.0, "West": 4.5, "WEST": 0.0}
    assert grouped("median") == {"East": 15.0, "West": 4.5, "WEST": None}
    assert grouped("count_distinct") == {"East": 2, "West": 1, "WEST": 0}


def test_rank_and_limit(sales):
    query = MetricQuery(("sales",), "quantity", group_by=("product",), limit=2)
    assert [tuple(r) for r in run(query, {"sales": sales}).collect()] == [("p1", 8.0), ("p2", 6.0)]
    query = MetricQuery(("sales",), "quantity", group_by=("product",), limit=1, ascending=True)
    assert [tuple(r) for r in run(query, {"sales": sales}).collect()] == [("p3", 1.0)]


def test_dedup_counts_only_copies(sales):
    row = value(sales, "sum", dedup=True, scale=2)
    assert (row["value"], row["rows_used"], row["duplicates_excluded"]) == (36.75, 6, 1)
    row = value(sales, "count", dedup=True, filters=(Condition("region", "=", "west"),))
    assert (row["value"], row["rows_total"], row["duplicates_excluded"]) == (2, 7, 0)
    assert "duplicates_excluded" not in value(sales, "max", dedup=True)


def test_duplicate_reports(spark, sales):
    assert one(duplicate_profile(sales, "sales"))["duplicate_pct"] == 14.29
    assert one(duplicate_profile(sales.limit(0), "sales"))["advice"] == "table is empty"
    assert [r["copies"] for r in duplicate_rows(sales).collect()] == [2]
    impact = one(duplicate_impact(sales, "revenue"))
    assert (impact["total_raw"], impact["total_clean"], impact["rows_clean"]) == (51.75, 36.75, 6)
    tricky = spark.createDataFrame([("1:a", "b" * 80), ("1", "a:b" + "b" * 77), (None, ""), ("", None), ("", None)],
                                   "x string, y string").withColumn("z", F.map_from_arrays(F.array(F.lit("k")), F.array("x")))
    assert distinct_rows(tricky, []).count() == 4
    assert [r["copies"] for r in duplicate_rows(tricky.drop("z").withColumn("w", F.repeat("x", 9))).collect()] == [2]


def test_wide_duplicates_equal_distinct(spark):
    df = spark.range(2000).select(*[(F.col("id") % (7 + i)).alias(f"c{i}") for i in range(3)],
                                  *[F.concat(F.lit("t"), F.col("id") % 3).alias(f"t{i}") for i in range(4)],
                                  (F.col("id") % 2 / 3).alias("d"))
    assert distinct_rows(df, []).count() == df.distinct().count()


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("aggregation", AGGREGATIONS)
def test_join_is_the_same_with_and_without_folding(spark, sales, products, aggregation, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        tables = {"sales": sales, "products": products}
        grouped = run(MetricQuery(("sales", "products"), "revenue", aggregation, group_by=("category",),
                                  join=Join("product"), scale=2), tables)
        found = {r["category"]: r["value"] for r in grouped.collect()}
        total = one(run(MetricQuery(("sales", "products"), "revenue", aggregation, join=Join("product"), scale=2), tables))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tools, toys = [10.0, 15.0, 15.0], [4.5]
    every = tools + toys + toys
    pick = {"sum": sum, "mean": statistics.mean, "median": statistics.median, "min": min, "max": max,
            "count": len, "count_distinct": lambda v: len(set(v))}[aggregation]
    assert found == pytest.approx({"Tools": pick(tools), "Toys": pick(toys), "Games": pick(toys)})
    rows = 7  # a NULL product never matches; p2 matches twice
    assert total["rows_used"] == rows
    assert total["value"] == pytest.approx(rows if aggregation == "count" else pick(every))


def test_join_types_and_null_keys(sales, products):
    counts = {how: join_tables(sales, products, "product", how=how).count()
              for how in ("inner", "left", "right", "full", "left_semi", "left_anti")}
    assert counts == {"inner": 7, "left": 9, "right": 8, "full": 10, "left_semi": 5, "left_anti": 2}


def test_combine_fills_missing_columns(sales, products):
    both = combine(sales.select("product", "revenue"), products)
    assert (both.count(), both.filter("category is null").count()) == (11, 7)


def test_growth_is_null_after_a_gap(sales):
    rows = {r["month"]: r for r in growth_by_month(sales, "day", "revenue").collect()}
    assert rows["2025-01"]["growth"] is None
    assert rows["2025-02"]["growth"] == pytest.approx((30 - 14.5) / 14.5)
    assert rows["2025-04"]["previous_value"] is None and rows["2025-04"]["growth"] is None


def test_month_groups_and_time_ranges(spark, sales):
    rows = run(MetricQuery(("sales",), "quantity", group_by=(MonthOf("day"),)), {"sales": sales}).collect()
    assert {r["month"]: r["value"] for r in rows} == {"2025-01": 3.0, "2025-02": 6.0, "2025-04": 7.0}

    def count(column="day", df=sales, **fields):
        return value(df, "count", time=TimeRange(**fields), date_column=column)["value"]

    assert [count(month=4), count(quarter=1), count(year=2025), count(year=2024)] == [3, 4, 7, 0]
    assert [count(start="2025-01-20", end="2025-02-01"), count(start="2025-04-10"), count(day="2025-04-09")] == [3, 2, 1]
    assert count(month=1, fiscal_offset=3) == 3  # April opens the fiscal year
    texts = sales.withColumn("day", F.date_format("day", "MM/dd/yyyy"))
    assert [count(df=texts, month=4), count(df=texts, day="2025-04-09")] == [3, 1]


@pytest.mark.parametrize("operator, wanted, kept", [
    ("=", "west", 2), ("!=", "East", 3), ("in", ["West"], 1), ("not_in", ["East", "West"], 2),
    ("contains", "^w.st$", 2), ("contains", "x|east", 4),
])
def test_text_conditions(sales, operator, wanted, kept):
    assert value(sales, "count", filters=(Condition("region", operator, wanted),))["value"] == kept


@pytest.mark.parametrize("operator, wanted, kept", [
    (">", 10, 2), (">=", 10, 3), ("<", 10, 2), ("<=", 10, 3), ("=", 15, 2), ("!=", 15, 5), ("between", (4.5, 10), 3),
])
def test_number_conditions_skip_missing_and_nan(sales, operator, wanted, kept):
    assert value(sales, "count", filters=(Condition("revenue", operator, wanted),))["value"] == kept


def test_conditions_against_a_table(spark, sales):
    listed = spark.createDataFrame([("p1",), (None,)], "p string")
    assert value(sales, "count", filters=(Condition("product", "in", listed),))["value"] == 3
    assert value(sales, "count", filters=(Condition("product", "not_in", listed),))["value"] == 4
    literal = Condition("region", "contains", "a.t", literal=True)
    assert value(sales, "count", filters=(literal,))["value"] == 0


def test_bad_queries_are_rejected():
    for wrong in (lambda: Condition("x", "~", 1), lambda: MetricQuery(("a",), "x", "mode"),
                  lambda: MetricQuery(("a", "b"), "x"), lambda: MetricQuery(("a",), "x", time=TimeRange(year=1))):
        with pytest.raises(ValueError):
            wrong()


def test_quantiles_of_a_hot_group_are_exact(spark):
    random.seed(5)
    rows = [("hot", random.choice([1.0, 2.0, random.uniform(0, 1e6)])) for _ in range(60000)]
    rows += [(f"k{i % 50}", random.gauss(0, 100)) for i in range(500)] + [("hot", None), ("none", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    groups = {}
    for k, v in rows:
        if k is not None:
            groups.setdefault(k, []).extend([] if v is None else [v])
    found = {r["k"]: r["median_value"] for r in median_by(df, ["k"], "v").collect()}
    assert found == pytest.approx({k: statistics.median(v) if v else None for k, v in groups.items()})
    for p in (0.0, 0.01, 0.9, 1.0):
        wanted = df.filter("k = 'hot'").agg(F.percentile("v", p)).collect()[0][0]
        assert one(quantile_by(df.filter("k = 'hot'"), [], "v", p))["quantile_value"] == pytest.approx(wanted)


def test_positions_of_a_hot_key(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 40).alias("k"),
                                   F.xxhash64("id").alias("v"), "id").repartition(8)
    rows = with_position(df, ["v"], ["k"]).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r["k"], []).append(r)
    assert len(rows) == 30000
    for group in by_key.values():
        group.sort(key=lambda r: r["v"])
        assert [r["position"] for r in group] == list(range(1, len(group) + 1))


def test_sums_keep_small_large_and_infinite_values(spark):
    small = spark.range(1000).selectExpr("CAST(0.004 AS DOUBLE) AS v", "DATE'2024-01-05' AS d", "id")
    assert one(duplicate_impact(small, "v"))["total_raw"] == pytest.approx(4.0)
    assert growth_by_month(small, "d", "v").collect()[0]["value"] == pytest.approx(4.0)
    odd = spark.createDataFrame([(1.0,), (float("inf"),), (1e17,)], "v double")
    assert one(duplicate_impact(odd, "v"))["total_raw"] == float("inf")
    ids = spark.range(20).selectExpr("9000000000000000000 + id AS v")
    assert one(run(MetricQuery(("t",), "v", "mean"), {"t": ids}))["value"] == pytest.approx(9e18)


def test_joins_keep_keys_and_clashing_columns(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "k int, name string, `net.price` int")
    b = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k int, name string")
    full = {(r["k"], r["name_x"], r["name_y"], r["net.price"]) for r in join_tables(a, b, "k", how="full").collect()}
    assert full == {(1, "a", "x", 1), (2, "b", None, 2), (None, "n", None, 3), (3, None, "y", None), (None, None, "z", None)}
    assert {r["k"] for r in join_tables(a, b, "k", how="right").collect()} == {1, 3, None}


def test_null_in_a_list_is_no_value(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert {r["k"] for r in Condition("k", "not_in", ["a", None]).apply(df).collect()} == {"b", None}
