"""Metric queries: aggregates, groups, ranks, growth, deduplication, combined tables."""

from pyspark.sql import functions as F

from attest.operators.duplicates import duplicate_impact as impact
from attest.operators.duplicates import duplicate_profile as profile_duplicates
from attest.operators.duplicates import duplicate_samples as sample_duplicates
from attest.operators.filters import Condition
from attest.operators.metric import (
    Join,
    MetricQuery,
    MonthOf,
    combine,
    growth_by_month,
    run,
    summarize,
    top_per,
)
from attest.operators.median import median_by
from attest.plans.registry import query

REVENUE = "cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))"


def with_revenue(lineitem):
    return lineitem.withColumn("revenue", F.expr(REVENUE))


def repeated_lines(lineitem):
    """Line attributes without the order key: a table with true duplicate rows."""
    return lineitem.select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity")


LINES = "(SELECT l_partkey, l_returnflag, l_linestatus, l_quantity FROM lineitem)"


@query(f"""
SELECT p_type, CAST(SUM({REVENUE}) AS DOUBLE) AS value
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_type ORDER BY value DESC, p_type LIMIT 5
""")
def top_type_revenue(t):
    tables = {"lineitem": with_revenue(t.lineitem), "part": t.part}
    return run(MetricQuery(("lineitem", "part"), "revenue", group_by=("p_type",),
                           join=Join("l_partkey", "p_partkey"), scale=4, limit=5), tables)


@query(f"""
SELECT o_orderpriority, CAST(SUM({REVENUE}) AS DOUBLE) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY o_orderpriority
""")
def priority_revenue(t):
    """A join of two large tables: lines are folded per order key before they meet the orders."""
    tables = {"lineitem": with_revenue(t.lineitem), "orders": t.orders}
    return run(MetricQuery(("lineitem", "orders"), "revenue", group_by=("o_orderpriority",),
                           join=Join("l_orderkey", "o_orderkey"), scale=4), tables)


@query("""
SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value_sum,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS value_mean,
  MEDIAN(l_extendedprice) AS value_median, MIN(l_extendedprice) AS value_min,
  MAX(l_extendedprice) AS value_max, COUNT(l_extendedprice) AS value_count,
  COUNT(DISTINCT l_extendedprice) AS value_distinct, COUNT(*) AS row_count
FROM lineitem
""")
def scalar_aggs(t):
    return summarize(t.lineitem, "l_extendedprice", scale=2)


@query("""
SELECT o_orderpriority,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value_sum,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(COUNT(o_totalprice) AS DOUBLE) AS value_mean,
  MEDIAN(o_totalprice) AS value_median, MIN(o_totalprice) AS value_min,
  MAX(o_totalprice) AS value_max, COUNT(o_totalprice) AS value_count,
  COUNT(DISTINCT o_totalprice) AS value_distinct, COUNT(*) AS row_count
FROM orders GROUP BY o_orderpriority
""")
def grouped_aggs(t):
    return summarize(t.orders, "o_totalprice", ["o_orderpriority"], scale=2)


@query("""
SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def multi_key_group(t):
    return run(MetricQuery(("lineitem",), "l_quantity", group_by=("l_returnflag", "l_linestatus"), scale=2),
               t.named("lineitem"))


@query("SELECT l_returnflag, MEDIAN(l_extendedprice) AS median_value FROM lineitem GROUP BY l_returnflag")
def median_by_group(t):
    return median_by(t.lineitem, ["l_returnflag"], "l_extendedprice")


@query("""
SELECT priority, COUNT(CASE WHEN NOT isnan(price) THEN price END) AS value FROM (
  SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS priority,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL
              WHEN o_orderkey % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE o_totalprice END AS price
  FROM orders) WHERE priority IS NOT NULL GROUP BY priority
""")
def null_group_key(t):
    """Rows with a missing key are dropped; missing and NaN metric values are not counted."""
    orders = t.orders.select(
        F.expr("CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END").alias("priority"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL "
               "WHEN o_orderkey % 11 = 0 THEN double('NaN') ELSE o_totalprice END").alias("price"))
    return run(MetricQuery(("orders",), "price", "count", group_by=("priority",)), {"orders": orders})


@query("""
SELECT COALESCE(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS value,
  (SELECT COUNT(*) FROM orders) AS rows_total, COUNT(*) AS rows_used
FROM orders WHERE lower(o_orderstatus) = 'no such status'
""")
def empty_filter_total(t):
    return run(MetricQuery(("orders",), "o_totalprice", scale=2,
                           filters=(Condition("o_orderstatus", "=", "No such status"),)), t.named("orders"))


@query("""
SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(COUNT(o_totalprice) AS DOUBLE) AS value,
  (SELECT COUNT(*) FROM orders) AS rows_total, COUNT(*) AS rows_used
FROM orders WHERE lower(o_orderstatus) = 'f' AND o_totalprice >= 100000
""")
def filtered_mean(t):
    return run(MetricQuery(("orders",), "o_totalprice", "mean", scale=2, filters=(
        Condition("o_orderstatus", "=", "f"), Condition("o_totalprice", ">=", 100000))), t.named("orders"))


@query("""
SELECT n_name, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY value, n_name LIMIT 3
""")
def least_n_groups(t):
    return run(MetricQuery(("customer", "nation"), "c_acctbal", group_by=("n_name",), ascending=True, limit=3,
                           join=Join("c_nationkey", "n_nationkey"), scale=2), t.named("customer", "nation"))


@query("""
WITH g AS (
  SELECT p_brand, p_type, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type)
SELECT p_brand, p_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY value DESC, p_type) AS r FROM g) WHERE r = 1
""")
def top_type_per_brand(t):
    grouped = run(MetricQuery(("lineitem", "part"), "l_extendedprice", group_by=("p_brand", "p_type"),
                              join=Join("l_partkey", "p_partkey"), scale=2), t.named("lineitem", "part"))
    return top_per(grouped, ["p_brand"], "p_type", "value")


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM orders GROUP BY 1
""")
def monthly_totals(t):
    return run(MetricQuery(("orders",), "o_totalprice", group_by=(MonthOf("o_orderdate"),), scale=2),
               t.named("orders"))


SMALL = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.0001 AS DECIMAL(22,6))"


@query(f"""
WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, SUM({SMALL}) AS v FROM orders GROUP BY ALL)
SELECT strftime(a.m, '%Y-%m') AS month, CAST(a.v AS DOUBLE) AS value, CAST(b.v AS DOUBLE) AS previous_value,
  CAST(a.v - b.v AS DOUBLE) / CAST(b.v AS DOUBLE) AS growth,
  (SELECT CAST(SUM({SMALL}) AS DOUBLE) FROM orders) AS total
FROM m a LEFT JOIN m b ON a.m = b.m + INTERVAL 1 MONTH
""")
def small_amount_totals(t):
    small = t.orders.select("o_orderdate", F.expr(SMALL).alias("amount"))
    total = impact(small, "amount").select(F.col("total_raw").alias("total"))
    return growth_by_month(small, "o_orderdate", "amount").select("*", total.scalar().alias("total"))


GROWTH_SQL = """
WITH m AS (
  SELECT {keys} date_trunc('month', o_orderdate) AS m, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v
  FROM orders GROUP BY ALL)
SELECT {out} strftime(a.m, '%Y-%m') AS month, CAST(a.v AS DOUBLE) AS value,
  CAST(b.v AS DOUBLE) AS previous_value, CAST(a.v - b.v AS DOUBLE) / CAST(b.v AS DOUBLE) AS growth
FROM m a LEFT JOIN m b ON a.m = b.m + INTERVAL 1 MONTH {on}
"""


@query(GROWTH_SQL.format(keys="", out="", on=""))
def month_over_month(t):
    return growth_by_month(t.orders, "o_orderdate", "o_totalprice", scale=2)


@query(GROWTH_SQL.format(keys="o_custkey,", out="a.o_custkey,", on="AND a.o_custkey = b.o_custkey"))
def month_over_month_by_customer(t):
    return growth_by_month(t.orders, "o_orderdate", "o_totalprice", ["o_custkey"], scale=2)


@query("""
SELECT o_orderpriority, COUNT(o_custkey) AS with_customer, COUNT(o_totalprice) AS with_price, COUNT(*) AS row_count
FROM (SELECT o_orderkey, o_orderpriority, o_custkey, NULL AS o_totalprice FROM orders WHERE o_orderstatus = 'F'
      UNION ALL
      SELECT o_orderkey, o_orderpriority, NULL, o_totalprice FROM orders WHERE o_orderstatus <> 'F')
GROUP BY o_orderpriority
""")
def combine_tables(t):
    closed = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority", "o_custkey")
    open_ = t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return combine(closed, open_).groupBy("o_orderpriority").agg(
        F.count("o_custkey").alias("with_customer"), F.count("o_totalprice").alias("with_price"),
        F.count("*").alias("row_count"))


@query(f"""
SELECT CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value, (SELECT COUNT(*) FROM {LINES}) AS rows_total,
  COUNT(*) AS rows_used, CAST((SELECT COUNT(*) FROM {LINES} WHERE l_quantity > 10) - COUNT(*) AS BIGINT) AS duplicates_excluded
FROM (SELECT DISTINCT * FROM {LINES}) WHERE l_quantity > 10
""")
def dedup_sum(t):
    return run(MetricQuery(("lines",), "l_quantity", dedup=True, scale=2,
                           filters=(Condition("l_quantity", ">", 10),)), {"lines": repeated_lines(t.lineitem)})


@query(f"""
SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS value
FROM (SELECT DISTINCT * FROM {LINES}) GROUP BY l_returnflag
""")
def dedup_grouped_mean(t):
    return run(MetricQuery(("lines",), "l_quantity", "mean", dedup=True, scale=2, group_by=("l_returnflag",)),
               {"lines": repeated_lines(t.lineitem)})


@query(f"""
WITH r AS (SELECT COUNT(*) AS n, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS v FROM {LINES}),
     c AS (SELECT COUNT(*) AS n, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS v FROM (SELECT DISTINCT * FROM {LINES}))
SELECT r.n AS rows_raw, c.n AS rows_clean, CAST(r.v AS DOUBLE) AS total_raw, CAST(c.v AS DOUBLE) AS total_clean,
  CAST(r.v - c.v AS DOUBLE) AS difference, ROUND(CAST(r.v - c.v AS DOUBLE) * 100 / CAST(r.v AS DOUBLE), 2) AS difference_pct
FROM r, c
""")
def duplicate_impact(t):
    return impact(repeated_lines(t.lineitem), "l_quantity", scale=2)


@query(f"""
WITH d AS (SELECT COUNT(*) AS n, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {LINES})) AS dup FROM {LINES})
SELECT 'lines' AS table_name, n AS row_count, CAST(dup AS BIGINT) AS duplicate_count,
  ROUND(CAST(dup AS DOUBLE) * 100 / CAST(n AS DOUBLE), 2) AS duplicate_pct, dup > 0 AS has_duplicates,
  CASE WHEN dup > 0 THEN dup || ' duplicate rows; sums and counts include them unless deduplicated'
       ELSE 'all rows are unique' END AS advice
FROM d
""")
def duplicate_profile(t):
    return profile_duplicates(repeated_lines(t.lineitem), "lines")


@query(f"""
SELECT *, COUNT(*) AS copies FROM {LINES} GROUP BY ALL HAVING COUNT(*) > 1
ORDER BY l_partkey, l_returnflag, l_linestatus, l_quantity LIMIT 5
""")
def duplicate_samples(t):
    return sample_duplicates(repeated_lines(t.lineitem))
