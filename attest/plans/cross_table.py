"""Keys, totals, joins and contracts across tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.operators import contract, joins, overlap, profile, reconcile
from attest.operators.metric import join_tables
from attest.plans.registry import query


def keyed(t):
    """Tables whose keys carry common names."""
    return {
        "customer": t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey")),
        "lineitem": t.lineitem.select(F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"),
                                      F.col("l_suppkey").alias("suppkey")),
        "nation": t.nation.select(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("regionkey")),
        "orders": t.orders.select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"),
                                  F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 100000 END").alias("partkey")),
        "region": t.region.select(F.col("r_regionkey").alias("regionkey")),
        "supplier": t.supplier.select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("nationkey")),
    }


PAIRS = [
    ("customer", "c_custkey", "orders", "o_custkey", "custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey", "nationkey"),
    ("customer", "c_nationkey", "supplier", "s_nationkey", "nationkey"),
    ("nation", "n_nationkey", "supplier", "s_nationkey", "nationkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey", "orderkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey", "suppkey"),
    ("nation", "n_regionkey", "region", "r_regionkey", "regionkey"),
]
OVERLAP_SQL = "SELECT * FROM (" + "\nUNION ALL\n".join(f"""
SELECT '{a}' AS table_a, '{b}' AS table_b, '{key}' AS join_key, n AS overlap_count,
  ROUND(CAST(n AS DOUBLE) / na, 3) AS ratio_a, ROUND(CAST(n AS DOUBLE) / nb, 3) AS ratio_b,
  (CAST(n AS DOUBLE) / na > 0.5 OR CAST(n AS DOUBLE) / nb > 0.5) AS is_recommended
FROM (SELECT (SELECT COUNT(DISTINCT {x}) FROM {a} WHERE {x} IN (SELECT {y} FROM {b})) AS n,
  (SELECT COUNT(DISTINCT {x}) FROM {a}) AS na, (SELECT COUNT(DISTINCT {y}) FROM {b}) AS nb)"""
    for a, x, b, y, key in PAIRS) + ") WHERE ratio_a > 0.1 OR ratio_b > 0.1"


@query(OVERLAP_SQL)
def key_overlap(t):
    return overlap.key_overlap(keyed(t))


@query(f"""
SELECT table_a, table_b, join_key, ratio_a, ratio_b FROM (
  SELECT *, row_number() OVER (PARTITION BY table_a, table_b ORDER BY greatest(ratio_a, ratio_b) DESC, join_key) AS r
  FROM ({OVERLAP_SQL}) WHERE is_recommended) WHERE r = 1
""")
def recommended_joins(t):
    return overlap.recommended_joins(overlap.key_overlap(keyed(t)))


@query()
def key_overlap_sketch(t):
    return overlap.key_overlap_sketch(keyed(t))


@query(f"SELECT table_a, table_b, join_key, overlap_count, TRUE AS within FROM ({OVERLAP_SQL})")
def key_overlap_bounds(t):
    """Exact numbers of shared values, and whether each lies in the interval of its estimate."""
    exact = overlap.key_overlap(keyed(t)).select(*[F.col(c).alias(f"_{c}") for c in ("table_a", "table_b", "join_key")], "overlap_count")
    bounds = overlap.overlap_bounds(keyed(t))
    met = bounds.join(exact, [F.col(c) == F.col(f"_{c}") for c in ("table_a", "table_b", "join_key")])
    return met.select("table_a", "table_b", "join_key", "overlap_count", F.col("overlap_count").between(F.col("low"), F.col("high")).alias("within"))


def _yearly(df, date, value):
    return df.groupBy(F.year(date).cast("bigint").alias("year")).agg(
        F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("value"))


@query("""
WITH a AS (SELECT year(o_orderdate) AS year, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1),
b AS (SELECT year(l_shipdate) AS year, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1)
SELECT COALESCE(a.year, b.year) AS year, a.v AS value_a, b.v AS value_b, abs(a.v - b.v) AS difference,
  COALESCE(abs(a.v - b.v) / greatest(a.v, b.v, 1.0) > 0.05 AND least(a.v, b.v) > 0, FALSE) AS contradicts
FROM a FULL JOIN b ON a.year = b.year
""")
def reconcile_totals(t):
    return reconcile.compare_grouped_totals(
        _yearly(t.orders, "o_orderdate", "o_totalprice"),
        _yearly(t.lineitem, "l_shipdate", "l_extendedprice"), ["year"])


CLAIMS = "orders", "lineitem", "copy"
CLAIMS_SQL = """
WITH v AS (
  SELECT 'orders' AS t, 'USD' AS c, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders
  UNION ALL SELECT 'lineitem', 'usd', CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem
  UNION ALL SELECT 'line_copy', 'USD', CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem
  UNION ALL SELECT 'customer', 'INR', CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM customer)
SELECT a.t AS table_a, b.t AS table_b, 'revenue' AS metric, a.v AS value_a, b.v AS value_b, abs(a.v - b.v) AS difference,
  ROUND(abs(a.v - b.v) / greatest(a.v, b.v, 1.0) * 100, 2) AS difference_pct
FROM v a JOIN v b ON a.t < b.t AND upper(a.c) = upper(b.c)
WHERE abs(a.v - b.v) / greatest(a.v, b.v, 1.0) > 0.05 AND least(a.v, b.v) > 0
"""


def claimed_totals(t):
    tables = {
        "orders": t.orders.withColumnRenamed("o_totalprice", "revenue"),
        "lineitem": t.lineitem.withColumnRenamed("l_extendedprice", "sales_total"),
        "line_copy": t.lineitem.withColumnRenamed("l_extendedprice", "revenue"),
        "customer": t.customer.withColumnRenamed("c_acctbal", "total_sales"),
    }
    metrics = {name: reconcile.revenue_column(df) for name, df in tables.items()}
    return reconcile.metric_totals(tables, metrics, scale=2, currencies={
        "orders": "USD", "lineitem": "usd", "line_copy": "USD", "customer": "INR"})


@query(CLAIMS_SQL)
def contradicting_totals(t):
    return reconcile.contradictions(claimed_totals(t)).drop("column_a", "column_b")


ORDER_CONTRACT = contract.TableContract(
    "orders",
    {"o_orderkey": "integer", "o_custkey": "string", "o_totalprice": "float", "o_orderdate": "datetime",
     "o_orderstatus": "string", "currency": "string"},
    currency="USD", glossary={"o_totalprice": "total of all lines"},
)


@query("""
WITH expected(column_name, expected_type) AS (VALUES ('o_orderkey', 'integer'), ('o_custkey', 'string'),
  ('o_totalprice', 'float'), ('o_orderdate', 'datetime'), ('o_orderstatus', 'string'), ('currency', 'string')),
actual AS (SELECT column_name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'float'
  WHEN data_type = 'TIMESTAMP' THEN 'datetime' ELSE 'string' END AS actual_type
  FROM duckdb_columns() WHERE table_name = 'orders')
SELECT 'orders' AS table_name, COALESCE(e.column_name, a.column_name) AS column_name, expected_type, actual_type,
  CASE WHEN actual_type IS NULL THEN 'missing column' WHEN expected_type IS NULL THEN 'extra column' ELSE 'wrong type' END AS problem
FROM expected e FULL JOIN actual a ON e.column_name = a.column_name
WHERE expected_type IS DISTINCT FROM actual_type
""")
def contract_violations(t):
    return contract.contract_violations(ORDER_CONTRACT, profile.column_profile(t.orders, "orders"))


IDENTITY = {
    "quantity": "l_quantity",
    "unit_price": "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) / 4 AS DECIMAL(18,2))",
}
BROKEN = "CASE WHEN l_orderkey % 11 = 0 THEN 0.01 WHEN l_orderkey % 13 = 0 THEN 2.5 ELSE 0 END"


@query(f"""
WITH r AS (SELECT CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(round(l_extendedprice) AS DECIMAL(18,2)) AS DECIMAL(18,2))
    + CAST({BROKEN} AS DECIMAL(18,2)) AS revenue, CAST(l_quantity AS DECIMAL(18,4)) AS q, CAST(round(l_extendedprice) AS DECIMAL(18,4)) AS p FROM lineitem)
SELECT COUNT(*) AS checked_rows, COUNT(*) FILTER (WHERE abs(revenue - q * p) > 0.000000001) AS broken_rows,
  CAST(MAX(abs(revenue - q * p)) AS DOUBLE) AS max_difference FROM r
""")
def metric_identity(t):
    priced = t.lineitem.select(
        F.col("l_quantity").alias("quantity"), F.round("l_extendedprice").alias("unit_price"),
        F.expr(f"CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(round(l_extendedprice) AS DECIMAL(18,2)) AS DECIMAL(18,2))"
               f" + CAST({BROKEN} AS DECIMAL(18,2))").alias("revenue"))
    return contract.metric_identity(priced, "revenue", "quantity", "unit_price", scale=4)


# --- joins ------------------------------------------------------------------

ACTIVE = "(SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0)"
HOLED = "(SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS custkey FROM orders)"
SQL_JOINS = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN",
             "left_semi": "SEMI JOIN", "left_anti": "ANTI JOIN"}


def holed(orders):
    return orders.select("o_orderkey", "o_totalprice", F.expr(
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END").alias("custkey"))


def active(customer):
    return customer.filter("c_acctbal > 0").select("c_custkey", "c_nationkey")


RENAMED = "(SELECT c_custkey AS custkey, c_nationkey AS o_orderkey FROM customer WHERE c_acctbal > 0)"


@query(f"""
SELECT COALESCE(o.custkey, c.custkey) AS custkey, o.o_orderkey AS o_orderkey_x, c.o_orderkey AS o_orderkey_y, o.o_totalprice
FROM {HOLED} o FULL JOIN {RENAMED} c ON o.custkey = c.custkey
""")
def full_join_rows(t):
    right = active(t.customer).select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("o_orderkey"))
    return join_tables(holed(t.orders), right, "custkey", how="full").select("custkey", "o_orderkey_x", "o_orderkey_y", "o_totalprice")


@query("\nUNION ALL\n".join(
    f"SELECT '{how}' AS join_type, COUNT(*) AS row_count, COUNT(o.o_orderkey) AS order_count, "
    f"{'CAST(0 AS BIGINT)' if how in ('left_semi', 'left_anti') else 'COUNT(c.c_nationkey)'} AS customer_count "
    f"FROM {HOLED} o {word} {ACTIVE} c ON o.custkey = c.c_custkey" for how, word in SQL_JOINS.items()))
def join_types(t):
    parts = []
    for how in SQL_JOINS:
        met = join_tables(holed(t.orders), active(t.customer), "custkey", "c_custkey", how)
        right = F.count("c_nationkey") if "c_nationkey" in met.columns else F.lit(0).cast("bigint")
        parts.append(met.agg(F.count("*").alias("row_count"), F.count("o_orderkey").alias("order_count"),
                             right.alias("customer_count")).select(F.lit(how).alias("join_type"), "*"))
    return reduce(DataFrame.unionByName, parts)


@query("""
WITH r AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1),
j AS (SELECT o_totalprice, COALESCE(n, 0) AS n FROM orders LEFT JOIN r ON o_orderkey = l_orderkey)
SELECT (SELECT COUNT(*) FROM orders) AS left_rows, CAST(SUM(n) AS BIGINT) AS joined_rows, MAX(n) AS max_right_copies,
  MAX(n) > 1 AS fans_out, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_before,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)) * n) AS DOUBLE) AS total_after
FROM j
""")
def join_fanout(t):
    return joins.join_report(t.orders, t.lineitem, "o_orderkey", "l_orderkey", "o_totalprice", scale=2).select(
        "left_rows", "joined_rows", "max_right_copies", "fans_out", "total_before", "total_after")


@query(f"""
SELECT COUNT(*) AS left_rows, COUNT(c_custkey) AS matched_rows,
  ROUND(CAST(COUNT(c_custkey) AS DOUBLE) * 100 / CAST(COUNT(*) AS DOUBLE), 2) AS match_pct,
  COUNT(*) FILTER (WHERE custkey IS NULL) AS null_key_rows,
  (SELECT COUNT(*) FROM {ACTIVE} ANTI JOIN {HOLED} ON c_custkey = custkey) AS right_only_keys
FROM {HOLED} LEFT JOIN {ACTIVE} ON custkey = c_custkey
""")
def join_match_rate(t):
    return joins.join_report(holed(t.orders), active(t.customer), "custkey", "c_custkey").select(
        "left_rows", "matched_rows", "match_pct", "null_key_rows", "right_only_keys")


@query(f"SELECT o_orderkey, custkey FROM {HOLED} ANTI JOIN {ACTIVE} ON custkey = c_custkey")
def unmatched_rows(t):
    return joins.unmatched_rows(holed(t.orders), active(t.customer), "custkey", "c_custkey").select(
        "o_orderkey", "custkey")
