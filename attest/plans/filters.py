"""Row conditions and calendar filters over whole tables."""

from pyspark.sql import functions as F

from attest.functions.dates import TimeRange
from attest.functions.values import type_of
from attest.operators.filters import Condition, apply_conditions
from attest.plans.registry import query

MARKED_PRIORITY = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END"


def marked(orders):
    """Orders with a priority that is missing on some rows."""
    return orders.select("o_orderkey", "o_custkey", F.expr(MARKED_PRIORITY).alias("priority"))


MARKED = f"(SELECT o_orderkey, o_custkey, {MARKED_PRIORITY} AS priority FROM orders)"


def kept(df, *conditions):
    return apply_conditions(df, conditions)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_eq_ci(t):
    return kept(t.customer, Condition("c_mktsegment", "=", "Building")).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 7")
def filter_eq_num(t):
    return kept(t.part, Condition("p_size", "=", 7)).select("p_partkey", "p_size")


@query(f"SELECT o_orderkey, priority FROM {MARKED} WHERE priority IS DISTINCT FROM '5-LOW'")
def filter_neq_keeps_null(t):
    return kept(marked(t.orders), Condition("priority", "!=", "5-LOW")).select("o_orderkey", "priority")


@query("""
SELECT o_orderkey, price FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN CAST('nan' AS DOUBLE) ELSE o_totalprice END AS price FROM orders)
WHERE NOT isnan(price) AND price > 100000 AND price <= 300000 AND o_orderkey >= 10 AND o_orderkey < 14000
""")
def filter_range_ops(t):
    """NaN counts as missing and passes no comparison."""
    orders = t.orders.select("o_orderkey", F.expr(
        "CASE WHEN o_orderkey % 9 = 0 THEN double('NaN') ELSE o_totalprice END").alias("price"))
    return kept(orders, Condition("price", ">", 100000), Condition("price", "<=", 300000),
                Condition("o_orderkey", ">=", 10), Condition("o_orderkey", "<", 14000))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_in(t):
    return kept(t.orders, Condition("o_orderstatus", "in", ["F", "P"])).select("o_orderkey", "o_orderstatus")


@query(f"SELECT o_orderkey, priority FROM {MARKED} WHERE priority IS NULL OR priority NOT IN ('5-LOW', '1-URGENT')")
def filter_not_in(t):
    return kept(marked(t.orders), Condition("priority", "not_in", ["5-LOW", "1-URGENT"])).select(
        "o_orderkey", "priority")


@query("""
SELECT o_orderkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def filter_in_table(t):
    listed = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return kept(t.orders, Condition("o_custkey", "in", listed)).select("o_orderkey")


@query("""
SELECT o_orderkey, custkey FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS custkey FROM orders)
WHERE custkey IS NULL OR custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""")
def filter_not_in_table(t):
    orders = t.orders.select("o_orderkey", F.expr(
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END").alias("custkey"))
    listed = t.customer.filter("c_acctbal > 0").select("c_custkey")
    return kept(orders, Condition("custkey", "not_in", listed))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'r(ing|od)$', 'i')")
def filter_contains_regex(t):
    return kept(t.part, Condition("p_name", "contains", "R(ing|od)$")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand FROM part WHERE contains(lower(p_brand), 'd#1')")
def filter_contains_literal(t):
    return kept(t.part, Condition("p_brand", "contains", "D#1", literal=True)).select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 AND 1000")
def filter_between(t):
    return kept(t.part, Condition("p_retailprice", "between", (950, 1000))).select("p_partkey", "p_retailprice")


def in_time(orders, **fields):
    date = F.col("o_orderdate")
    return orders.filter(TimeRange(**fields).condition(date, type_of(orders, "o_orderdate"))).select(
        "o_orderkey", F.date_format(date, "yyyy-MM-dd").alias("order_date"))


DATED = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders WHERE "


@query(DATED + "month(o_orderdate) = 2")
def filter_month(t):
    return in_time(t.orders, month=2)


@query(DATED + "year(o_orderdate) = 1997")
def filter_year(t):
    return in_time(t.orders, year=1997)


@query(DATED + "quarter(o_orderdate) = 3 AND year(o_orderdate) = 1999")
def filter_quarter(t):
    return in_time(t.orders, quarter=3, year=1999)


@query(DATED + "o_orderdate >= '1996-03-15' AND o_orderdate <= '1996-09-01'")
def filter_date_range(t):
    return in_time(t.orders, start="1996-03-15", end="1996-09-01")


@query(DATED + "o_orderdate >= '2001-06-30'")
def filter_date_open_range(t):
    return in_time(t.orders, start="2001-06-30")


@query(DATED + "CAST(o_orderdate AS DATE) = DATE '1998-10-03'")
def filter_single_date(t):
    return in_time(t.orders, day="1998-10-03")


@query(DATED + "month(o_orderdate - INTERVAL 3 MONTH) = 1 AND year(o_orderdate - INTERVAL 3 MONTH) = 1998")
def filter_fiscal_month(t):
    return in_time(t.orders, month=1, year=1998, fiscal_offset=3)
