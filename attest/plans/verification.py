"""Comparison of results, reruns, sanity flags."""

from pyspark.sql import functions as F

from attest.operators import reconcile
from attest.plans.registry import query

CHANGED = """CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 50 = 1 THEN o_totalprice * (1 + 1e-8)
  ELSE o_totalprice END"""
SIDES_SQL = f"""
a AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 31 <> 0),
b AS (SELECT CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey END AS k, {CHANGED} AS price,
  CASE WHEN o_orderkey % 41 = 0 THEN 'x' ELSE ' ' || o_orderpriority || ' ' END AS priority FROM orders),
f AS (SELECT k, MAX(price) AS price, MAX(priority) AS priority, COUNT(*) AS n FROM b GROUP BY k),
m AS (SELECT COALESCE(a.k, f.k) AS k, a.price AS left_price, f.price AS right_price, a.priority AS left_priority,
  f.priority AS right_priority, a.k IS NOT NULL AS in_a, f.n IS NOT NULL AS in_f, COALESCE(f.n, 0) AS n,
  a.price IS NOT NULL AND f.price IS NOT NULL
    AND abs(a.price - f.price) <= greatest(1e-6 * greatest(abs(a.price), abs(f.price)), 1e-9) AS same_price,
  trim(a.priority) = trim(f.priority) AS same_priority FROM a FULL JOIN f ON a.k = f.k),
s AS (SELECT k, CASE WHEN n > 1 THEN 'repeated_key' WHEN NOT in_f THEN 'only_left' WHEN NOT in_a THEN 'only_right'
  WHEN NOT same_price OR NOT same_priority THEN 'differs' ELSE 'match' END AS status,
  CASE WHEN NOT same_price THEN 'price' WHEN NOT same_priority THEN 'priority' END AS first_difference,
  left_price, right_price FROM m)
"""


def two_sides(t):
    """Two results over all orders: with missing keys, repeated NULL keys, changed and near-equal values."""
    left = t.orders.filter("o_orderkey % 31 <> 0").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    right = t.orders.select(
        F.expr("CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey END").alias("k"), F.expr(CHANGED).alias("price"),
        F.expr("CASE WHEN o_orderkey % 41 = 0 THEN 'x' ELSE concat(' ', o_orderpriority, ' ') END").alias("priority"))
    return reconcile.compare_results(left, right, ["k"], ["price", "priority"])


@query(f"""WITH {SIDES_SQL} SELECT k, status, CASE WHEN status = 'differs' THEN first_difference END AS first_difference FROM s""")
def reconcile_results(t):
    return two_sides(t).select("k", "status", "first_difference")


@query(f"""WITH {SIDES_SQL} SELECT k, left_price, right_price, first_difference FROM s WHERE status = 'differs'""")
def mismatch_report(t):
    return reconcile.mismatches(two_sides(t)).filter("status = 'differs'").select(
        "k", "left_price", "right_price", "first_difference")


@query(f"""
WITH {SIDES_SQL} SELECT COUNT(*) AS key_count, COUNT(*) FILTER (WHERE status = 'match') AS match,
  COUNT(*) FILTER (WHERE status = 'differs') AS differs, COUNT(*) FILTER (WHERE status = 'only_left') AS only_left,
  COUNT(*) FILTER (WHERE status = 'only_right') AS only_right, COUNT(*) FILTER (WHERE status = 'repeated_key') AS repeated_key,
  FALSE AS agrees FROM s
""")
def reconcile_summary(t):
    return reconcile.summary(two_sides(t))


@query("""
SELECT COUNT(DISTINCT l_partkey) AS key_count, COUNT(DISTINCT l_partkey) AS match, CAST(0 AS BIGINT) AS differs,
  CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, CAST(0 AS BIGINT) AS repeated_key, TRUE AS agrees FROM lineitem
""")
def rerun_match(t):
    """Sums of doubles differ in their last bits from run to run; within tolerance they agree."""
    def total(df):
        return df.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("value"))

    return reconcile.summary(reconcile.rerun(
        total, t.lineitem, ["l_partkey", "l_extendedprice"], ["l_partkey"], ["value"]))


@query("""
WITH a AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position, o_orderkey FROM orders),
b AS (SELECT row_number() OVER (ORDER BY price, o_orderkey) AS position, o_orderkey
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 20 ELSE o_totalprice END AS price FROM orders
        WHERE o_orderstatus <> 'F' OR o_orderkey % 5 <> 0))
SELECT position, a.o_orderkey AS left_o_orderkey, b.o_orderkey AS right_o_orderkey,
  CASE WHEN b.o_orderkey IS NULL THEN 'only_left' WHEN a.o_orderkey = b.o_orderkey THEN 'match' ELSE 'differs' END AS status
FROM a LEFT JOIN b USING (position)
""")
def ordered_compare(t):
    left = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"))
    right = t.orders.filter("o_orderstatus <> 'F' OR o_orderkey % 5 <> 0").select("o_orderkey", F.expr(
        "CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 20 ELSE o_totalprice END").alias("price"))
    order = ["price", "o_orderkey"]
    return reconcile.compare_ordered(left, right, order, order, ["o_orderkey"]).drop("first_difference")


ODD = """CASE WHEN c_nationkey % 6 = 0 THEN {nan} WHEN c_nationkey % 6 = 1 THEN {inf} WHEN c_nationkey % 6 = 2 THEN -v
  WHEN c_nationkey % 6 = 3 THEN NULL ELSE v END"""


@query(f"""
WITH g AS (SELECT c_nationkey, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) FILTER (WHERE c_mktsegment = 'BUILDING') AS DOUBLE) AS v,
  COUNT(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS rows_used FROM customer GROUP BY 1),
o AS (SELECT c_nationkey, {ODD.format(nan="CAST('nan' AS DOUBLE)", inf="CAST('inf' AS DOUBLE)")} AS value, rows_used FROM g)
SELECT c_nationkey, value, rows_used, COALESCE(isnan(value) OR isinf(value), FALSE) AS is_not_finite, value IS NULL AS is_missing,
  COALESCE(value <= 0 AND NOT isnan(value) AND NOT isinf(value), FALSE) AS is_not_positive, rows_used = 0 AS is_empty_filter FROM o
""")
def sanity_flags(t):
    used = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal").cast("decimal(18,2)"))
    grouped = t.customer.groupBy("c_nationkey").agg(
        F.sum(used).cast("double").alias("v"), F.count(used).alias("rows_used"))
    result = grouped.select("c_nationkey", F.expr(ODD.format(nan="double('NaN')", inf="double('Infinity')")).alias("value"),
                            "rows_used")
    return reconcile.sanity_flags(result)


@query("""
SELECT 'Brand#' || (n_nationkey * 2) AS wanted FROM nation
WHERE 'Brand#' || (n_nationkey * 2) NOT IN (SELECT p_brand FROM part)
""")
def unknown_literals(t):
    wanted = t.nation.select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") * 2).cast("string")).alias("wanted"))
    return reconcile.unknown_literals(t.part, "p_brand", wanted)


# Values that no ordinary result holds, by key: not a number, infinities, near and written numbers.
ODD_SIDES = {
    "left_number": "CASE o_orderkey % 8 WHEN 0 THEN {nan} WHEN 1 THEN {inf} WHEN 2 THEN {inf} WHEN 3 THEN {nan} WHEN 4 THEN NULL WHEN 5 THEN o_totalprice ELSE 0.0 END",
    "right_number": "CASE o_orderkey % 8 WHEN 0 THEN {nan} WHEN 1 THEN {inf} WHEN 2 THEN -{inf} WHEN 3 THEN o_totalprice WHEN 4 THEN {nan} WHEN 5 THEN o_totalprice * (1 + 1e-9) WHEN 6 THEN 1e-10 ELSE 1e-3 END",
    "left_text": "CASE o_orderkey % 5 WHEN 0 THEN '1.0' WHEN 1 THEN ' 2e3' WHEN 2 THEN o_orderstatus WHEN 3 THEN '7' ELSE NULL END",
    "right_text": "CASE o_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2000 ' WHEN 2 THEN ' ' || o_orderstatus WHEN 3 THEN 'seven' ELSE NULL END",
}
DUCK = {"nan": "CAST('NaN' AS DOUBLE)", "inf": "CAST('Infinity' AS DOUBLE)"}
SPARK = {"nan": "double('NaN')", "inf": "double('Infinity')"}


@query(f"""
WITH v AS (SELECT o_orderkey AS k, {", ".join(f"{e.format(**DUCK)} AS {n}" for n, e in ODD_SIDES.items())} FROM orders),
n AS (SELECT *, TRY_CAST(trim(left_text) AS DOUBLE) AS a, TRY_CAST(trim(right_text) AS DOUBLE) AS b FROM v),
s AS (SELECT k, left_number IS NOT DISTINCT FROM right_number OR COALESCE(isfinite(left_number) AND isfinite(right_number)
    AND abs(left_number - right_number) <= greatest(1e-6 * greatest(abs(left_number), abs(right_number)), 1e-9), FALSE) AS same_number,
  trim(left_text) IS NOT DISTINCT FROM trim(right_text) OR COALESCE(abs(a - b) <= greatest(1e-6 * greatest(abs(a), abs(b)), 1e-9), FALSE) AS same_text FROM n)
SELECT k, CASE WHEN same_number AND same_text THEN 'match' ELSE 'differs' END AS status,
  CASE WHEN NOT same_number THEN 'number' WHEN NOT same_text THEN 'text' END AS first_difference FROM s
""")
def special_values(t):
    """Results with NaN, infinities and numbers written as text, compared by key."""
    def side(name):
        return t.orders.select(F.col("o_orderkey").alias("k"), *[F.expr(ODD_SIDES[f"{name}_{c}"].format(**SPARK)).alias(c) for c in ("number", "text")])

    return reconcile.compare_results(side("left"), side("right"), ["k"], ["number", "text"]).select("k", "status", "first_difference")
