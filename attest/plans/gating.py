"""Batches of metric requests judged against facts computed from the tables.

Every event is one request; which one it is follows from its number.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions import text
from attest.functions.vocab import ABSENT_METRICS, DEFAULT_INTENT, TIME_FILTER_WORDS
from attest.operators import gates, overlap, reconcile
from attest.plans.aggregates import LINES, repeated_lines
from attest.plans.cross_table import CLAIMS_SQL, claimed_totals
from attest.plans.profiling import GAPPED, HOLES_TABLE, with_holes, without_august
from attest.plans.registry import query
from attest.plans.texts import ASKED_SQL, INTENT_SQL, MONTH_SQL, asked

FIELD_TYPES = {
    "tables": "array<string>", "metric": "string", "aggregation": "string", "months": "array<int>", "year": "int",
    "is_growth": "boolean", "group_by": "array<string>", "filter_columns": "array<string>", "sort_column": "string",
    "combines": "boolean", "requires_join": "boolean", "join_key": "string", "authoritative_table": "string",
    "intent": "string", "answerable": "boolean", "has_warning": "boolean",
}


def requests_of(t, cases: list[dict]) -> DataFrame:
    """One request per event; the cases are a fixed list of request bodies."""
    names = [n for n in FIELD_TYPES if any(n in case for case in cases)]
    rows = [tuple([i] + [case.get(n) for n in names]) for i, case in enumerate(cases)]
    schema = "case_id bigint, " + ", ".join(f"{n} {FIELD_TYPES[n]}" for n in names)
    listed = t.spark.createDataFrame(rows, schema)
    met = t.events.select(F.col("event_id").alias("request_id"),
                          (F.col("event_id") % len(cases)).alias("case_id")).join(F.broadcast(listed), "case_id")
    for name in names:
        default = gates.REQUEST_DEFAULTS.get(name)
        if default:
            met = met.withColumn(name, F.coalesce(F.col(name), F.expr(default)))
    return met.drop("case_id")


def judged(t, cases, facts, relationships=None, contradictions=None) -> DataFrame:
    return gates.judge(requests_of(t, cases), facts, relationships, contradictions).select(
        "request_id", "verdict", "confidence", "rule", "reason")


def _text(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _texts(values) -> str:
    return "CAST([" + ", ".join(_text(v) for v in values) + "] AS VARCHAR[])"


def _requests_sql(cases: list[dict]) -> str:
    """The request bodies as rows, with the defaults of the gate."""
    rows = []
    for i, case in enumerate(cases):
        given = {"aggregation": "sum", "intent": DEFAULT_INTENT, "answerable": True, **case}
        flags = ", ".join(f"{bool(given.get(n))} AS {n}" for n in ("requires_join", "combines", "answerable"))
        texts = ", ".join(f"CAST({_text(given.get(n))} AS VARCHAR) AS {n}" for n in (
            "metric", "aggregation", "sort_column", "join_key", "authoritative_table", "intent"))
        lists = ", ".join(f"{_texts(given.get(n, []))} AS {n}" for n in ("tables", "group_by", "filter_columns"))
        rows.append(f"SELECT {i} AS case_id, {lists}, {texts}, {flags}")
    return "\nUNION ALL ".join(rows)


NO_PAIRS = "SELECT '' AS table_a, '' AS table_b, '' AS join_key, 0.0 AS best WHERE FALSE"
NO_CLAIMS = "SELECT '' AS table_a, '' AS table_b, '' AS metric, 0.0 AS difference_pct, '' AS column_a, '' AS column_b WHERE FALSE"


def _facts_sql(name: str, source: str, currencies: str = "[]", units: str = "[]") -> str:
    """What the schema of a query, and what further SQL finds in its rows, tells of a table."""
    held = "SELECT list(lower(column_name)){} FROM (DESCRIBE " + source + ")"
    numbers = " FILTER (column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') OR column_type LIKE 'DECIMAL%')"
    return (f"SELECT '{name}' AS name, ({held.format('')}) AS columns, COALESCE(({held.format(numbers)}), []) AS numbers, "
            f"CAST({currencies} AS VARCHAR[]) AS currencies, CAST({units} AS VARCHAR[]) AS units")


DIMENSIONS_SQL = "(VALUES ('kilograms', 'weight'), ('grams', 'weight'), ('millilitres', 'volume'), ('litres', 'volume')) d(unit, dimension)"


def decided(cases: list[dict], facts: list[str], pairs: str = NO_PAIRS, claims: str = NO_CLAIMS) -> str:
    """SQL that resolves the tables of every request and tries the rules, all from the tables themselves."""
    return f"""
WITH f AS ({" UNION ALL ".join(facts)}),
pairs AS ({pairs}), claims AS ({claims}), r AS ({_requests_sql(cases)}),
m AS (SELECT case_id, i, tables[i] AS mention FROM (SELECT case_id, tables, unnest(generate_series(1, len(tables))) AS i FROM r)),
w AS (SELECT case_id, i, mention, COUNT(*) FILTER (name = lower(mention)) AS whole, COUNT(name) AS n, MIN(name) AS part
  FROM m LEFT JOIN f ON contains(name, lower(mention)) GROUP BY ALL),
g AS (SELECT case_id, i, mention, CASE WHEN whole = 1 THEN lower(mention) WHEN whole = 0 AND n = 1 THEN part END AS found FROM w),
s AS (SELECT case_id, list(name ORDER BY i) AS names, list(columns) AS each_columns, flatten(list(columns)) AS columns, flatten(list(numbers)) AS numbers,
    list_sort(list_distinct(flatten(list(currencies)))) AS currencies, list_sort(list_distinct(flatten(list(units)))) AS units
  FROM (SELECT case_id, found, MIN(i) AS i FROM g WHERE found IS NOT NULL GROUP BY ALL) JOIN f ON found = name GROUP BY case_id),
k AS (SELECT case_id, arg_min(join_key, (-best, join_key)) AS found_key FROM s JOIN pairs ON list_contains(names, table_a) AND list_contains(names, table_b) GROUP BY case_id),
c AS (SELECT case_id, arg_min(table_a || ' and ' || table_b || ' differ on ' || c.metric || ' by ' || difference_pct || ' %', (table_a, table_b)) AS claim
  FROM s JOIN r USING (case_id) JOIN claims c ON list_contains(names, lower(table_a)) AND list_contains(names, lower(table_b))
    AND (contains(lower(r.metric), lower(c.metric)) OR lower(r.metric) IN (lower(column_a), lower(column_b)))
    AND COALESCE(lower(authoritative_table) NOT IN (lower(table_a), lower(table_b)), TRUE) GROUP BY case_id),
b AS (SELECT case_id, arg_min(mention, i) AS lost FROM g WHERE found IS NULL GROUP BY case_id),
x AS (SELECT r.*, lower(r.metric) AS wanted, COALESCE(names, []) AS names, COALESCE(columns, []) AS columns, COALESCE(numbers, []) AS numbers,
    COALESCE(each_columns, []) AS each_columns, COALESCE(currencies, []) AS currencies, COALESCE(units, []) AS units, COALESCE(join_key, found_key) AS used_key, claim, lost,
    list_filter(group_by, lambda z: NOT list_contains(COALESCE(columns, []), lower(z))) AS bad_groups,
    list_filter(filter_columns, lambda z: NOT list_contains(COALESCE(columns, []), lower(z)) AND NOT list_contains({_texts(TIME_FILTER_WORDS)}, lower(z))) AS bad_filters,
    list_filter({_texts(ABSENT_METRICS)}, lambda z: contains(lower(r.metric), z) AND len(list_filter(COALESCE(columns, []), lambda y: contains(y, z))) = 0)[1] AS absent,
    (SELECT COUNT(DISTINCT dimension) FROM {DIMENSIONS_SQL} WHERE list_contains(units, unit)) AS dimensions
  FROM r LEFT JOIN s USING (case_id) LEFT JOIN k USING (case_id) LEFT JOIN c USING (case_id) LEFT JOIN b USING (case_id)),
o AS (SELECT case_id, CASE
    WHEN intent <> '{DEFAULT_INTENT}' THEN ['intent', 'questions of kind ' || intent || ' are not answered from records']
    WHEN NOT answerable THEN ['unanswerable', 'the request is marked unanswerable']
    WHEN lost IS NOT NULL THEN ['table', 'there is no table ''' || lost || '''']
    WHEN len(names) = 0 THEN ['table', 'the request names no table']
    WHEN NOT list_contains(columns, wanted) AND aggregation NOT IN ('count', 'count_distinct') AND absent IS NULL THEN ['metric', 'there is no column ''' || metric || '''']
    WHEN NOT list_contains(numbers, wanted) AND aggregation NOT IN ('count', 'count_distinct') AND absent IS NULL
      THEN ['numeric', aggregation || ' needs a number, and ''' || metric || ''' is none']
    WHEN len(bad_groups) > 0 THEN ['group_by', 'there is no column ''' || lower(bad_groups[1]) || ''' to group by']
    WHEN len(bad_filters) > 0 THEN ['filter', 'there is no column ''' || lower(bad_filters[1]) || ''' to filter on']
    WHEN NOT list_contains(columns, lower(sort_column)) THEN ['sort', 'there is no column ''' || sort_column || ''' to sort by']
    WHEN requires_join AND len(names) < 2 THEN ['join', 'a join needs two tables']
    WHEN requires_join AND used_key IS NULL THEN ['join', 'no key relates ' || array_to_string(names, ' and ')]
    WHEN requires_join AND len(list_filter(each_columns, lambda z: NOT list_contains(z, lower(used_key)))) > 0 THEN ['join_key', 'key ''' || used_key || ''' is not in every table']
    WHEN len(currencies) > 1 THEN ['currency', 'the data mixes ' || array_to_string(currencies, ' and ') || ' without a rate']
    WHEN claim IS NOT NULL THEN ['contradiction', claim]
    WHEN combines AND dimensions > 1 THEN ['units', 'units of different kinds: ' || array_to_string(units, ', ')]
    WHEN absent IS NOT NULL THEN ['absent_metric', 'no column is about ''' || absent || ''''] END AS refusal FROM x)
SELECT event_id AS request_id, CASE WHEN refusal IS NULL THEN 'ANSWERED' ELSE 'REFUSED' END AS verdict,
  CASE WHEN refusal IS NULL THEN 'HIGH' ELSE 'LOW' END AS confidence, refusal[1] AS rule, refusal[2] AS reason
FROM events JOIN o ON event_id % {len(cases)} = case_id
"""


# --- currencies -------------------------------------------------------------

CURRENCY_CASES = [
    {"tables": ["sales_usd"], "metric": "revenue"},
    {"tables": ["SALES_INR"], "metric": "revenue", "aggregation": "mean"},
    {"tables": ["sales_usd", "sales_inr"], "metric": "revenue"},
    {"tables": ["several"], "metric": "revenue"},
    {"tables": ["sales_usd", "customer"], "metric": "revenue", "aggregation": "count"},
]
SEVERAL_SQL = "SELECT o_totalprice AS revenue, CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'INR' END AS currency FROM orders"


def _codes_sql(source: str) -> str:
    return f"(SELECT list(DISTINCT upper(trim(currency))) FROM ({source}))"


def _currency_facts() -> list[str]:
    coded = {name: f"SELECT o_orderkey, o_totalprice AS revenue, '{code}' AS currency FROM orders" for name, code in (("sales_usd", "USD"), ("sales_inr", "inr "))}
    coded["several"] = SEVERAL_SQL
    return [_facts_sql(n, q, currencies=_codes_sql(q)) for n, q in coded.items()] + [_facts_sql("customer", "SELECT c_custkey, c_mktsegment FROM customer")]


@query(decided(CURRENCY_CASES, _currency_facts()))
def gate_currency(t):
    sales = t.orders.select("o_orderkey", F.col("o_totalprice").alias("revenue"))
    tables = {
        "sales_usd": sales.withColumn("currency", F.lit("USD")),
        "sales_inr": sales.withColumn("currency", F.lit("inr ")),
        "several": t.orders.select(F.col("o_totalprice").alias("revenue"), F.expr(
            "CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'INR' END").alias("currency")),
        "customer": t.customer.select("c_custkey", "c_mktsegment"),
    }
    return judged(t, CURRENCY_CASES, gates.table_facts(tables, ("currency",)))


# --- contradictions ---------------------------------------------------------

CLAIM_CASES = [
    {"tables": ["orders", "line_copy"], "metric": "revenue"},
    {"tables": ["orders", "line_copy"], "metric": "revenue", "authoritative_table": "Orders"},
    {"tables": ["orders"], "metric": "revenue"},
    {"tables": ["lineitem", "line_copy"], "metric": "revenue"},
    {"tables": ["line_copy", "orders"], "metric": "revenue", "authoritative_table": "customer"},
    {"tables": ["orders", "lineitem"], "metric": "sales_total"},
    {"tables": ["LINEITEM", "Orders"], "metric": "Sales_Total", "aggregation": "mean"},
    {"tables": ["orders", "lineitem"], "metric": "sales_total", "authoritative_table": "lineitem"},
    {"tables": ["lineitem"], "metric": "sales_total"},
    {"tables": ["lineitem", "line_copy"], "metric": "sales_total"},
    {"tables": ["lineitem", "customer"], "metric": "total_sales"},
    {"tables": ["orders", "lineitem"], "metric": "l_quantity"},
    {"tables": ["ine", "orders"], "metric": "sales_total"},
    {"tables": ["line_c", "lineitem", "orders"], "metric": "sales_total"},
]
# Columns of the claims follow from the renamed columns of the tables.
CLAIM_COLUMNS_SQL = "(VALUES ('orders', 'revenue'), ('lineitem', 'sales_total'), ('line_copy', 'revenue'), ('customer', 'total_sales'))"
CLAIM_FACTS = [_facts_sql(name, f"SELECT * RENAME ({old} AS {new}) FROM {base}") for name, base, old, new in (
    ("orders", "orders", "o_totalprice", "revenue"), ("lineitem", "lineitem", "l_extendedprice", "sales_total"),
    ("line_copy", "lineitem", "l_extendedprice", "revenue"), ("customer", "customer", "c_acctbal", "total_sales"))]


@query(decided(CLAIM_CASES, CLAIM_FACTS, claims=f"""
  SELECT c.*, a.col AS column_a, b.col AS column_b FROM ({CLAIMS_SQL}) c
  JOIN {CLAIM_COLUMNS_SQL} a(t, col) ON table_a = a.t JOIN {CLAIM_COLUMNS_SQL} b(t, col) ON table_b = b.t"""))
def gate_contradiction(t):
    tables = {
        "orders": t.orders.withColumnRenamed("o_totalprice", "revenue"),
        "lineitem": t.lineitem.withColumnRenamed("l_extendedprice", "sales_total"),
        "line_copy": t.lineitem.withColumnRenamed("l_extendedprice", "revenue"),
        "customer": t.customer.withColumnRenamed("c_acctbal", "total_sales"),
    }
    return judged(t, CLAIM_CASES, gates.table_facts(tables, ()),
                  contradictions=reconcile.contradictions(claimed_totals(t)))


# --- months -----------------------------------------------------------------

TITLES = "['January','February','March','April','May','June','July','August','September','October','November','December']"


@query(f"""
WITH p AS (SELECT DISTINCT year(order_date) AS y, month(order_date) AS m FROM {GAPPED}),
range AS (SELECT strftime(MIN(order_date), '%Y-%m-%d') AS a, strftime(MAX(order_date), '%Y-%m-%d') AS b FROM {GAPPED}),
r AS (SELECT event_id, event_id % 3 = 0 AS grows, CASE WHEN event_id % 4 = 1 THEN 1994 + event_id % 9 END AS y,
  unnest(CASE WHEN event_id % 3 = 0 THEN [1 + event_id % 12, 1 + (event_id + 1) % 12] ELSE [1 + event_id % 12] END) AS m,
  unnest(CASE WHEN event_id % 3 = 0 THEN [1, 2] ELSE [1] END) AS i FROM events),
g AS (SELECT event_id, grows, arg_min(m, i) FILTER (WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.m = r.m AND (r.y IS NULL OR p.y = r.y))) AS gap
  FROM r GROUP BY event_id, grows)
SELECT event_id AS request_id, CASE WHEN gap IS NULL THEN 'ANSWERED' ELSE 'REFUSED' END AS verdict,
  CASE WHEN gap IS NULL THEN 'HIGH' ELSE 'LOW' END AS confidence, CASE WHEN gap IS NOT NULL THEN 'month' END AS rule,
  CASE WHEN gap IS NULL THEN NULL WHEN grows THEN {TITLES}[gap] || ' is missing, so growth cannot be computed'
  ELSE {TITLES}[gap] || ' is not in gapped, which covers ' || a || ' to ' || b END AS reason
FROM g, range
""")
def gate_missing_month(t):
    n = F.col("event_id")
    first = (F.lit(1) + n % 12).cast("int")
    second = (F.lit(1) + (n + 1) % 12).cast("int")
    grows = n % 3 == 0
    requests = t.events.select(
        n.alias("request_id"), F.array(F.lit("gapped")).alias("tables"), F.lit("o_totalprice").alias("metric"),
        F.when(grows, F.array(first, second)).otherwise(F.array(first)).alias("months"), grows.alias("is_growth"),
        F.when(n % 4 == 1, (F.lit(1994) + n % 9).cast("int")).alias("year"))
    facts = gates.table_facts({"gapped": without_august(t.orders)}, ("dates",))
    return gates.judge(requests, facts).select("request_id", "verdict", "confidence", "rule", "reason")


# --- units ------------------------------------------------------------------

UNIT_CASES = [
    {"tables": ["weights"], "metric": "weight_kg", "combines": True},
    {"tables": ["weights", "volumes"], "metric": "weight_kg", "combines": True},
    {"tables": ["weights", "volumes"], "metric": "weight_kg", "combines": False},
    {"tables": ["weights", "grams"], "metric": "weight_kg", "combines": True},
    {"tables": ["weights", "packs"], "metric": "weight_kg", "combines": True},
]


SUFFIXES_SQL = "(VALUES ('kg', 'kilograms'), ('ml', 'millilitres'), ('g', 'grams'), ('pcs', 'pieces')) u(suffix, unit)"


def _unit_facts() -> list[str]:
    """Units from the ends of values, and of column names."""
    found = []
    for name, column, ending in (("weights", "weight_kg", None), ("volumes", "volume", " ml"), ("grams", "small_weight", "g"), ("packs", "pack", " pcs")):
        value = "p_size" if ending is None else f"p_size || '{ending}'"
        source = f"SELECT p_partkey, {value} AS {column} FROM part"
        ends = (f"SELECT regexp_extract({column}, '[a-z]+$') AS suffix FROM ({source})" if ending
                else f"SELECT regexp_extract(column_name, '_([a-z]+)$', 1) AS suffix FROM (DESCRIBE {source})")
        found.append(_facts_sql(name, source, units=f"COALESCE((SELECT list(DISTINCT unit) FROM ({ends}) JOIN {SUFFIXES_SQL} USING (suffix)), [])"))
    return found


@query(decided(UNIT_CASES, _unit_facts()))
def gate_units(t):
    size = F.col("p_size")
    tables = {
        "weights": t.part.select("p_partkey", size.alias("weight_kg")),
        "volumes": t.part.select("p_partkey", F.concat(size, F.lit(" ml")).alias("volume")),
        "grams": t.part.select("p_partkey", F.concat(size, F.lit("g")).alias("small_weight")),
        "packs": t.part.select("p_partkey", F.concat(size, F.lit(" pcs")).alias("pack")),
    }
    return judged(t, UNIT_CASES, gates.table_facts(tables, ("units",)))


# --- metrics that are not recorded ------------------------------------------

METRIC_CASES = [
    {"tables": ["orders"], "metric": "churn"},
    {"tables": ["orders"], "metric": "customer satisfaction", "aggregation": "mean"},
    {"tables": ["orders"], "metric": "EBITDA margin"},
    {"tables": ["orders"], "metric": "bounce rate", "aggregation": "count"},
    {"tables": ["survey"], "metric": "nps_score", "aggregation": "mean"},
    {"tables": ["orders"], "metric": "o_totalprice"},
]


@query(decided(METRIC_CASES, [_facts_sql("orders", "SELECT * FROM orders"), _facts_sql("survey", "SELECT * RENAME (c_acctbal AS nps_score) FROM customer")]))
def gate_absent_metric(t):
    tables = {"orders": t.orders, "survey": t.customer.withColumnRenamed("c_acctbal", "nps_score")}
    return judged(t, METRIC_CASES, gates.table_facts(tables, ()))


# --- validation -------------------------------------------------------------

VALID = {"tables": ["orders"], "metric": "o_totalprice"}
JOINED = {"tables": ["orders", "customer"], "metric": "o_totalprice", "requires_join": True}
VALIDATION = [
    VALID,
    {**VALID, "intent": "forecast"},
    {**VALID, "answerable": False},
    {**VALID, "tables": ["orders", "returns"]},
    {**VALID, "tables": ["ORD"]},
    {**VALID, "tables": ["er"]},
    {**VALID, "metric": "revenue"},
    {**VALID, "metric": "revenue", "aggregation": "count"},
    {**VALID, "metric": "O_OrderStatus", "aggregation": "median"},
    {**VALID, "group_by": ["o_orderpriority", "region"]},
    {**VALID, "filter_columns": ["Month", "color"]},
    {**VALID, "filter_columns": ["year", "o_orderstatus"], "group_by": ["o_custkey"]},
    {**VALID, "sort_column": "rank"},
    {**JOINED, "tables": ["orders"]},
    JOINED,
    {**JOINED, "tables": ["orders", "part"]},
    {**JOINED, "join_key": "o_custkey"},
    {**VALID, "tables": []},
    {**JOINED, "tables": ["CUST", "orders", "Orders"]},
]
KEYED_ORDERS = "SELECT *, o_custkey AS custkey FROM orders"
KEYED_CUSTOMER = "SELECT * RENAME (c_custkey AS custkey) FROM customer"
VALIDATION_SQL = decided(
    VALIDATION, [_facts_sql("orders", KEYED_ORDERS), _facts_sql("customer", KEYED_CUSTOMER), _facts_sql("part", "SELECT * FROM part")],
    pairs=f"""SELECT 'customer' AS table_a, 'orders' AS table_b, 'custkey' AS join_key, greatest(ROUND(n / na, 3), ROUND(n / nb, 3)) AS best FROM (
      SELECT CAST((SELECT COUNT(DISTINCT custkey) FROM ({KEYED_CUSTOMER}) WHERE custkey IN (SELECT custkey FROM ({KEYED_ORDERS}))) AS DOUBLE) AS n,
        (SELECT COUNT(DISTINCT custkey) FROM ({KEYED_CUSTOMER})) AS na, (SELECT COUNT(DISTINCT custkey) FROM ({KEYED_ORDERS})) AS nb)
      WHERE n / na > 0.5 OR n / nb > 0.5""")


def validated(t):
    return {
        "orders": t.orders.withColumn("custkey", F.col("o_custkey")),
        "customer": t.customer.withColumnRenamed("c_custkey", "custkey"),
        "part": t.part,
    }


@query(VALIDATION_SQL)
def gate_validation(t):
    tables = validated(t)
    return judged(t, VALIDATION, gates.table_facts(tables, ()), overlap.key_overlap(tables))


# What each rule says of the data and of what is needed.
TEXTS_SQL = "(VALUES " + ", ".join(f"('{r}', '{start}', '{issue}', '{needed}')" for r, start, issue, needed in [
    ("intent", "", "the question is not about recorded facts", "a question about recorded facts"),
    ("unanswerable", "", "parameters of the request cannot be met", "other data or another request"),
    ("table", "", "a table is missing", "the table, or its exact name"),
    ("metric", "", "the metric column is missing", "a table with that column"),
    ("numeric", "", "the metric column is not numeric", "a numeric column"),
    ("group_by", "", "a grouping column is missing", "a table with that column"),
    ("filter", "", "a filter column is missing", "a table with that column"),
    ("sort", "", "a sort column is missing", "a column of the tables, or the metric"),
    ("join", "a join", "only one table is in scope", "a second, related table"),
    ("join", "no key", "the tables share no key", "tables with a common key column"),
    ("join_key", "", "the key is missing in a table", "a column that all tables hold"),
]) + ") x(rule, start, issue, needed)"


@query(f"""
SELECT request_id, 'REFUSED' || repeat(chr(10), 2) || 'Reason: ' || reason || repeat(chr(10), 2) || 'Data issue: ' || issue
  || repeat(chr(10), 2) || 'What would be needed: ' || needed AS text
FROM ({VALIDATION_SQL}) v JOIN {TEXTS_SQL} ON v.rule = x.rule AND starts_with(reason, start)
""")
def refusal_texts(t):
    """Every refusal in full: reason, data issue, what is needed."""
    tables = validated(t)
    return gates.refusal_text(gates.judge(requests_of(t, VALIDATION), gates.table_facts(tables, ()), overlap.key_overlap(tables)))


# --- verdicts ---------------------------------------------------------------

VERDICT_CASES = [
    {"tables": ["lines"], "metric": "l_quantity"},
    {"tables": ["lines"], "metric": "l_quantity", "aggregation": "max"},
    {"tables": ["gapped"], "metric": "o_totalprice", "months": [9], "aggregation": "mean"},
    {"tables": ["holes"], "metric": "price", "has_warning": True},
    {"tables": ["gapped"], "metric": "o_totalprice", "months": [7], "year": 1997},
]


@query(f"""
WITH lines AS (SELECT COUNT(*) AS n, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {LINES})) AS dup FROM {LINES}),
pct AS (SELECT n, dup, ROUND(CAST(dup AS DOUBLE) * 100 / CAST(n AS DOUBLE), 2) AS p FROM lines),
holes AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE status IS NULL OR regexp_full_match(status, '\\s*')) AS s,
  COUNT(*) FILTER (WHERE price IS NULL OR isnan(price)) AS p FROM {HOLES_TABLE}),
m AS (SELECT DISTINCT date_trunc('month', order_date) AS m FROM {GAPPED}),
gaps AS (SELECT string_agg(strftime(c, '%Y-%m'), ', ' ORDER BY c) AS g FROM (
  SELECT unnest(generate_series((SELECT MIN(m) FROM m), (SELECT MAX(m) FROM m), INTERVAL 1 MONTH)) AS c) WHERE c NOT IN (SELECT m FROM m)),
years AS (SELECT MIN(year(m)) || ', ' || MAX(year(m)) AS y FROM m), total AS (SELECT COUNT(*) AS n FROM orders),
c AS (
SELECT 0 AS case_id, 'ANSWERED_WITH_ASSUMPTIONS' AS verdict, 'MEDIUM' AS confidence, dup || ' duplicate rows are left out' AS assumptions,
  '[lines] ' || dup || ' duplicate rows (' || p || ' %)' AS advisories,
  '{{"tables":["lines"],"rows":[' || n || '],"aggregation":"sum","metric":"l_quantity","filter_columns":[],"columns":["l_quantity"]}}' AS evidence FROM pct
UNION ALL SELECT 1, 'ANSWERED', 'HIGH', '', '[lines] ' || dup || ' duplicate rows (' || p || ' %)',
  '{{"tables":["lines"],"rows":[' || n || '],"aggregation":"max","metric":"l_quantity","filter_columns":[],"columns":["l_quantity"]}}' FROM pct
UNION ALL SELECT 2, 'ANSWERED', 'HIGH', 'September is read as calendar month 9; all years of the data are used, ' || y, '[gapped] order_date lacks ' || g,
  '{{"tables":["gapped"],"rows":[' || n || '],"aggregation":"mean","metric":"o_totalprice","filter_columns":[],"columns":["o_totalprice"]}}' FROM gaps, years, total
UNION ALL SELECT 3, 'ANSWERED_WITH_ASSUMPTIONS', 'MEDIUM', '', '[holes] missing values in note: ' || n || ', price: ' || p || ', status: ' || s,
  '{{"tables":["holes"],"rows":[' || n || '],"aggregation":"sum","metric":"price","filter_columns":[],"columns":["price"]}}' FROM holes
UNION ALL SELECT 4, 'ANSWERED', 'HIGH', 'July is read as calendar month 7', '[gapped] order_date lacks ' || g,
  '{{"tables":["gapped"],"rows":[' || n || '],"aggregation":"sum","metric":"o_totalprice","filter_columns":[],"columns":["o_totalprice"]}}' FROM gaps, total)
SELECT event_id AS request_id, verdict, confidence, assumptions, advisories, evidence FROM events JOIN c ON event_id % 5 = case_id
""")
def gate_verdicts(t):
    tables = {"lines": repeated_lines(t.lineitem), "gapped": without_august(t.orders), "holes": with_holes(t.orders)}
    verdicts = gates.judge(requests_of(t, VERDICT_CASES), gates.table_facts(tables))
    return verdicts.select("request_id", "verdict", "confidence", F.array_join("assumptions", "; ").alias("assumptions"),
                           F.array_join("advisories", "; ").alias("advisories"), "evidence")


@query(f"""
SELECT conv_id, turn, verdict, rule FROM (
  SELECT conv_id, turn, {INTENT_SQL} AS intent, {MONTH_SQL} AS month,
    CASE WHEN intent <> 'historical_analytics' THEN 'intent' WHEN month = 8 THEN 'month' END AS rule,
    CASE WHEN intent <> 'historical_analytics' OR month = 8 THEN 'REFUSED' ELSE 'ANSWERED' END AS verdict FROM {ASKED_SQL})
""")
def gate_questions(t):
    """Question texts labelled, turned into requests, and judged."""
    question = F.col("question")
    month = text.month_mention(question)
    requests = asked(t).select(
        F.struct("conv_id", "turn").alias("request_id"), F.array(F.lit("gapped")).alias("tables"),
        F.lit("o_totalprice").alias("metric"), text.intent_label(question).alias("intent"),
        F.array_compact(F.array(month)).alias("months"))
    facts = gates.table_facts({"gapped": without_august(t.orders)}, ("dates",))
    return gates.judge(requests, facts).select("request_id.conv_id", "request_id.turn", "verdict", "rule")
