"""Profiles over whole tables: columns, missing values, keys, tables, dates, currencies, units."""

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.dates import month_text
from attest.operators import coverage, keys, money_units, profile
from attest.operators.median import median_by
from attest.plans.aggregates import LINES, repeated_lines
from attest.plans.registry import query

# --- columns ----------------------------------------------------------------

ORDER_COLUMNS = [
    ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
    ("o_orderstatus", "string", "categorical"), ("o_totalprice", "double", "numeric"),
    ("o_orderdate", "timestamp_ntz", "temporal"), ("o_orderpriority", "string", "categorical"),
]


def _column_sql(name: str, position: int, kind: str, group: str) -> str:
    numeric = group == "numeric"
    summed = f"CAST({name} AS DECIMAL(18,2))" if kind == "double" else name
    low, high = (f"CAST(MIN({name}) AS DOUBLE)", f"CAST(MAX({name}) AS DOUBLE)") if numeric else ("NULL", "NULL")
    mean = f"CAST(SUM({summed}) AS DOUBLE) / CAST(COUNT({name}) AS DOUBLE)" if numeric else "NULL"
    blank = f" OR regexp_full_match({name}, '\\s*')" if kind == "string" else ""
    missing = f"COUNT(*) FILTER (WHERE {name} IS NULL{blank})"
    return f"""SELECT 'orders' AS table_name, '{name}' AS column_name, {position} AS position,
  '{kind}' AS data_type, '{group}' AS column_class, COUNT(*) AS row_count, {missing} AS missing_count,
  ROUND(CAST({missing} AS DOUBLE) * 100 / CAST(COUNT(*) AS DOUBLE), 2) AS missing_pct,
  COUNT(DISTINCT {name}) AS distinct_count, CAST({low} AS DOUBLE) AS min_value,
  CAST({high} AS DOUBLE) AS max_value, CAST({mean} AS DOUBLE) AS mean_value FROM orders"""


@query("\nUNION ALL\n".join(_column_sql(n, i + 1, k, g) for i, (n, k, g) in enumerate(ORDER_COLUMNS)))
def column_profile_orders(t):
    return profile.column_profile(t.orders, "orders", distinct="exact", scale=2)


@query()
def column_profile_screen(t):
    """Approximate distinct counts, one scan per table: the screening profile of all tables."""
    tables = t.named("lineitem", "orders", "customer", "part", "supplier", "events", "documents")
    return reduce(DataFrame.unionByName,
                  [profile.column_profile(df, name, scale=2) for name, df in tables.items()])


BOUNDED = ["orders", "customer", "part", "supplier", "nation"]


@query("\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, column_name, distinct_count, TRUE AS within "
    f"FROM (UNPIVOT (SELECT COUNT(DISTINCT COLUMNS(*)) FROM {n}) ON COLUMNS(*) INTO NAME column_name VALUE distinct_count)" for n in BOUNDED))
def column_profile_bounds(t):
    """Exact distinct counts, and whether each lies in the interval of its estimate."""
    parts = []
    for name, df in t.named(*BOUNDED).items():
        exact = profile.distinct_counts(df, df.columns)
        bounds = profile.distinct_bounds(df, name)
        # a row for each column
        parts.append(bounds.join(F.broadcast(exact), "column_name").select(
            "table_name", "column_name", "distinct_count", F.col("distinct_count").between(F.col("low"), F.col("high")).alias("within")))
    return reduce(DataFrame.unionByName, parts)


QUANTILES = [("lineitem", "l_extendedprice"), ("lineitem", "l_quantity")]


@query("\nUNION ALL\n".join(
    f"SELECT '{table}' AS table_name, '{column}' AS column_name, CAST({p} AS DOUBLE) AS probability, "
    f"quantile_cont({column}, {p}) AS quantile_value FROM {table}"
    for table, column in QUANTILES for p in (0.25, 0.5, 0.75)))
def column_quantiles(t):
    return profile.column_quantiles(t.lineitem, "lineitem", [c for _, c in QUANTILES])


def _keys_sql(table: str, columns: list[tuple[str, bool, bool]]) -> str:
    parts = []
    for name, numeric, named in columns:
        unique = f"COUNT(DISTINCT {name}) = COUNT(*)"
        rule = f"{'TRUE' if named else 'FALSE'} AND {unique}" if numeric else f"{'TRUE' if named else 'FALSE'} OR {unique}"
        parts.append(f"SELECT '{table}' AS table_name, '{name}' AS column_name, ({rule}) AS is_id_candidate, "
                     f"(({rule}) AND {unique}) AS is_pk_candidate FROM {table}")
    return "\nUNION ALL\n".join(parts)


@query(_keys_sql("orders", [("o_orderkey", True, True), ("o_custkey", True, True), ("o_orderstatus", False, False),
                            ("o_totalprice", True, False), ("o_orderdate", False, False),
                            ("o_orderpriority", False, False)])
       + "\nUNION ALL\n"
       + _keys_sql("customer", [("c_custkey", True, True), ("c_name", False, False), ("c_nationkey", True, True),
                                ("c_acctbal", True, False), ("c_mktsegment", False, False)]))
def id_and_pk_candidates(t):
    return profile.id_candidates(t.orders, "orders").unionByName(profile.id_candidates(t.customer, "customer"))


@query("""
SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1
""")
def composite_key_repeats(t):
    return profile.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


KEYED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
}


def _sets_sql(table: str, columns: list[str]) -> str:
    """Every set of up to three columns, and whether it is unique."""
    sets = [s for n in (1, 2, 3) for s in combinations(columns, n)]
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS t, {list(s)} AS s, COUNT(DISTINCT ({', '.join(s)})) = COUNT(*) AND COUNT(*) > 0 AS is_key FROM {table}" for s in sets)


@query(f"""
WITH sets AS ({" UNION ALL ".join(_sets_sql(n, c) for n, c in KEYED.items())}), k AS (SELECT t, s FROM sets WHERE is_key)
SELECT t AS table_name, array_to_string(s, ',') AS key_columns, CAST(len(s) AS INTEGER) AS column_count
FROM k WHERE NOT EXISTS (SELECT 1 FROM k z WHERE z.t = k.t AND len(z.s) < len(k.s) AND list_has_all(k.s, z.s))
""")
def minimal_keys(t):
    return reduce(DataFrame.unionByName, [keys.minimal_keys(df, name) for name, df in t.named(*KEYED).items()])


# --- missing values ---------------------------------------------------------

HOLES = {
    "o_orderkey": "o_orderkey",
    "status": "CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN ' ' ELSE o_orderstatus END",
    "price": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN CAST('NaN' AS DOUBLE) "
             "ELSE o_totalprice END",
    "note": "CAST(NULL AS {text})",
}


def with_holes(orders):
    """Orders with NULL, NaN, blank text and an empty column."""
    return orders.select(*[F.expr(e.format(text="string")).alias(n) for n, e in HOLES.items()])


HOLES_TABLE = "(SELECT " + ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in HOLES.items()) + " FROM orders)"
MISSING_TESTS = {
    "o_orderkey": ("bigint", "o_orderkey IS NULL"),
    "status": ("string", "status IS NULL OR regexp_full_match(status, '\\s*')"),
    "price": ("double", "price IS NULL OR isnan(price)"),
    "note": ("string", "note IS NULL OR regexp_full_match(note, '\\s*')"),
}
MISSING_SQL = "\nUNION ALL\n".join(
    f"SELECT 'holes' AS table_name, '{n}' AS column_name, '{k}' AS data_type, COUNT(*) AS row_count, "
    f"COUNT(*) FILTER (WHERE {test}) AS missing_count, "
    f"ROUND(CAST(COUNT(*) FILTER (WHERE {test}) AS DOUBLE) * 100 / CAST(COUNT(*) AS DOUBLE), 2) AS missing_pct "
    f"FROM {HOLES_TABLE}"
    for n, (k, test) in MISSING_TESTS.items())


@query(MISSING_SQL)
def missing_profile(t):
    return profile.missing_profile(with_holes(t.orders), "holes")


@query(f"""
SELECT table_name, string_agg(CASE WHEN missing_count > 0 THEN column_name END, ',' ORDER BY column_name) AS columns_with_missing,
  string_agg(CASE WHEN missing_count = row_count THEN column_name END, ',' ORDER BY column_name) AS empty_columns,
  CAST(SUM(missing_count) AS BIGINT) AS total_missing
FROM ({MISSING_SQL}) GROUP BY table_name
""")
def missing_summary(t):
    return profile.missing_summary(profile.missing_profile(with_holes(t.orders), "holes"))


# --- tables -----------------------------------------------------------------

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
STAR_COLUMNS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11}


@query("SELECT COUNT(*) AS table_count, " + ", ".join(
    f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in ("row_count", "column_count", "duplicate_count", "missing_cells"))
    + " FROM (" + "\nUNION ALL\n".join(
        f"SELECT COUNT(*) AS row_count, {STAR_COLUMNS[n]} AS column_count, "
        f"COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {n})) AS duplicate_count, 0 AS missing_cells FROM {n}"
        for n in STAR) + ")")
def portfolio_totals(t):
    return profile.portfolio_totals(profile.table_profiles(t.named(*STAR)))


AUGUST_MOVED = "CASE WHEN month(o_orderdate) = 8 THEN o_orderdate + INTERVAL 1 MONTH ELSE o_orderdate END"


def without_august(orders):
    """Orders of August moved to September, so the calendar has gaps."""
    return orders.select("o_orderkey", "o_custkey", "o_totalprice", F.expr(AUGUST_MOVED).alias("order_date"))


GAPPED = f"(SELECT o_orderkey, o_custkey, o_totalprice, {AUGUST_MOVED} AS order_date FROM orders)"


@query(f"""
WITH holes AS (SELECT SUM(m) AS cells, COUNT(*) AS n, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {HOLES_TABLE})) AS dup
  FROM (SELECT 1 + (CASE WHEN status IS NULL OR regexp_full_match(status, '\\s*') THEN 1 ELSE 0 END)
    + (CASE WHEN price IS NULL OR isnan(price) THEN 1 ELSE 0 END) AS m FROM {HOLES_TABLE})),
lines AS (SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {LINES})) AS dup FROM {LINES}),
gaps AS (SELECT datediff('month', MIN(order_date), MAX(order_date)) + 1
  - COUNT(DISTINCT date_trunc('month', order_date)) AS g FROM {GAPPED})
SELECT 'customer' AS table_name, 'clean' AS health
UNION ALL SELECT 'orders', 'clean'
UNION ALL SELECT 'holes', CASE WHEN dup > 0 THEN dup || ' duplicate rows; ' ELSE '' END || CAST(cells AS BIGINT) || ' missing values' FROM holes
UNION ALL SELECT 'lines', dup || ' duplicate rows' FROM lines
UNION ALL SELECT 'gapped', g || ' missing months' FROM gaps
""")
def table_health(t):
    tables = {**t.named("customer", "orders"), "holes": with_holes(t.orders),
              "lines": repeated_lines(t.lineitem), "gapped": without_august(t.orders)}
    return profile.table_health(profile.table_profiles(tables))


# --- dates ------------------------------------------------------------------

MIXED_SPARK = """CASE o_orderkey % 5
  WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy')
  WHEN 2 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 3 THEN concat('ORD-', o_orderkey)
  ELSE date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss") END"""
MIXED_SQL = """CASE o_orderkey % 5
  WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN 'ORD-' || o_orderkey
  ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END"""
UNSURE = "o_orderkey % 5 = 1 AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)"


def mixed_dates(orders):
    """Dates as texts of four formats, and one text in five that is no date."""
    return orders.select(F.expr(MIXED_SPARK).alias("placed"), "o_orderstatus")


@query(f"""
WITH d AS (SELECT {MIXED_SQL} AS placed, o_orderkey, o_orderdate FROM orders)
SELECT 'mixed' AS table_name, 'placed' AS column_name,
  CAST(COUNT(*) FILTER (WHERE o_orderkey % 5 <> 3) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS parse_ratio, TRUE AS is_date,
  strftime(MIN(o_orderdate) FILTER (WHERE o_orderkey % 5 <> 3), '%Y-%m-%d') AS min_date,
  strftime(MAX(o_orderdate) FILTER (WHERE o_orderkey % 5 <> 3), '%Y-%m-%d') AS max_date,
  COUNT(DISTINCT date_trunc('month', o_orderdate)) FILTER (WHERE o_orderkey % 5 <> 3) AS month_count,
  COUNT(*) FILTER (WHERE {UNSURE}) AS ambiguous_count, MIN(placed) FILTER (WHERE {UNSURE}) AS ambiguous_example FROM d
UNION ALL SELECT 'mixed', 'o_orderstatus', 0.0, FALSE, NULL, NULL, 0, 0, NULL
""")
def date_parse_ratio(t):
    return coverage.date_profile(mixed_dates(t.orders), "mixed").select(
        "table_name", "column_name", "parse_ratio", "is_date",
        F.date_format("min_date", "yyyy-MM-dd").alias("min_date"),
        F.date_format("max_date", "yyyy-MM-dd").alias("max_date"),
        F.size("months").cast("bigint").alias("month_count"), "ambiguous_count", "ambiguous_example")


RANGES = [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]


@query("\nUNION ALL\n".join(f"""
SELECT '{table}' AS table_name, '{column}' AS column_name, strftime(MIN({column}), '%Y-%m-%d') AS min_date,
  strftime(MAX({column}), '%Y-%m-%d') AS max_date,
  string_agg(DISTINCT strftime({column}, '%Y-%m'), ',' ORDER BY strftime({column}, '%Y-%m')) AS present_months,
  '' AS missing_months FROM {table}""" for table, column in RANGES))
def date_ranges(t):
    found = [coverage.date_columns(coverage.date_profile(df, name))
             for name, df in t.named("orders", "lineitem", "events").items()]
    return reduce(DataFrame.unionByName, found).select(
        "table_name", "column_name", F.date_format("min_date", "yyyy-MM-dd").alias("min_date"),
        F.date_format("max_date", "yyyy-MM-dd").alias("max_date"),
        F.array_join("present_months", ",").alias("present_months"),
        F.array_join("missing_months", ",").alias("missing_months"))


@query(f"""
SELECT COUNT(placed) AS value_count, COUNT(*) FILTER (WHERE {UNSURE}) AS ambiguous_count,
  MIN(placed) FILTER (WHERE {UNSURE}) AS example
FROM (SELECT {MIXED_SQL} AS placed, o_orderkey, o_orderdate FROM orders)
""")
def ambiguous_dates(t):
    return coverage.ambiguous_dates(mixed_dates(t.orders), "placed")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS row_count FROM orders GROUP BY 1")
def present_months(t):
    return coverage.present_months(t.orders, "o_orderdate")


@query(f"""
WITH p AS (SELECT DISTINCT date_trunc('month', order_date) AS m FROM {GAPPED}),
c AS (SELECT unnest(generate_series((SELECT MIN(m) FROM p), (SELECT MAX(m) FROM p), INTERVAL 1 MONTH)) AS m)
SELECT strftime(m, '%Y-%m') AS month FROM c ANTI JOIN p USING (m)
""")
def missing_months(t):
    return coverage.missing_months(without_august(t.orders), "order_date")


@query("""
WITH p AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m FROM orders),
c AS (SELECT o_custkey, unnest(generate_series(MIN(m), MAX(m), INTERVAL 1 MONTH)) AS m FROM p GROUP BY o_custkey)
SELECT o_custkey, strftime(m, '%Y-%m') AS month FROM c ANTI JOIN p USING (o_custkey, m)
""")
def missing_months_by_customer(t):
    return coverage.missing_months(t.orders, "o_orderdate", ["o_custkey"])


# --- currencies and units ---------------------------------------------------

PRICE_TEXT = """CASE o_orderkey % 9 WHEN 0 THEN concat('$', o_orderkey) WHEN 1 THEN concat('₹ ', o_orderkey)
  WHEN 2 THEN concat('€', o_orderkey) WHEN 3 THEN concat('£', o_orderkey) WHEN 4 THEN concat('¥', o_orderkey)
  WHEN 5 THEN concat('A$', o_orderkey) WHEN 6 THEN concat('C$', o_orderkey)
  WHEN 7 THEN concat('$', o_orderkey, ' or €', o_orderkey) ELSE concat('', o_orderkey) END"""
SYMBOL_TESTS = {"USD": r"(^|[^AC])\$", "INR": "₹", "EUR": "€", "GBP": "£", "JPY": "¥", "AUD": r"A\$", "CAD": r"C\$"}


def _symbol_sql(table: str, column: str, source: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{code}' AS currency, 'symbol' AS origin, "
        f"COUNT(*) AS row_count FROM {source} WHERE regexp_matches({column}, '{test}') HAVING COUNT(*) > 0"
        for code, test in SYMBOL_TESTS.items())


@query(_symbol_sql("prices", "price", f"(SELECT {PRICE_TEXT} AS price FROM orders)") + "\nUNION ALL\n"
       + _symbol_sql("documents", "text", "documents"))
def currency_symbols(t):
    prices = t.orders.select(F.expr(PRICE_TEXT).alias("price"))
    return money_units.currency_profile(prices, "prices").unionByName(
        money_units.currency_profile(t.documents, "documents"))


CODE_TEXT = """CASE o_custkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN ' usd ' WHEN 2 THEN 'INR' WHEN 3 THEN ''
  WHEN 4 THEN NULL ELSE 'Unknown' END"""


@query(f"""
SELECT upper(trim(c)) AS code, COUNT(*) AS row_count FROM (SELECT {CODE_TEXT} AS c FROM orders)
WHERE upper(trim(c)) NOT IN ('', 'NONE', 'UNKNOWN') GROUP BY 1
""")
def currency_codes(t):
    return money_units.currency_codes(t.orders.select(F.expr(CODE_TEXT).alias("currency")), "currency")


@query(f"""
WITH codes AS (SELECT upper(trim(c)) AS code, COUNT(*) AS n FROM (SELECT {CODE_TEXT} AS c FROM orders)
  WHERE upper(trim(c)) NOT IN ('', 'NONE', 'UNKNOWN') GROUP BY 1),
docs AS (SELECT COUNT(*) > 0 AS us FROM documents WHERE regexp_matches(text, '(^|[^AC])\\$'))
SELECT 'coded' AS table_name, (SELECT code FROM codes ORDER BY n DESC, code LIMIT 1) AS currency,
  (SELECT string_agg(code, ',' ORDER BY code) FROM codes) AS currencies, (SELECT COUNT(*) > 1 FROM codes) AS is_multi_currency
UNION ALL SELECT 'part_inr', 'INR', 'INR', FALSE
UNION ALL SELECT 'balances', 'EUR', 'EUR', FALSE
UNION ALL SELECT 'nation', 'UNKNOWN', '', FALSE
""")
def currency_by_table(t):
    tables = {
        "coded": t.orders.select("o_orderkey", F.expr(CODE_TEXT).alias("currency")),
        "part_inr": t.part,
        "balances": t.customer.withColumnRenamed("c_acctbal", "balance_euro"),
        "nation": t.nation,
    }
    found = reduce(DataFrame.unionByName,
                   [money_units.currency_profile(df, name) for name, df in tables.items()])
    return money_units.table_currency(found, list(tables))


SIZE_TEXT = """CASE p_partkey % 6 WHEN 0 THEN concat(p_size, ' kg') WHEN 1 THEN concat(p_size, '.5 l')
  WHEN 2 THEN 'Small' WHEN 3 THEN concat(' -', p_size, ' ML ') WHEN 4 THEN concat(p_size, ' g') ELSE concat('', p_size) END"""


@query("""
SELECT 'sizes' AS table_name, 'size' AS column_name, unit, 'value' AS origin, COUNT(*) AS row_count, dimension
FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'kilograms' WHEN 1 THEN 'litres' WHEN 3 THEN 'millilitres' WHEN 4 THEN 'grams' END AS unit,
             CASE p_partkey % 6 WHEN 0 THEN 'weight' WHEN 1 THEN 'volume' WHEN 3 THEN 'volume' WHEN 4 THEN 'weight' END AS dimension FROM part)
WHERE unit IS NOT NULL GROUP BY unit, dimension
""")
def unit_values(t):
    return money_units.unit_profile(t.part.select(F.expr(SIZE_TEXT).alias("size")), "sizes")


@query("""
SELECT 'parts' AS table_name, 'weight_kg' AS column_name, 'kilograms' AS unit, 'column name' AS origin,
  CAST(NULL AS BIGINT) AS row_count, 'weight' AS dimension
UNION ALL SELECT 'parts', 'volume (ml)', 'millilitres', 'column name', NULL, 'volume'
UNION ALL SELECT 'parts', 'pack', 'pieces', 'value', COUNT(*), NULL FROM part
""")
def unit_columns(t):
    parts = t.part.select(F.col("p_size").alias("weight_kg"), F.col("p_size").alias("volume (ml)"),
                          F.concat("p_size", F.lit(" pcs")).alias("pack"), F.col("p_retailprice").alias("price_gross"))
    return money_units.unit_profile(parts, "parts")
