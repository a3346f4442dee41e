"""Files written from the tables and read again: formats, encodings, quoted line breaks, rejects, previews, and the registry of files."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.operators import ledger
from attest.plans.registry import query
from attest.session import shared_folder
from attest.sources import files


def folder_for(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _quoted(df, path: str, sep: str = ",", encoding: str = "UTF-8") -> str:
    df.write.option("header", True).option("sep", sep).option("quoteAll", True).option("escape", '"').option("encoding", encoding).csv(path)
    return path


@query("SELECT doc_id, lang, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def source_csv_records(t):
    """Documents as CSV, whose texts hold line breaks, commas and quotes, read by byte ranges."""
    path = _quoted(t.documents.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")), folder_for(t, "documents-csv"))
    back = files.read_table(t.spark, path, "csv", schema="doc_id bigint, lang string, text string", multi_line=True)
    return back.select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders")
def source_tsv(t):
    """Orders as TSV; types are found in the file."""
    names = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    path = _quoted(t.orders.select(*names), folder_for(t, "orders-tsv"), sep="\t")
    back = files.read_table(t.spark, path, "tsv")
    return back.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), *names[1:])


@query("""
WITH n AS (SELECT COUNT(*) AS n, CAST(SUM(c_custkey) AS BIGINT) AS s FROM customer)
SELECT f AS table_name, e AS encoding, n AS row_count, s AS key_sum, n AS named
FROM n, (VALUES ('utf8', 'UTF-8'), ('latin', 'ISO-8859-1'), ('tabbed', 'UTF-8'), ('columnar', NULL)) v(f, e)
""")
def source_formats(t):
    """Customers in four files; the format comes from the extension, the encoding from the bytes."""
    named = t.customer.select("c_custkey", F.concat(F.lit("Müller "), "c_name").alias("name"))
    base = folder_for(t, "customers")
    paths = {"utf8": _quoted(named, f"{base}/a.csv"), "latin": _quoted(named, f"{base}/b.csv", encoding="ISO-8859-1"),
             "tabbed": _quoted(named, f"{base}/c.tsv", sep="\t"), "columnar": f"{base}/d.parquet"}
    named.write.parquet(paths["columnar"])
    tables = files.load_tables(t.spark, paths, encoding="auto")
    parts = None
    for name, df in tables.items():
        encoding = None if name == "columnar" else files.choose_encoding(t.spark, paths[name])
        part = df.agg(F.count("*").alias("row_count"), F.sum("c_custkey").cast("bigint").alias("key_sum"), F.count_if(F.startswith("name", F.lit("Müller "))).alias("named")).select(
            F.lit(name).alias("table_name"), F.lit(encoding).cast("string").alias("encoding"), "row_count", "key_sum", "named")
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("""
SELECT o_orderkey % 10 <> 3 AS fits, CASE WHEN o_orderkey % 10 = 3 THEN 'n/a,' || o_orderstatus ELSE CAST(o_orderkey AS VARCHAR) END AS line FROM orders
""")
def source_rejects(t):
    """Orders as lines, one in ten of which has a text for its number: rows that fit, and the lines that do not."""
    path = folder_for(t, "orders-lines")
    line = F.when(F.col("o_orderkey") % 10 == 3, F.lit("n/a")).otherwise(F.col("o_orderkey").cast("string"))
    t.orders.select(F.concat(line, F.lit(","), "o_orderstatus").alias("value")).write.text(path)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("status", T.StringType())])
    checked = files.read_checked(t.spark, path, schema, header=False)
    return checked.rows.select(F.lit(True).alias("fits"), F.col("key").cast("string").alias("line")).unionByName(
        checked.rejects.select(F.lit(False).alias("fits"), "line"))


@query("SELECT * FROM (SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20)")
def table_preview(t):
    return files.preview(t.events.select("event_id", "event_type").orderBy(F.desc("event_id")), 20)


REGISTRY_SQL = """SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1"""


@query(REGISTRY_SQL)
def registry_listing(t):
    """The newest entry of every id of a log that was appended in days."""
    path = folder_for(t, "registry")
    ledger.append(t.events.select("user_id", "event_id", "event_type", "ts"), path, "ts")
    return ledger.listing(ledger.read(t.spark, path), ["user_id"], "ts").select(
        "user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query(f"SELECT * FROM ({REGISTRY_SQL}) WHERE user_id = (SELECT MIN(user_id) FROM events)")
def registry_lookup(t):
    path = folder_for(t, "registry")
    ledger.append(t.events.select("user_id", "event_id", "event_type", "ts"), path, "ts")
    wanted = t.events.agg(F.min("user_id")).scalar()
    return ledger.lookup(ledger.read(t.spark, path), "user_id", wanted, "ts").select(
        "user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"))
