"""Ledger queries: registry, history, chains and their verification, fingerprints."""

import uuid

from pyspark.sql import functions as F

from attest.operators import ledger, ledger_state
from attest.plans.registry import query
from attest.session import checkpointed, shared_folder

# Every event is an analysis of the question of its user; part of them were verified.
KINDS = "CASE event_type WHEN 'error' THEN 'REFUSED' WHEN 'view' THEN 'ANSWERED_WITH_ASSUMPTIONS' ELSE 'ANSWERED' END"
LEVELS = "CASE event_type WHEN 'error' THEN 'LOW' WHEN 'view' THEN 'MEDIUM' ELSE 'HIGH' END"


def recorded(t):
    analyses = t.events.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("question_id"),
        F.col("props").alias("answer"), F.expr(KINDS).alias("response_type"), F.expr(LEVELS).alias("confidence"),
        F.lit("PASSED").alias("verification_status"), F.col("ts").alias("created_at"))
    questions = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("total for "), "c_name").alias("question"),
        F.col("c_nationkey").cast("string").alias("dataset_id"))
    verifications = t.events.filter("event_type <> 'error'").select(
        F.concat(F.lit("v"), F.col("event_id")).alias("id"), F.col("event_id").cast("string").alias("analysis_id"),
        F.col("value").cast("string").alias("execution_1"), F.col("value").cast("string").alias("execution_2"),
        F.lit(True).alias("match"))
    return analyses, questions, verifications


@query(f"""
SELECT CAST(event_id AS VARCHAR) AS analysis_id, 'total for ' || c_name AS question, CAST(c_nationkey AS VARCHAR) AS dataset_id,
  props AS answer, {KINDS} AS response_type, {LEVELS} AS confidence, 'PASSED' AS verification_status,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, CASE WHEN event_type <> 'error' THEN TRUE END AS match
FROM events JOIN customer ON user_id = c_custkey ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 50
""")
def ledger_history(t):
    return ledger.history(*recorded(t)).select(
        "analysis_id", "question", "dataset_id", "answer", "response_type", "confidence", "verification_status",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "match")


@query("""
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def ledger_latest(t):
    return ledger.latest(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def ledger_newest(t):
    return ledger.newest(t.events, "ts", "event_id").select(
        "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


FIELDS = ["event_id", "event_type", "props"]
ORDER = ["ts", "event_id"]
PAYLOAD_SQL = " || ".join(f"COALESCE(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')"
                          for c in ("user_id", "position", *FIELDS))
PLACED_SQL = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events"
GENESIS_SQL = "'GENESIS_BLOCK_000000000000'"


@query(f"""
WITH c AS (SELECT user_id, list({PAYLOAD_SQL} ORDER BY position) AS p, list(event_id ORDER BY position) AS ids
  FROM ({PLACED_SQL}) GROUP BY user_id),
h AS (SELECT user_id, ids, unnest(generate_series(1, len(p))) AS position, p FROM c)
SELECT user_id, position, ids[position] AS event_id,
  CASE WHEN position = 1 THEN {GENESIS_SQL} ELSE list_reduce(list_prepend({GENESIS_SQL}, p[1:position - 1]), lambda a, x: sha256(a || '|' || x)) END AS previous_hash,
  list_reduce(list_prepend({GENESIS_SQL}, p[1:position]), lambda a, x: sha256(a || '|' || x)) AS record_hash FROM h
""")
def ledger_chain(t):
    """One plain chain per user, as long as no user has more records than a segment holds."""
    return ledger.chain(t.events, "user_id", ORDER, FIELDS, LONG).select(
        "user_id", "position", "event_id", "previous_hash", "record_hash")


LONG, SMALL = 4096, 16


SEGMENTS_SQL = f"""
WITH r AS (SELECT user_id, event_id, {PAYLOAD_SQL} AS p, position FROM ({PLACED_SQL})),
s AS (SELECT user_id, (position - 1) // {SMALL} AS segment, list(p ORDER BY position) AS p, list(event_id ORDER BY position) AS ids FROM r GROUP BY ALL),
d AS (SELECT *, sha256(list_reduce(list_transform(p, lambda x: sha256(x)), lambda a, x: a || x)) AS digest FROM s),
k AS (SELECT *, list(digest) OVER (PARTITION BY user_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM d),
g AS (SELECT *, CASE WHEN earlier IS NULL OR len(earlier) = 0 THEN {GENESIS_SQL}
  ELSE list_reduce(list_prepend({GENESIS_SQL}, earlier), lambda a, x: sha256(a || '|' || x)) END AS anchor FROM k),
h AS (SELECT user_id, segment, ids, anchor, p, unnest(generate_series(1, len(p))) AS i FROM g)
SELECT user_id, segment * {SMALL} + i AS position, segment, ids[i] AS event_id,
  CASE WHEN i = 1 THEN anchor ELSE list_reduce(list_prepend(anchor, p[1:i - 1]), lambda a, x: sha256(a || '|' || x)) END AS previous_hash,
  list_reduce(list_prepend(anchor, p[1:i]), lambda a, x: sha256(a || '|' || x)) AS record_hash FROM h
"""


@query(SEGMENTS_SQL)
def ledger_chain_segments(t):
    """Chains cut into short segments, each anchored in all records before it."""
    return ledger.chain(t.events, "user_id", ORDER, FIELDS, segment_size=SMALL).select(
        "user_id", "position", "segment", "event_id", "previous_hash", "record_hash")


@query(SEGMENTS_SQL)
def ledger_extend(t):
    """The same chains in three commits, each of which reads the heads and not the records before it."""
    folder = f"{shared_folder(t.spark)}/ledger-{uuid.uuid4().hex}"
    ends = t.events.agg(F.min("ts").alias("a"), ((F.max("ts") - F.min("ts")) / 3).alias("d"))
    stage = F.when(F.col("ts") < F.col("a") + F.col("d"), 0).when(F.col("ts") < F.col("a") + F.col("d") * 2, 1).otherwise(2)
    dated = checkpointed(t.events.withColumn("a", ends.select("a").scalar()).withColumn("d", ends.select("d").scalar()).withColumn("stage", stage).drop("a", "d"))
    for number in range(3):
        ledger_state.commit(dated.filter(F.col("stage") == number).drop("stage"), folder, "user_id", ORDER, FIELDS, SMALL, expected_version=number)
    return ledger_state.read_records(t.spark, folder).select("user_id", "position", "segment", "event_id", "previous_hash", "record_hash")


NARROW, TREE_LEVELS = 2, 14
LEAVES_SQL = f"""
r AS (SELECT user_id, {PAYLOAD_SQL} AS p, position FROM ({PLACED_SQL})),
n0 AS (SELECT user_id, (position - 1) // {SMALL} AS place, sha256(string_agg(sha256(p), '' ORDER BY position)) AS hash FROM r GROUP BY ALL),
"""
LEVELS_SQL = ",\n".join(
    f"n{i + 1} AS (SELECT user_id, place // {NARROW} AS place, sha256(string_agg(hash, '|' ORDER BY place)) AS hash FROM n{i} "
    f"WHERE user_id IN (SELECT user_id FROM n{i} WHERE place > 0) GROUP BY ALL)" for i in range(TREE_LEVELS))
TOPS_SQL = " UNION ALL ".join(f"SELECT user_id, any_value(hash) AS root, {i} AS depth FROM n{i} GROUP BY user_id HAVING MAX(place) = 0"
                              for i in range(TREE_LEVELS + 1))


@query(f"""
WITH {LEAVES_SQL}{LEVELS_SQL},
tops AS ({TOPS_SQL})
SELECT r.user_id, r.position, n0.place AS segment, n0.hash AS digest, tops.depth, tops.root, TRUE AS holds
FROM r JOIN n0 ON r.user_id = n0.user_id AND (r.position - 1) // {SMALL} = n0.place JOIN tops ON r.user_id = tops.user_id
""")
def ledger_proof(t):
    """For every record the proof that it is in the tree of its chain, checked against the root."""
    stored = checkpointed(ledger.chain(t.events, "user_id", ORDER, FIELDS, segment_size=SMALL))
    nodes = ledger_state.tree(stored, "user_id", FIELDS, SMALL, NARROW)
    known = ledger_state.roots(nodes, "user_id").drop("height")
    proven = ledger_state.proofs(nodes, stored, "user_id", SMALL, NARROW).withColumn("proven", ledger_state.proven_root())
    return proven.join(known, "user_id").select(
        "user_id", "position", "segment", "digest", F.size("path").alias("depth"), "root", F.col("proven").eqNullSafe(F.col("root")).alias("holds"))


@query("""
SELECT user_id, position, 'changed' AS problem FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events) WHERE event_id % 89 = 0
""")
def ledger_differences(t):
    """Records that two copies of a ledger hold differently, found by descending their trees."""
    stored = checkpointed(ledger.chain(t.events, "user_id", ORDER, FIELDS, segment_size=SMALL))
    copy = stored.withColumn("event_type", F.when(F.col("event_id") % 89 == 0, F.lit("edited")).otherwise(F.col("event_type")))
    ours, theirs = (ledger_state.tree(df, "user_id", FIELDS, SMALL, NARROW) for df in (stored, copy))
    segments = ledger_state.differing_segments(ours, theirs, "user_id", NARROW)
    return ledger_state.changed_records(stored, copy, segments, "user_id", FIELDS, SMALL)


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
  COUNT(*) OVER (PARTITION BY user_id) AS n FROM events),
x AS (SELECT user_id, position, n, CASE WHEN event_id % 97 = 0 OR user_id % 11 = 0 OR (user_id % 5 = 0 AND position > n - 2) THEN 'cut'
  WHEN event_id % 89 = 0 THEN 'changed' WHEN event_id % 83 = 0 THEN 'shifted' END AS act FROM r),
last AS (SELECT user_id, MAX(n) AS n, COALESCE(MAX(position) FILTER (act IS DISTINCT FROM 'cut'), 0) AS length FROM x GROUP BY user_id),
w AS (SELECT x.*, lag(act) OVER (PARTITION BY x.user_id ORDER BY position) AS before FROM x)
SELECT w.user_id, position, position AS until,
  CASE WHEN act = 'cut' THEN 'missing_record' WHEN act IN ('changed', 'shifted') THEN 'broken_hash' ELSE 'broken_link' END AS problem
FROM w JOIN last ON w.user_id = last.user_id AND position <= length
WHERE act IS NOT NULL OR before = 'cut'
UNION ALL SELECT user_id, length + 1, n, 'missing_end' FROM last WHERE length < n
""")
def ledger_verify(t):
    """A ledger with changed and removed records, cut ends, removed chains and text moved from one
    field to the next: what the verification reports against the heads of the whole ledger."""
    stored = checkpointed(ledger.chain(t.events, "user_id", ORDER, FIELDS, LONG))
    known = checkpointed(ledger.heads(stored, "user_id"))
    kept = stored.join(known.select("user_id", "length"), "user_id").filter(
        "event_id % 97 <> 0 and user_id % 11 <> 0 and not (user_id % 5 = 0 and position > length - 2)").drop("length")
    edited, shifted = F.col("event_id") % 89 == 0, F.col("event_id") % 83 == 0
    spoiled = kept.withColumn("props", F.when(shifted & ~edited, F.concat(F.lit("|"), "props")).otherwise(F.col("props"))).withColumn(
        "event_type", F.when(edited, F.lit("edited")).otherwise(F.col("event_type")))
    return ledger.verify_chain(checkpointed(spoiled), "user_id", FIELDS, LONG, known)


@query("""
SELECT 'orders' AS table_name, COUNT(*) AS row_count, CAST(SUM(CAST('0x' || substr(md5(
  concat(length(CAST(o_orderkey AS VARCHAR)), ':', o_orderkey, length(CAST(o_custkey AS VARCHAR)), ':', o_custkey,
         length(o_orderstatus), ':', o_orderstatus, length(o_orderpriority), ':', o_orderpriority)), 1, 12) AS BIGINT)) AS VARCHAR) AS content_sum
FROM orders
""")
def table_fingerprint(t):
    return ledger.fingerprint(t.orders, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).select(
        "table_name", "row_count", "content_sum")
