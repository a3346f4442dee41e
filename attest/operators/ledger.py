"""Audit ledger: append-only tables, registry, history, and hash chains verified in parallel.

A chain links each record to the one before it: hash = SHA-256(previous hash | payload), and the
first record links to a fixed genesis text. The payload holds the chain id, the position and every
given field, each with its length before it. Chains are cut into segments of `segment_size` records,
which the caller states when writing and when verifying. The first record of a later segment links to
the segment's anchor, a hash over the digests of every record before it, so segments are hashed side
by side and any change still alters every later hash. A chain no longer than one segment is a plain
chain. What was cut from the end shows only against heads kept elsewhere (`heads`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.values import row_text
from attest.functions.vocab import GENESIS, HISTORY_ROWS
from attest.operators.position import with_position
from attest.session import broadcast_if_small

LEDGER_TABLES = {
    "datasets": "id string, filename string, filepath string, upload_time timestamp, "
                "row_count bigint, column_count int, profile_json string",
    "questions": "id string, dataset_id string, question string, created_at timestamp",
    "analysis_results": "id string, question_id string, answer string, response_type string, "
                        "confidence string, code string, assumptions array<string>, evidence string, "
                        "verification_status string, created_at timestamp",
    "verification_history": "id string, analysis_id string, execution_1 string, execution_2 string, "
                            "match boolean, status string, timestamp timestamp",
    "audit_ledger": "id string, run_id string, timestamp timestamp, dataset_hash string, "
                    "query_plan_json string, code string, primary_result string, "
                    "secondary_result string, verification_status string, confidence string, "
                    "previous_hash string, record_hash string",
}
PAYLOAD = ["run_id", "timestamp", "dataset_hash", "query_plan_json", "code", "primary_result",
           "secondary_result", "verification_status", "confidence"]


def append(df: DataFrame, path: str, time: str) -> None:
    """Appends rows to a ledger table, one folder per day."""
    dated = df.withColumn("run_date", F.to_date(time))
    # rows of a day share a few files, not one per task; rebalancing splits a crowded day
    dated.hint("rebalance", "run_date").write.mode("append").partitionBy("run_date").parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest(log: DataFrame, ids: list[str], order: list[str]) -> DataFrame:
    """The last row per id of an append log, folded on the map side; a hot id is no hot task."""
    others = [c for c in log.columns if c not in ids]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return log.groupBy(*ids).agg(last.alias("_last")).select(*ids, "_last.*").select(*log.columns)


def listing(log: DataFrame, ids: list[str], time: str) -> DataFrame:
    """The registry: the last row per id, newest first."""
    return latest(log, ids, [time]).orderBy(F.desc(time), *ids)


def lookup(log: DataFrame, id_column: str, value, time: str) -> DataFrame:
    return latest(log.filter(F.col(id_column) == value), [id_column], [time])


def history(analyses: DataFrame, questions: DataFrame, verifications: DataFrame,
            rows: int | None = HISTORY_ROWS) -> DataFrame:
    """Analyses with their question and, where there is one, their verification; newest first."""
    asked = questions.select(F.col("id").alias("question_id"), "question", "dataset_id")
    checked = verifications.select(F.col("id").alias("_v"), "analysis_id", "execution_1",
                                   "execution_2", "match")
    newest_first = [F.desc("created_at"), F.asc("analysis_id")]
    listed = analyses.withColumnRenamed("id", "analysis_id").join(asked, "question_id")
    if rows:
        # a left join drops no analysis, so the newest rows come from the newest analyses; these few
        # are found first, and only their verifications are kept
        found = broadcast_if_small(listed.orderBy(*newest_first).limit(rows))
        checked = checked.join(found.select("analysis_id"), "analysis_id", "left_semi")
        listed = found
    met = listed.join(checked, "analysis_id", "left").select(
        "analysis_id", "question", "dataset_id", "answer", "response_type", "confidence",
        "verification_status", "created_at", "execution_1", "execution_2", "match").orderBy(*newest_first)
    return met.limit(rows) if rows else met


def newest(records: DataFrame, time: str, tie: str, rows: int = HISTORY_ROWS) -> DataFrame:
    return records.orderBy(F.desc(time), F.desc(tie)).limit(rows)


def payload(df: DataFrame, chain_id: str, columns: list[str]) -> Column:
    """Chain id, position and fields, each after its length: no field runs into the next, and a
    missing field is not an empty one."""
    return row_text(df, [chain_id, "position", *columns])


def record_hash(previous: Column, text: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("|"), text), 256)


def _segment(size: int) -> Column:
    return F.floor((F.col("position") - 1) / size).cast("bigint")


def chain(records: DataFrame, chain_id: str, order: list[str], columns: list[str],
          segment_size: int) -> DataFrame:
    """Adds position, segment, previous_hash and record_hash to every record of every chain."""
    placed = with_position(records, order, [chain_id])
    placed = placed.withColumn("_payload", payload(placed, chain_id, columns))
    return _linked(placed, chain_id, segment_size).drop("_payload")


def extend(stored: DataFrame, records: DataFrame, chain_id: str, order: list[str], columns: list[str],
           segment_size: int) -> DataFrame:
    """The rows to append when new records continue stored chains; equal to chaining all at once.

    New records stand after the stored ones, in the given order. Only chains that receive records
    are read.
    """
    placed = with_position(records, order, [chain_id])
    ends = stored.groupBy(F.col(chain_id).alias("_c")).agg(F.max("position").alias("_end"))
    fresh = placed.join(ends, F.col(chain_id).eqNullSafe(F.col("_c")), "left").select(
        *records.columns, (F.col("position") + F.coalesce("_end", F.lit(0))).alias("position"),
        F.lit(True).alias("_new"))
    touched = records.select(F.col(chain_id).alias("_c")).distinct()
    old = stored.join(touched, F.col(chain_id).eqNullSafe(F.col("_c")), "left_semi")
    both = old.select(*records.columns, "position", F.lit(False).alias("_new")).unionByName(fresh)
    both = both.withColumn("_payload", payload(both, chain_id, columns))
    return _linked(both, chain_id, segment_size).filter("_new").drop("_payload", "_new")


def _linked(placed: DataFrame, chain_id: str, size: int) -> DataFrame:
    placed = placed.withColumn("segment", _segment(size))
    others = [c for c in placed.columns if c not in (chain_id, "position", "segment", "_payload")]
    # at most `size` records meet in one group
    held = placed.groupBy(chain_id, "segment").agg(F.array_sort(F.collect_list(
        F.struct("position", "_payload", *others))).alias("_rows"))
    anchored = _anchored(held, chain_id, size)
    hashes = F.aggregate(
        F.col("_rows"), F.array(F.col("_anchor")),
        lambda done, row: F.concat(done, F.array(record_hash(F.element_at(done, -1), row["_payload"]))))
    unfolded = anchored.withColumn("_hashes", hashes).select(
        chain_id, "segment", "_hashes", F.posexplode("_rows").alias("_i", "_row"))
    return unfolded.select(
        chain_id, "segment", "_row.position", "_row._payload", *[F.col(f"_row.{c}") for c in others],
        F.get("_hashes", F.col("_i")).alias("previous_hash"),
        F.get("_hashes", F.col("_i") + 1).alias("record_hash"),
    )


def _segment_digest(held: DataFrame) -> DataFrame:
    digests = F.transform("_rows", lambda row: F.sha2(row["_payload"], 256))
    return held.withColumn("_digest", F.sha2(F.array_join(digests, ""), 256))


def _anchored(held: DataFrame, chain_id: str, size: int) -> DataFrame:
    """Adds `_anchor`: genesis for the first segment, else a hash over all earlier segments.

    Segment digests of a chain are folded in blocks of `size`, and block digests once more, so no
    task folds more than `size` entries until a chain exceeds size ** 3 records (6.9e10).
    """
    digested = _segment_digest(held)
    blocks = digested.select(chain_id, "segment", "_digest").groupBy(
        chain_id, F.floor(F.col("segment") / size).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("segment", "_digest"))).alias("_segments"))
    folded = blocks.select(chain_id, "block", "_segments", F.element_at(
        _prefixes("_segments", F.lit("")), -1).alias("_digest"))
    starts = (
        folded.groupBy(chain_id)
        .agg(F.array_sort(F.collect_list(F.struct("block", "_digest"))).alias("_blocks"))
        .select(chain_id, _prefixes("_blocks", F.lit(GENESIS)).alias("_starts"),
                F.posexplode("_blocks").alias("_i", "_b"))
        .select(chain_id, F.col("_b.block").alias("block"), F.get("_starts", F.col("_i")).alias("_start"))
    )
    anchors = (
        folded.join(starts, [chain_id, "block"])
        .select(chain_id, _prefixes("_segments", F.col("_start")).alias("_anchors"),
                F.posexplode("_segments").alias("_i", "_s"))
        .select(chain_id, F.col("_s.segment").alias("segment"),
                F.get("_anchors", F.col("_i")).alias("_anchor"))
    )
    return digested.drop("_digest").join(anchors, [chain_id, "segment"])


def _prefixes(entries: str, start: Column) -> Column:
    """The start, and the hash after each entry."""
    return F.aggregate(entries, F.array(start), lambda done, entry: F.concat(done, F.array(
        F.sha2(F.concat(F.element_at(done, -1), F.lit("|"), entry["_digest"]), 256))))


def heads(stored: DataFrame, chain_id: str) -> DataFrame:
    """Length and last hash of every chain: what is kept apart from the ledger to notice a cut end."""
    return stored.groupBy(chain_id).agg(
        F.max("position").alias("length"), F.max_by("record_hash", "position").alias("last_hash"))


def verify_chain(stored: DataFrame, chain_id: str, columns: list[str], segment_size: int,
                 known: DataFrame | None = None) -> DataFrame:
    """Problems: broken_hash, broken_link, repeated_record, missing_record, missing_segment, and
    against the `known` heads missing_end and changed_end. `until` is the last position concerned.
    No rows: the ledger is whole, up to what `known` tells of its ends.

    Hashes are recomputed row by row. Links are checked by sending each record's hash to the next
    position and folding there. Anchors of later segments are recomputed from the payloads. The
    segment of a record follows from its position; a stored one is not read.
    """
    rows = stored.withColumn("segment", _segment(segment_size)).withColumn(
        "_payload", payload(stored, chain_id, columns))
    first = (F.col("position") - 1) % segment_size == 0
    good = record_hash(F.col("previous_hash"), F.col("_payload")).eqNullSafe(F.col("record_hash"))
    own = rows.select(chain_id, "position", first.alias("opens"), good.alias("good"),
                      F.col("previous_hash").alias("link"), F.lit(None).cast("string").alias("sent"))
    sent = rows.select(chain_id, (F.col("position") + 1).alias("position"),
                       (F.col("position") % segment_size == 0).alias("opens"),
                       F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("string").alias("link"),
                       F.col("record_hash").alias("sent"))
    held = rows.groupBy(chain_id, "segment").agg(F.array_sort(F.collect_list(
        F.struct("position", "_payload"))).alias("_rows"))
    # an opening record must link to the anchor
    anchors = _anchored(held, chain_id, segment_size).select(
        chain_id, (F.col("segment") * segment_size + 1).alias("position"), F.lit(True).alias("opens"),
        F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("string").alias("link"),
        F.col("_anchor").alias("sent"))
    met = own.unionByName(sent.filter(~F.col("opens"))).unionByName(anchors).groupBy(chain_id, "position").agg(
        F.count("good").alias("records"), F.bool_and("good").alias("good"),
        F.max("link").alias("link"), F.max("sent").alias("sent"))
    problem = (
        F.when(F.col("records") > 1, "repeated_record")
        .when(~F.coalesce(F.col("good"), F.lit(False)), "broken_hash")
        .when(~F.col("link").eqNullSafe(F.col("sent")), "broken_link")
    )
    found = met.filter("records > 0").select(
        chain_id, "position", F.col("position").alias("until"), problem.alias("problem")).filter("problem is not null")
    found = found.unionByName(_missing(held, chain_id, segment_size))
    return found if known is None else found.unionByName(_ends(stored, chain_id, known))


def _missing(held: DataFrame, chain_id: str, size: int) -> DataFrame:
    """Positions without a record before the last one; neighbouring segments without any are one row.

    Each segment is compared with the one before it, so a forged position makes one row, not a list.
    """
    before = Window.partitionBy(chain_id).orderBy("segment")
    lists = held.select(chain_id, "segment", F.transform("_rows", lambda r: r["position"]).alias("_held")).withColumn(
        "_next", F.lead("segment").over(before)).withColumn("_before", F.coalesce(F.lag("segment").over(before), F.lit(-1)))
    start = F.col("segment") * size + 1
    end = F.when(F.col("_next").isNull(), F.array_max("_held")).otherwise(start + size - 1)
    records = lists.filter("segment >= 0").select(
        chain_id, F.explode(F.array_except(F.sequence(start, end), F.col("_held"))).alias("position"))
    segments = lists.filter("segment > _before + 1").select(
        chain_id, ((F.col("_before") + 1) * size + 1).alias("position"), (start - 1).alias("until"),
        F.lit("missing_segment").alias("problem"))
    return records.select(chain_id, "position", F.col("position").alias("until"),
                          F.lit("missing_record").alias("problem")).unionByName(segments)


def _ends(stored: DataFrame, chain_id: str, known: DataFrame) -> DataFrame:
    """Chains that end before their known length, or had another record there."""
    ends = known.select(F.col(chain_id).alias("_c"), "length", "last_hash")
    rows = stored.select(chain_id, "position", "record_hash")
    met = ends.join(rows, F.col("_c").eqNullSafe(F.col(chain_id)), "left").groupBy("_c", "length", "last_hash").agg(
        F.coalesce(F.max(F.when(F.col("position") <= F.col("length"), F.col("position"))), F.lit(0)).alias("_end"),
        F.max(F.when(F.col("position") == F.col("length"), F.col("record_hash"))).alias("_hash"))
    problem = F.when(F.col("_end") < F.col("length"), "missing_end").when(
        ~F.col("_hash").eqNullSafe(F.col("last_hash")), "changed_end")
    return met.select(
        F.col("_c").alias(chain_id), F.least(F.col("_end") + 1, F.col("length")).alias("position"),
        F.col("length").alias("until"), problem.alias("problem")).filter("problem is not null")


def content_sum(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The sum over rows of the leading 48 bits of each row's MD5."""
    bits = F.conv(F.substring(F.md5(row_text(df, columns)), 1, 12), 16, 10).cast("decimal(20,0)")
    return F.coalesce(F.sum(bits), F.lit(0))


def fingerprint(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """Content digest of a table that does not depend on the order of rows: row count, and the sum
    of the leading 48 bits of each row's MD5."""
    return df.agg(F.count("*").alias("row_count"), content_sum(df, columns).alias("s")).select(
        F.lit(table).alias("table_name"), "row_count", F.col("s").cast("string").alias("content_sum"),
        F.substring(F.sha2(F.concat_ws(":", F.lit(table), "row_count", "s"), 256), 1, 16).alias("fingerprint"))
