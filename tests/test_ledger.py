"""Ledger: append, registry, history, chains against a plain loop, tampering."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attest.functions.vocab import GENESIS
from attest.operators import ledger
from attest.session import checkpointed

FIELDS = ["run", "result"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_chain(payloads, size):
    """The definition, one record after the other."""
    segments = [payloads[i:i + size] for i in range(0, len(payloads), size)]
    digests = [sha("".join(sha(p) for p in s)) for s in segments]
    blocks = [digests[i:i + size] for i in range(0, len(digests), size)]
    folded = []
    for block in blocks:
        acc = ""
        for d in block:
            acc = sha(f"{acc}|{d}")
        folded.append(acc)
    out = []
    for n, segment in enumerate(segments):
        acc = GENESIS
        for block in folded[:n // size]:
            acc = sha(f"{acc}|{block}")
        for d in digests[n // size * size:n]:
            acc = sha(f"{acc}|{d}")
        for p in segment:
            out.append((acc, sha(f"{acc}|{p}")))
            acc = out[-1][1]
    return out


@pytest.fixture(scope="module")
def runs(spark):
    # a third and more of all records belong to one chain
    return spark.range(200).select(
        F.when(F.col("id") % 5 < 3, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id") % 4)).alias("chain"),
        (F.col("id") * 7919 % 200).alias("at"), F.concat(F.lit("r"), "id").alias("run"),
        F.when(F.col("id") % 9 > 0, F.col("id") * 1.5).alias("result")).repartition(8)


@pytest.mark.parametrize("size", [3, 4096])
def test_chain_equals_the_loop(runs, size):
    by_chain = {}
    for r in ledger.chain(runs, "chain", ["at"], FIELDS, size).collect():
        by_chain.setdefault(r["chain"], []).append(r)
    assert sum(map(len, by_chain.values())) == 200 and len(by_chain["hot"]) == 120
    for rows in by_chain.values():
        rows.sort(key=lambda r: r["position"])
        assert [r["at"] for r in rows] == sorted(r["at"] for r in rows)
        texts = ["".join("~" if v is None else f"{len(str(v))}:{v}" for v in (r["chain"], r["position"], r["run"], r["result"])) for r in rows]
        assert [(r["previous_hash"], r["record_hash"]) for r in rows] == plain_chain(texts, size)


@pytest.mark.parametrize("size", [4, 4096])
def test_extending_equals_chaining_at_once(runs, size):
    whole = ledger.chain(runs, "chain", ["at"], FIELDS, size)
    stored = checkpointed(ledger.chain(runs.filter("at < 90"), "chain", ["at"], FIELDS, size))
    more = ledger.extend(stored, runs.filter("at >= 90"), "chain", ["at"], FIELDS, size)
    assert more.count() == 110
    both = stored.select(*whole.columns).unionByName(more.select(*whole.columns))
    assert sorted(map(str, both.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("size", [5, 4096])
def test_tampering_is_found(runs, size):
    stored = checkpointed(ledger.chain(runs, "chain", ["at"], FIELDS, size))

    def problems(df):
        return {(r["chain"], r["position"], r["problem"]) for r in ledger.verify_chain(df, "chain", FIELDS, size).collect()}

    assert problems(stored) == set()
    hit = F.col("chain").eqNullSafe("hot") & (F.col("position") == 17)
    changed = problems(stored.withColumn("result", F.when(hit, -1.0).otherwise(F.col("result"))))
    assert ("hot", 17, "broken_hash") in changed
    assert all(p[2] == "broken_link" and p[1] % size == 1 and p[1] > 17 for p in changed - {("hot", 17, "broken_hash")})
    # one who changes a record and its own hash breaks the link of the next
    forged = stored.withColumn("result", F.when(hit, -1.0).otherwise(F.col("result")))
    new = ledger.record_hash(F.col("previous_hash"), ledger.payload(forged, "chain", FIELDS))
    assert ("hot", 18, "broken_link") in problems(forged.withColumn("record_hash", F.when(hit, new).otherwise(F.col("record_hash"))))
    gone = problems(stored.filter(~(F.col("chain").eqNullSafe("hot") & F.col("position").between(17, 19))))
    assert {("hot", p, "missing_record") for p in (17, 18, 19)} <= gone and ("hot", 20, "broken_link") in gone
    twice = problems(stored.unionByName(stored.filter(hit)))
    assert ("hot", 17, "repeated_record") in twice
    empty = problems(stored.withColumn("run", F.when(hit, "").otherwise(F.col("run"))))
    assert ("hot", 17, "broken_hash") in empty
    # the stored segment is not trusted, and one forged position does not end the audit
    assert problems(stored.withColumn("segment", F.lit(7))) == set()
    far = problems(stored.withColumn("position", F.when(hit, F.lit(10**15)).otherwise(F.col("position"))))
    assert {("hot", 17, "missing_record"), ("hot", 10**15, "broken_hash")} <= far


def test_cut_ends_are_found(runs):
    stored = checkpointed(ledger.chain(runs, "chain", ["at"], FIELDS, 50))
    known = checkpointed(ledger.heads(stored, "chain"))

    def problems(df):
        return {tuple(r) for r in ledger.verify_chain(df, "chain", FIELDS, 50, known).select("chain", "position", "until", "problem").collect()}

    assert problems(stored) == set()
    assert problems(stored.filter("chain <> 'hot' or position <= 117")) == {("hot", 118, 120, "missing_end")}
    assert problems(stored.filter("chain <> 'hot'")) == {("hot", 1, 120, "missing_end")}
    last = F.col("chain").eqNullSafe("hot") & (F.col("position") == 120)
    forged = stored.withColumn("run", F.when(last, F.lit("x")).otherwise(F.col("run")))
    new = ledger.record_hash(F.col("previous_hash"), ledger.payload(forged, "chain", FIELDS))
    assert problems(forged.withColumn("record_hash", F.when(last, new).otherwise(F.col("record_hash")))) == {("hot", 120, 120, "changed_end")}


def test_missing_segment(runs):
    stored = checkpointed(ledger.chain(runs, "chain", ["at"], FIELDS, 5))
    left = stored.filter("chain <> 'hot' or segment not in (2, 3)")
    found = {(r["position"], r["until"], r["problem"]) for r in ledger.verify_chain(left, "chain", FIELDS, 5).collect()}
    assert {(11, 20, "missing_segment"), (21, 21, "broken_link")} <= found


def test_append_registry_and_history(spark, tmp_path):
    path = str(tmp_path / "datasets")
    schema = "id string, filename string, upload_time timestamp, row_count bigint"
    first = spark.createDataFrame([("d1", "a.csv", None, 10), ("d2", "b.csv", None, 20)], schema)
    ledger.append(first.withColumn("upload_time", F.lit("2025-01-01 10:00:00").cast("timestamp")), path, "upload_time")
    ledger.append(first.filter("id = 'd1'").withColumn("row_count", F.lit(11).cast("bigint"))
                  .withColumn("upload_time", F.lit("2025-01-02 09:00:00").cast("timestamp")), path, "upload_time")
    log = ledger.read(spark, path)
    assert log.count() == 3
    assert [(r["id"], r["row_count"]) for r in ledger.listing(log, ["id"], "upload_time").collect()] == [("d1", 11), ("d2", 20)]
    assert ledger.lookup(log, "id", "d2", "upload_time").collect()[0]["filename"] == "b.csv"
    analyses = spark.createDataFrame(
        [(f"a{i}", f"q{i % 3}", "x", "ANSWERED", "HIGH", "PASSED", i) for i in range(60)],
        "id string, question_id string, answer string, response_type string, confidence string, "
        "verification_status string, created_at int")
    questions = spark.createDataFrame([("q0", "why", "d1"), ("q1", "how", None)], "id string, question string, dataset_id string")
    checks = spark.createDataFrame([("v", "a57", "1", "1", True)], "id string, analysis_id string, execution_1 string, execution_2 string, match boolean")
    rows = ledger.history(analyses, questions, checks, 10).collect()
    assert [r["analysis_id"] for r in rows[:3]] == ["a58", "a57", "a55"] and len(rows) == 10
    assert [r["match"] for r in rows[:3]] == [None, True, None]


def test_declared_ledger_tables_are_valid_schemas(spark):
    for name, schema in ledger.LEDGER_TABLES.items():
        assert spark.createDataFrame([], schema).columns[0] == "id", name


def test_fingerprint_sees_contents_and_not_order(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5), (2, "", 2.5)], "k int, s string, v double")
    def mark(d):
        return ledger.fingerprint(d, "t").collect()[0]["fingerprint"]
    assert mark(df) == mark(df.repartition(3)) == mark(df.orderBy(F.desc("k")))
    assert mark(df) != mark(df.withColumn("v", F.col("v") + 1)) and mark(df) != mark(df.limit(2))
