"""Heads, commits and trees of a ledger against chaining all at once and plain loops."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attest.operators import ledger, ledger_state
from attest.session import checkpointed

FIELDS = ["run", "result"]
SCHEMA = "chain string, at int, run string, result double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made(spark, first, last):
    """Records `first` to `last` - 1 in the order of time; most belong to one chain, some to the chain NULL."""
    rows = [(("hot", "hot", "hot", None, f"c{i % 4}")[i % 5], i, f"r{i}", None if i % 9 == 0 else i * 1.5) for i in range(first, last)]
    return spark.createDataFrame(rows, SCHEMA)


def key(row):
    return (row["chain"] or "", row["position"])


@pytest.mark.parametrize("size", [2, 3, 50])
def test_commits_equal_one_chain(spark, tmp_path, size):
    folder, ends = str(tmp_path / "ledger"), [0, 7, 8, 30, 30, 64]
    for number, (a, b) in enumerate(zip(ends, ends[1:])):
        assert ledger_state.commit(made(spark, a, b), folder, "chain", ["at"], FIELDS, size, expected_version=number) == number + 1
    names = ["chain", "segment", "position", "run", "result", "previous_hash", "record_hash"]
    whole = ledger.chain(made(spark, 0, 64), "chain", ["at"], FIELDS, size).select(*names)
    # the older operator drops no chain, but joins none on NULL
    stored = sorted((r for r in ledger_state.read_records(spark, folder).select(*names).collect()), key=key)
    assert [r for r in stored if r["chain"]] == sorted((r for r in whole.collect() if r["chain"]), key=key)
    assert [r["position"] for r in stored if not r["chain"]] == list(range(1, 1 + len([i for i in range(64) if i % 5 == 3])))
    heads = {r["chain"]: r for r in ledger_state.read_heads(spark, folder).collect()}
    for chain, head in heads.items():
        mine = [r for r in stored if r["chain"] == chain]
        assert (head["length"], head["last_hash"]) == (len(mine), mine[-1]["record_hash"])
        assert len(head["open_digests"]) == len(mine) % size
    problems = ledger.verify_chain(ledger_state.read_records(spark, folder).filter("chain is not null"), "chain", FIELDS, size)
    assert problems.count() == 0


def test_no_stored_record_is_read(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    ledger_state.commit(made(spark, 0, 20), folder, "chain", ["at"], FIELDS, 3)
    heads = ledger_state.read_heads(spark, folder)
    assert all("/heads/" in f for f in heads.inputFiles())
    rows, _ = ledger_state.continued(heads, made(spark, 20, 30), "chain", ["at"], FIELDS, 3)
    assert not any("/records/" in f for f in rows.inputFiles())
    # they can even be gone
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{folder}/records/{ledger_state._versions(spark, folder)[0]}")
    ledger_state.commit(made(spark, 20, 30), folder, "chain", ["at"], FIELDS, 3)
    whole = {(r["chain"], r["position"]): r["record_hash"] for r in ledger.chain(made(spark, 0, 30), "chain", ["at"], FIELDS, 3).collect()}
    found = [r for r in ledger_state.read_records(spark, folder).collect() if r["chain"]]
    assert len(found) == 8 and all(whole[r["chain"], r["position"]] == r["record_hash"] for r in found)


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    assert ledger_state.commit(made(spark, 0, 5), folder, "chain", ["at"], FIELDS, 3) == 1
    ledger_state.claim(spark, folder, 2, ledger_state._versions(spark, folder)[0])
    with pytest.raises(ledger_state.Conflict):
        ledger_state.claim(spark, folder, 2, "late")
    with pytest.raises(ledger_state.Conflict):
        ledger_state.commit(made(spark, 5, 9), folder, "chain", ["at"], FIELDS, 3, expected_version=1)


def test_rows_of_a_refused_writer_are_not_read(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "ledger")
    ledger_state.commit(made(spark, 0, 5), folder, "chain", ["at"], FIELDS, 3)
    claim = ledger_state.claim

    def late(session, where, version, name):
        claim(session, where, version, ledger_state._versions(session, where)[0])  # somebody else is first
        claim(session, where, version, name)

    monkeypatch.setattr(ledger_state, "claim", late)
    with pytest.raises(ledger_state.Conflict):
        ledger_state.commit(made(spark, 5, 9), folder, "chain", ["at"], FIELDS, 3)
    assert {r["at"] for r in ledger_state.read_records(spark, folder).collect()} == set(range(5))


def plain_tree(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("|".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


@pytest.fixture(scope="module")
def stored(spark):
    return checkpointed(ledger.chain(made(spark, 0, 90).filter("chain is not null"), "chain", ["at"], FIELDS, 3))


@pytest.mark.parametrize("fanout", [2, 4])
def test_trees_and_proofs(stored, fanout):
    nodes = ledger_state.tree(stored, "chain", FIELDS, 3, fanout)
    payloads = {}
    for r in sorted(stored.withColumn("p", ledger.payload(stored, "chain", FIELDS)).collect(), key=key):
        payloads.setdefault(r["chain"], []).append(r["p"])
    found = {(r["chain"], r["level"], r["place"]): r["hash"] for r in nodes.collect()}
    plain = {c: plain_tree([sha("".join(sha(p) for p in ps[i : i + 3])) for i in range(0, len(ps), 3)], fanout) for c, ps in payloads.items()}
    assert found == {(c, level, i): h for c, levels in plain.items() for level, held in enumerate(levels) for i, h in enumerate(held)}
    proven = ledger_state.proofs(nodes, stored, "chain", 3, fanout).withColumn("root", ledger_state.proven_root()).collect()
    assert len(proven) == stored.count() and all(r["root"] == plain[r["chain"]][-1][0] for r in proven)


def test_a_wrong_proof_fails(stored):
    nodes = ledger_state.tree(stored, "chain", FIELDS, 3, 2)
    proofs = ledger_state.proofs(nodes, stored.filter("chain = 'hot'"), "chain", 3, 2)
    forged = proofs.withColumn("digest", F.sha2("digest", 256)).select(ledger_state.proven_root().alias("root")).collect()
    assert {r["root"] for r in forged} == {None}


def test_differences_are_located_from_the_trees(spark, stored):
    copy = checkpointed(stored.withColumn("result", F.when(F.col("run") == "r40", 0.0).otherwise(F.col("result"))).filter("run <> 'r89' and chain <> 'c2'").unionByName(
        stored.filter("chain = 'hot' and position = 1").withColumn("position", F.lit(55).cast("bigint"))))
    ours, theirs = (ledger_state.tree(df, "chain", FIELDS, 3, 2) for df in (stored, copy))
    segments = ledger_state.differing_segments(ours, theirs, "chain", 2)
    where = {(r["chain"], r["segment"]) for r in segments.collect()}
    spot = stored.filter("run = 'r40'").first()
    assert (spot["chain"], spot["segment"]) in where and ("hot", 18) in where and len(where) < ours.filter("level = 0").count()
    found = {(r["chain"], r["position"]): r["problem"] for r in ledger_state.changed_records(stored, copy, segments, "chain", FIELDS, 3).collect()}
    assert found[spot["chain"], spot["position"]] == "changed" and found["hot", 55] == "only_theirs"
    lost = {(r["chain"], r["position"]) for r in stored.filter("run = 'r89' or chain = 'c2'").collect()}
    assert {k for k, v in found.items() if v == "only_ours"} == lost
    assert ledger_state.differing_segments(ours, ours, "chain", 2).count() == 0
