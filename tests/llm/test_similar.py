"""Near duplicates, repeats and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attest.llm import graph, hyperplanes, jaccard_groups, order_minhash, repeats
from attest.llm.suffixes import BlindTrie, common_prefixes, deep_shallow_order


def least_reached(nodes, links):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5), (None, 3)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(hyperplanes, "BLOCK", 16)
    draw = np.random.default_rng(1)
    centre = draw.normal(size=8)
    vectors = [draw.normal(size=8) for _ in range(40)] + [centre + draw.normal(size=8) * 0.25 for _ in range(60)] + [centre] * 5
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(500, None), (501, []), (502, [0.0] * 8), (503, [None] + [1.0] * 7), (504, [float("nan")] * 8), (505, centre.tolist()[:7]), (None, centre.tolist())]
    table = spark.createDataFrame([(*r, 1, b"k") for r in rows + odd], "vec_id long, embedding array<double>, label int, key binary")
    found = {r.vec_id: r for r in hyperplanes.link(table).collect()}
    units = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = units @ units.T >= 0.9
    np.fill_diagonal(linked, False)
    label = least_reached(range(len(rows)), [*zip(*np.nonzero(linked))])
    share = sum(found[i].n_links for i in range(len(rows))) / linked.sum()
    assert 0.9 <= share <= 1
    same = [found[i].component_id == label[i] for i in range(len(rows))]
    assert np.mean(same) >= 0.95 and all(found[i].n_links <= linked[i].sum() for i in range(len(rows)))
    for i, _ in odd[:-1]:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, False)
    assert hyperplanes.link(table.limit(0)).count() == 0


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else ({tuple(found)} if found else set())


def near_texts():
    draw = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for group in range(12):
        base = [f"w{draw.randrange(4000)}" for _ in range(draw.choice((4, 12, 40, 150)))] + passage * (group % 3 == 0)
        for _ in range(draw.randrange(1, 9)):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(copy) // 25)):
                copy[draw.randrange(len(copy))] = f"n{draw.randrange(9999)}"
            texts.append(" ".join(copy))
    return texts


def test_similar_documents(spark, odd_documents, monkeypatch):
    monkeypatch.setattr(jaccard_groups, "BLOCK", 4)
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(near_texts())], "doc_id long, text string")
    documents = odd_documents.unionByName(extra, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for words, percent in ((3, 90), (5, 80)):
        sets = [shingles(t, words) for _, t in rows]
        nodes = list(range(len(rows)))
        links = [(i, j) for i in nodes for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        label = least_reached(nodes, links)
        least = {}
        for i in nodes:
            if rows[i][0] is not None:
                least[label[i]] = min(least.get(label[i], 1 << 60), rows[i][0])
        expected = sorted(((rows[i][0], len(sets[i]), least.get(label[i])) for i in nodes), key=str)
        found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups.join_similar(documents, words, percent).collect()), key=str)
        assert found == expected
    assert jaccard_groups.join_similar(odd_documents.limit(0), 3, 90).count() == 0


def test_unlinked_near_copies_do_not_all_meet(spark, monkeypatch):
    draw = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(150):  # most pairs share several tokens, few or none the nine tenths of a link
        copy = list(base)
        for at in draw.sample(range(200), 5):
            copy[at] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = {}

    def counted(df, name, written=jaccard_groups.written):
        rows[name] = (table := written(df, name)).count()
        return table

    monkeypatch.setattr(jaccard_groups, "written", counted)
    sets = [shingles(t, 3) for t in texts]
    nodes = range(len(texts))
    label = least_reached(nodes, [(i, j) for i in nodes for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])])
    found = jaccard_groups.join_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90)
    assert {r.doc_id: r.component_id for r in found.collect()} == label
    assert rows["groups-met"] + rows["pairs"] <= len(texts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=6) | st.sampled_from([b"aaaaaa", b"ab"]), max_size=60))
def test_deep_shallow_sorting(values):
    rows = np.array([list((b"same start, long " * 2 + v).ljust(48, b"\0")) for v in values], np.uint8).reshape(-1, 48)
    order = deep_shallow_order(rows)
    strings = [rows[i].tobytes() for i in order]
    assert sorted(order.tolist()) == list(range(len(values))) and strings == sorted(strings)
    trie = BlindTrie([r.tobytes() for r in rows])
    for i in range(len(rows)):
        trie.add(i)
    assert [rows[i].tobytes() for i in trie.ordered()] == strings
    shared = common_prefixes(rows[order])
    assert all(a[:n] == b[:n] and (n == 48 or a[n] != b[n]) for a, b, n in zip(strings, strings[1:], shared[1:]))


def removed(documents, length):
    """doc_id, text to the bytes that stay, by looking at every string."""
    first = {}
    for doc, data in documents:
        for s in range(len(data) - length + 1):
            key = data[s : s + length]
            first[key] = min(first.get(key, (doc, s)), (doc, s))
    out = set()
    for doc, data in documents:
        covered = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] != (doc, s):
                covered[s : s + length] = True
        out.add((doc, np.frombuffer(data, np.uint8)[~covered].tobytes()))
    return out


def test_repeats(spark, odd_documents, monkeypatch):
    draw = random.Random(5)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(260))
    extra = [(200 + i, "".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(0, 300))) + passage[draw.randrange(90) : 260 - draw.randrange(90)]
              + "".join(draw.choice("xyz") for _ in range(draw.randrange(200)))) for i in range(40)]
    extra += [(300, "ab" * 400), (301, "b" + "ab" * 300), (302, passage), (303, passage)]
    documents = odd_documents.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(repeats.NULL_ID if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in documents.collect()]
    expected = removed(sorted(set(rows)), 100)
    for hot in (2_000, 3):  # the second sends most edges the way of hot keys
        monkeypatch.setattr(repeats, "HOT_EDGES", hot)
        found = repeats.remove_repeats(documents, carry=("lang", "key")).collect()
        assert len(found) == len(rows)
        assert {(repeats.NULL_ID if r.doc_id is None else r.doc_id, bytes(r.kept)) for r in found} == expected
        assert all(r.n_bytes - r.n_removed == len(r.kept) for r in found)
    assert repeats.remove_repeats(odd_documents.limit(0)).count() == 0


def test_order_minhash(spark, odd_documents):
    documents = odd_documents.filter("doc_id is null or doc_id <> 6")
    found = order_minhash.compare_edited(documents, permutations=8).collect()
    texts = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in documents.collect()})
    assert len(found) == documents.count()
    following = {t[:2]: n[2] for t, n in zip(texts, texts[1:] + texts[:1])}
    own = {t[:2]: t[2] for t in texts}
    by_text = {}
    for r in found:
        key = (r.doc_id is not None, r.doc_id or 0)
        text, half = own[key], len(own[key]) // 2
        edited = text[: len(text) - half] + following[key][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert order_minhash.compare_edited(odd_documents.limit(0), permutations=2).count() == 0


def test_order_minhash_selects_the_two_least(spark):
    words = "a b a b c a b"
    table = spark.createDataFrame([(1, words)], "id int, text string")
    split = words.split(" ")
    seen, ranks = {}, []
    runs = spark.createDataFrame([(i, split[i - 1] if i else None, w) for i, w in enumerate(split)], "at int, p string, w string").select(
        "at", F.xxhash64("p", "w").alias("run")).orderBy("at").collect()
    for r in runs:
        seen[r.run] = seen.get(r.run, 0) + 1
        ranks.append((r["at"], r.run, seen[r.run]))
    two = []
    hashed = spark.createDataFrame(ranks, "at int, run long, n int").select(
        F.xxhash64(F.xxhash64("run", "n"), F.lit(0)).bitwiseAND(F.lit(0x7FFFFFFF00000000)).bitwiseOR(F.col("at").cast("long")).alias("r")).collect()
    two = sorted(sorted(h.r for h in hashed)[:2], key=lambda r: r & 0xFFFFFFFF)
    expected = spark.createDataFrame([(two[0] >> 32, two[1] >> 32)], "a long, b long").select(F.hash("a", "b")).first()[0]
    assert order_minhash.fingerprints(table, ["id"], permutations=1).first().fingerprint == [expected]


def test_two_least_of_long_texts_come_from_one_fold(spark, monkeypatch):
    draw = random.Random(7)
    texts = [" ".join(f"w{draw.randrange(40)}" for _ in range(n)) for n in (1, 2, 3, 5, 31, 32, 33, 64, 65, 150, 400)]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    runs, seen = [], {}
    for i, t in enumerate(texts):
        words = t.split(" ")
        for at, pair in enumerate(zip([None, *words], words)):
            seen[i, pair] = seen.get((i, pair), 0) + 1
            runs.append((i, at, *pair, seen[i, pair]))
    one = spark.createDataFrame(runs, "id int, at int, p string, w string, n int").withColumn("run", F.xxhash64(F.xxhash64("p", "w"), "n"))
    ranks = [F.xxhash64("run", F.lit(i)).bitwiseAND(F.lit(0x7FFFFFFF00000000)).bitwiseOR(F.col("at").cast("long")) for i in range(6)]
    ranked = one.select("id", F.array(*ranks).alias("ranks")).collect()
    tuples = []
    for i in range(len(texts)):
        for p in range(6):
            two = sorted(sorted(r.ranks[p] for r in ranked if r.id == i)[:2], key=lambda r: r & 0xFFFFFFFF)
            tuples.append((i, p, two[-1] >> 32 if len(two) == 1 else two[0] >> 32, None if len(two) == 1 else two[1] >> 32))
    hashed = {(r.id, r.p): r.h for r in spark.createDataFrame(tuples, "id int, p int, a long, b long").select("id", "p", F.hash("a", "b").alias("h")).collect()}
    for line in (32, 3, 1):
        monkeypatch.setattr(order_minhash, "LINE", line)
        for r in order_minhash.fingerprints(table, ["id"], permutations=6).collect():
            if len(texts[r.id].split(" ")) > 1:
                assert r.fingerprint == [hashed[r.id, p] for p in range(6)]


def test_texts_that_are_not_compared_stay_where_they_are(spark, monkeypatch):
    texts = [" ".join(f"d{i}x{j}" for j in range(20)) for i in range(400)] + [" ".join(f"s{j}" for j in range(60)) + f" e{i}" for i in range(5)]
    passed, thinned = [], jaccard_groups._thinned

    def counted(documents, ids):
        passed.append((table := thinned(documents, ids)).count())
        return table

    monkeypatch.setattr(jaccard_groups, "_thinned", counted)
    found = jaccard_groups.join_similar(spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string"), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == {i: min(i, 400) for i in range(405)}
    assert 5 <= sum(passed) <= 100
