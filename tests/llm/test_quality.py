"""Naive Bayes support vectors against plain counting and a reference optimum, and held-out accuracy."""

import os
import zlib

import numpy as np
import pytest

from attest.llm import quality, queries


def good_text(i):
    return f"The reader {i} opens a calm book. She turns page {i % 7} and smiles at the plain words there."


def bad_text(i):
    return (f"BUY!! NOW!! CODE{i}!! " * 6, f"word{i} word{i} word{i} word{i} word{i} word{i}", f"a%%% b{i}### c&&& d*** e$$$")[i % 3]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, good_text(i), 1) for i in range(120)] + [(1000 + i, bad_text(i), 0) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_buckets_are_the_distinct_grams():
    text = "Ab ab 1."
    assert quality.Buckets()(text).tolist() == quality.Buckets()(text).tolist()
    assert set(quality.Buckets()("xy").tolist()) != set(quality.Buckets()("yx").tolist())
    chars = {int(g) for part in quality._grams(np.array([7, 8, 7, 8], np.uint32), 2, 1) for g in part}
    assert len(chars) == 4  # 7, 8, 78, 87
    assert len(quality.Buckets()("")) == 0 and len(quality.Buckets()(" \n ")) > 0


def test_ratios_equal_plain_counting():
    rows, good = [np.array([1, 2]), np.array([2]), np.array([2, 3])], np.array([True, True, False])
    found = quality.log_ratios(rows, good)
    n = quality.DIMENSIONS
    assert found[2] == pytest.approx(np.log(3 / (n + 3)) - np.log(2 / (n + 2)))
    assert found[1] == pytest.approx(np.log(2 / (n + 3)) - np.log(1 / (n + 2)))
    assert found[9] == pytest.approx(np.log(1 / (n + 3)) - np.log(1 / (n + 2)))


def test_descent_reaches_the_optimum():
    """The primal objective equals the dual one at the optimum, and no small step lowers it."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    good = np.array([(r < 14).sum() + rng.integers(0, 2) > 3 for r in rows])
    ratios = np.zeros(quality.DIMENSIONS)
    ratios[:40] = rng.normal(size=40)
    weights, constant = quality.dual_coordinate_descent(rows, good, ratios, passes=3000, least=1e-7)
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.linalg.norm(ratios[r])
    x[:, 40] = 1
    y = np.where(good, 1, -1)
    cost = np.where(good, 60 / (2 * good.sum()), 60 / (2 * (~good).sum()))

    def primal(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    w = np.append(weights[:40], constant)
    best = primal(w)
    for _ in range(300):
        assert primal(w + rng.normal(size=41) * 1e-3) > best - 1e-6


def test_held_out_texts_and_ties(labelled):
    model = quality.learn(labelled, labelled.filter("doc_id % 4 != 2"))
    rows = {r["doc_id"]: r for r in quality.score(labelled, model).collect()}
    assert all((r[quality.SCORE] >= 0.7) == (r["quality"] == 1) for r in rows.values() if r["doc_id"] % 4 == 2)
    again = quality.learn(labelled.repartition(5), labelled.filter("doc_id % 4 != 2"))
    assert np.array_equal(model.weights, again.weights) and model.curve == again.curve


def test_odd_texts_and_names(odd_documents, labelled):
    model = quality.learn(labelled, labelled)
    odd = odd_documents.withColumnRenamed("vertex", quality.SCORE).withColumnRenamed("key", "net.key")
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r[quality.SCORE] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"] or "", set()).add(r[quality.SCORE])
    assert all(len(s) == 1 for s in by_text.values())
    assert quality.score(odd.limit(0), model).count() == 0


def test_few_labels(spark, labelled):
    only_good = quality.learn(labelled, labelled.filter("quality = 1"))
    assert [r[0] for r in quality.score(labelled, only_good).select(quality.SCORE).distinct().collect()] == [pytest.approx(121 / 122)]
    none = quality.learn(labelled, labelled.limit(0))
    assert {round(r[0], 3) for r in quality.score(labelled, none).select(quality.SCORE).distinct().collect()} == {0.5}
    torn = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert quality.learn(labelled, torn).curve == none.curve
    two = labelled.filter("doc_id in (1, 1001)")
    assert all(0 <= r[quality.SCORE] <= 1 for r in quality.score(two, quality.learn(two, two)).collect())


def test_bound_on_the_sample(labelled):
    small = quality.learn(labelled, labelled, most_texts=10)
    scored = {r["doc_id"]: r[quality.SCORE] for r in quality.score(labelled, small).collect()}
    assert np.mean([scored[i] for i in range(120)]) > np.mean([scored[1000 + i] for i in range(60)])


def test_query_on_held_out_labels(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    rows = queries.QUERIES["op11_quality"](spark, folder).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = ([r["score"] for r in held if truth[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
