"""Minimal keys against all sets of columns, and intervals of estimates."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from attest.operators import keys, overlap, profile

NAMES = ["a", "b.c", "d", "e", "f"]


def by_hand(rows, most):
    found = []
    for n in range(1, most + 1):
        for s in combinations(range(len(NAMES)), n):
            if any(set(k) <= set(s) for k in found) or any(r[i] is None for r in rows for i in s):
                continue
            if rows and len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                found.append(s)
    return {(",".join(NAMES[i] for i in s), len(s)) for s in found}


@pytest.mark.parametrize("seed", range(4))
def test_all_sets(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(8), rng.choice("xyz"), rng.randrange(30), None if seed == 3 and rng.random() < 0.1 else i // 2, rng.random() // 0.1) for i in range(60)]
    if seed == 2:
        rows += rows[:1]
    df = spark.createDataFrame(rows, "a int, `b.c` string, d int, e int, f double")
    found = keys.minimal_keys(df, "t", 4, sets_per_scan=3)
    assert {(r["key_columns"], r["column_count"]) for r in found.collect()} == by_hand(rows, 4)


def test_no_rows_and_nested_columns(spark):
    df = spark.createDataFrame([(1, [1]), (2, [1])], "a int, b array<int>")
    assert [r["key_columns"] for r in keys.minimal_keys(df, "t").collect()] == ["a"]
    assert keys.minimal_keys(df.limit(0), "t").count() == 0


def test_whole_tables_are_counted_by_hashes_set_by_set(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id as a", "id div 2 as b", "id % 2 as c", "id % 50 as d", "cast(id div 50 as string) as e")
    assert keys._repeats(df, ("b",)) and not keys._repeats(df, ("a",)) and not keys._repeats(df, ("b", "c"))
    # hashes that collide are told apart by digests
    assert not keys._repeats(df, ("b", "c"), bits=8) and keys._repeats(df, ("b", "d", "e"), bits=8) == keys._repeats(df, ("b", "d", "e"))
    seen = []
    monkeypatch.setattr(keys, "SLICES", (4096, 30, 10))
    whole, sliced = keys._repeats, keys._repeating
    monkeypatch.setattr(keys, "_repeats", lambda df, s: seen.append(s) or whole(df, s))
    monkeypatch.setattr(keys, "_repeating", lambda df, sets, slices, share: seen.append((share, len(sets))) or sliced(df, sets, slices, share))
    found = {r["key_columns"] for r in keys.minimal_keys(df, "t").collect()}
    assert found == {"a", "b,c", "b,d", "d,e"}
    # no pass over all rows takes several sets, and thin slices come before thick ones
    assert [s for s in seen if isinstance(s[0], str)][0] == ("a",) and [s[0] for s in seen if isinstance(s[0], int)][:2] == [30, 10]


def test_sets_that_share_a_base_take_one_count_of_the_whole_table(spark, monkeypatch):
    rows = [(i // 50, f"q{i % 50}", 0.0, i % 3, 1) for i in range(3000)] + [(0, f"q{i}", 1.0 if i else -0.0, i % 3, i % 2 + 1) for i in range(10)]
    df = spark.createDataFrame(rows, "p int, `q.r` string, x double, y int, z int")
    seen = []
    whole = keys._repeats
    monkeypatch.setattr(keys, "_repeats", lambda df, s: seen.append(s) or whole(df, s))
    # row 0 comes a second time with -0.0, which equals 0.0
    assert keys.minimal_keys(df, "t").count() == 0
    assert [s for s in seen if len(s) == 2] == [("p", "q.r")] and not [s for s in seen if len(s) == 3]
    assert [r["key_columns"] for r in keys.minimal_keys(df.filter("not (p = 0 and `q.r` = 'q0' and y = 0 and z = 1)"), "t").collect()] == ["p,q.r,x"]
    assert not [s for s in seen if len(s) == 3]
    # a base whose hashes collide only keeps more rows
    hashed = keys._code
    monkeypatch.setattr(keys, "_code", lambda df, s: F.pmod(hashed(df, s), F.lit(1000)))
    assert keys._repeating_by_base(df, [("p", "q.r", "x"), ("p", "q.r", "y")], {("p", "q.r"): 0.0})[1] == {("p", "q.r", "x"), ("p", "q.r", "y")}
    assert keys._repeating_by_base(df.filter("z = 1"), [("p", "q.r", "y"), ("p", "q.r", "z")], {("p", "q.r"): 0.0}) == (2 * ({("p", "q.r", "y"), ("p", "q.r", "z")},))


def test_sets_that_repeat_in_a_slice_are_not_sketched(spark, monkeypatch):
    df = spark.range(6000).selectExpr("id as a", "id div 4 as b", "id % 1500 as c", "id % 1499 as d", "cast(id % 1000 as string) as e")
    seen = []
    sketched = keys._estimates
    monkeypatch.setattr(keys, "SLICES", (4096, 15, 8))
    monkeypatch.setattr(keys, "_estimates", lambda df, sets: seen.append(list(sets)) or sketched(df, sets))
    assert {r["key_columns"] for r in keys.minimal_keys(df.drop("a"), "t").collect()} == {"b,c", "b,d", "b,e", "c,d", "d,e"}
    assert [len(s) for sets in seen for s in sets] == [1, 1, 1, 1]


@pytest.mark.parametrize("seed", range(3))
def test_all_sets_by_slices_and_bases(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(300), rng.choice("xyz"), rng.randrange(700), i // 2, rng.choice((0.0, -0.0, 0.5, 1.5))) for i in range(4000)]
    df = spark.createDataFrame(rows, "a int, `b.c` string, d int, e int, f double")
    monkeypatch.setattr(keys, "SLICES", (40, 20, 4))
    assert {(r["key_columns"], r["column_count"]) for r in keys.minimal_keys(df, "t").collect()} == by_hand(rows, 3)


def test_intervals(spark):
    left = spark.range(60_000).selectExpr("id as k", "id % 7 as m")
    right = spark.range(30_000, 100_000).selectExpr("id as k", "cast(null as bigint) as m")
    bounds = {(r["table_a"], r["join_key"]): r for r in overlap.overlap_bounds({"l": left, "r": right}, log_size=10).collect()}
    assert bounds["l", "k"]["low"] <= 30_000 <= bounds["l", "k"]["high"] and bounds["l", "k"]["high"] < 2 * bounds["l", "k"]["low"]
    columns = {r["column_name"]: r for r in profile.distinct_bounds(left, "l").collect()}
    assert columns["k"]["low"] <= 60_000 <= columns["k"]["high"] and columns["m"]["low"] <= 7 <= columns["m"]["high"] < 9
