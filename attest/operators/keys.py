"""Minimal composite keys: the smallest sets of columns whose values identify the rows of a table."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.values import is_float, is_nested, is_numeric, is_temporal, named, present, row_digest, row_text, type_of, value_text

SKETCH_SIZE = 12
# Four standard errors of a merged sketch of that size.
DOUBT = 4 * 1.04 / 2 ** (SKETCH_SIZE / 2)
SETS_PER_SCAN = 200
SLICES = (4096, 256, 16)
LEAST_SLICE = 100
# A set that at most this share of the rows repeats in can be a base of larger ones.
RARE = 1 / 16
# Hashes of a base that may be sent to every executor, 8 bytes each.
ALIKE_BROADCAST = 1_000_000
HASHES_A_TASK = 500_000
MOST_COLUMNS = 3


def _estimates(df: DataFrame, sets: list[tuple[str, ...]]) -> list[float]:
    """Estimated distinct values of each set of columns, one number for each on the driver."""
    found = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[present(df, c) for c in s]), SKETCH_SIZE)).alias(f"s{i}") for i, s in enumerate(sets)])
    return list(found.first())


def _code(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """64 bits for the values of the columns. Numbers, texts and times are hashed as they are, which takes a fraction of their texts."""
    values = []
    for name in columns:
        dtype = type_of(df, name)
        if is_float(dtype):
            values.append(named(name) + F.lit(0.0).cast(dtype))  # -0.0 equals 0.0
        else:
            plain = is_numeric(dtype) or is_temporal(dtype) or isinstance(dtype, (T.StringType, T.BooleanType, T.BinaryType))
            values.append(named(name) if plain else value_text(named(name), dtype))
    return F.xxhash64(*values)


def _agreeing(df: DataFrame, sets: list[tuple[str, ...]], looked_at: dict[int, Column]) -> set[int]:
    """The numbers of the sets whose digests occur twice among the rows that are looked at for them."""
    used = sorted({c for i in looked_at for c in sets[i]})
    texts = F.array(*[row_text(df, [c]) for c in used])
    # the columns of the sets are a literal, and each column is read once for all of them
    places = F.create_map(*[x for i in looked_at for x in (F.lit(i), F.array(*[F.lit(used.index(c)) for c in sets[i]]))])
    numbers = F.array(*[F.when(met, F.lit(i)) for i, met in looked_at.items()])
    spread = df.select(texts.alias("texts"), F.explode(numbers).alias("set_id")).filter("set_id is not null")
    digest = F.unhex(F.sha2(F.array_join(F.transform(places[F.col("set_id")], lambda i: F.get(F.col("texts"), i)), ""), 256))
    repeated = spread.select("set_id", digest.alias("digest")).groupBy("set_id", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    return {r["set_id"] for r in repeated.select("set_id").distinct().collect()}


def _repeating(df: DataFrame, sets: list[tuple[str, ...]], slices: list[str], share: int) -> dict[int, float]:
    """The numbers of the sets that some values of occur twice in a slice, with the share of its rows that do: one narrow row for each
    row and set is shuffled.

    `slices` names a column of each set; only rows with one in `share` of its values are looked at. Rows that repeat agree in that column,
    so what is found in a slice repeats in the table. Hashes are counted first; a set is named once rows with its least hash that occurs
    twice agree in their digests, so one whose hashes collide may be left out. The table is read once.
    """
    near = {c: F.pmod(F.xxhash64(named(c)), F.lit(share)) == 0 for c in sorted(set(slices))}
    codes = [_code(df, s) for s in sets]
    used = {c for s in sets for c in s}
    # kept apart from the many hashes, so that the filter over all rows stays short code
    rows = df.filter(reduce(Column.__or__, near.values())).select(*[named(c) for c in df.columns if c in used]).persist()
    spread = F.concat(*[F.when(met, F.array(*[F.struct(F.lit(i).alias("set_id"), code.alias("code")) for i, code in enumerate(codes) if slices[i] == c]))
                      .otherwise(F.array().cast("array<struct<set_id:int,code:bigint>>")) for c, met in near.items()])
    counted = rows.select(F.explode(spread).alias("s")).select("s.*").groupBy("set_id", "code").agg(F.count("*").alias("n"))
    twice = F.col("n") > 1
    found = counted.groupBy("set_id").agg(F.min(F.when(twice, F.col("code"))).alias("least"), (F.sum(F.when(twice, F.col("n"))) / F.sum("n")).alias("share"))
    try:
        found = {r["set_id"]: r for r in found.filter(F.col("least").isNotNull()).collect()}
        agreeing = _agreeing(rows, sets, {i: near[slices[i]] & (codes[i] == F.lit(r["least"])) for i, r in found.items()}) if found else set()
    finally:
        rows.unpersist()
    return {i: found[i]["share"] for i in agreeing}


def _twice(df: DataFrame, code: Column, name: str) -> DataFrame:
    """The hashes that occur twice, as column `name`.

    Most occur once, so folding them before the shuffle takes time and spills. They are dealt out first, with a bounded number of rows to a task.
    """
    parts = max(1, df.count() // HASHES_A_TASK)
    return df.select(code.alias(name)).repartition(parts, name).groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").select(name)


def _repeats(df: DataFrame, columns: tuple[str, ...], bits: int = 64) -> bool:
    """Whether some values of the columns occur twice in the whole table: 64 bits for each row are shuffled, not its values.

    Rows with different hashes differ, so no hash that occurs twice settles it. The least hash that does is looked at by its digests; where
    these differ (a collision), digests decide on all rows.
    """
    code = F.shiftrightunsigned(_code(df, columns), 64 - bits)
    least = _twice(df, code, "code").agg(F.min("code")).first()[0]
    if least is None:
        return False

    def met(rows: DataFrame) -> bool:
        digests = rows.select(row_digest(df, list(columns)).alias("digest"))
        return not digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()

    return met(df.filter(code == least)) or met(df)


def _alike(df: DataFrame, base: tuple[str, ...], columns: list[str]) -> DataFrame:
    """The rows, with `columns` only, whose hash over the base occurs twice: all rows that agree in the base, or in any set that holds it."""
    name = "code" + "_" * max(map(len, df.columns))
    codes = _twice(df, _code(df, base), name).persist()
    few = F.broadcast(codes) if codes.count() <= ALIKE_BROADCAST else codes
    rows = df.join(few, _code(df, base) == F.col(name), "left_semi").select(*[named(c) for c in columns]).persist()
    rows.count()
    codes.unpersist()
    return rows


def _repeating_by_base(df: DataFrame, sets: list[tuple[str, ...]], rare: dict[tuple[str, ...], float]) -> tuple[set, set]:
    """The sets that are settled by way of a base, and those of them that repeat.

    A base is one of the `rare` sets, those that few rows repeat in, and is held by two or more of the sets. Rows that repeat in a set repeat
    in its base, so one count of all rows for the base and one of its few repeated rows for all sets that hold it take the place of a count for each.
    """
    settled, repeating = set(), set()
    while True:
        held: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for s in sets:
            for base in combinations(s, len(s) - 1):
                if s not in settled and base in rare:
                    held.setdefault(base, []).append(s)
        base = min(held, key=lambda b: (-len(held[b]), rare[b]), default=None)
        if base is None or len(held[base]) < 2:
            return settled, repeating
        own = held[base]
        rows = _alike(df, base, [c for c in df.columns if any(c in s for s in own)])
        repeating.update(own[i] for i in _agreeing(rows, own, {i: F.lit(True) for i in range(len(own))}))
        rows.unpersist()
        settled.update(own)


def minimal_keys(df: DataFrame, table: str, most_columns: int = MOST_COLUMNS, sets_per_scan: int = SETS_PER_SCAN) -> DataFrame:
    """Sets of at most `most_columns` columns that identify every row, none of which holds a smaller such set: table_name, key_columns
    (joined by commas, in the table's order), column_count.

    Columns with missing values are in no key; a table without rows has none. Sets are tried by size. A set that holds a
    key is passed over, and one whose columns have too few distinct values together. All others are looked at in thin slices of the rows, up to
    `sets_per_scan` sets in a scan; sketches are filled for those whose slices had few values, and only sets that may be unique are counted
    exactly: by way of a base they share, or one by one after a thicker slice. What reaches the driver is a few numbers for each set.
    """
    fields = [f.name for f in df.schema.fields if not is_nested(f.dataType)]
    counts = df.agg(F.count(F.lit(1)), *[F.count(present(df, c)) for c in fields]).first()
    rows, columns = counts[0], [c for c, filled in zip(fields, counts[1:]) if filled == counts[0]]
    keys: list[tuple[str, ...]] = []
    distinct: dict[str, float] = {}
    rare: dict[tuple[str, ...], float] = {}
    shares = [share for share in SLICES if rows >= share * LEAST_SLICE]

    def unrepeated(near: list[tuple[str, ...]], share: int) -> list[tuple[str, ...]]:
        repeating = _repeating(df, near, [max(s, key=distinct.__getitem__) for s in near], share) if near else {}
        rare.update({near[i]: repeated for i, repeated in repeating.items() if repeated <= RARE})
        return [s for i, s in enumerate(near) if i not in repeating]

    for size in range(1, most_columns + 1 if rows else 1):
        sets = [s for s in combinations(columns, size) if not any(set(k) <= set(s) for k in keys)
                and (size == 1 or prod(distinct[c] for c in s) >= rows)]
        open_sets: list[tuple[str, ...]] = []
        for start in range(0, len(sets), sets_per_scan):
            near = sets[start : start + sets_per_scan]
            # most sets that are no keys show it in a slice, from thin to thick
            for share in shares[:-1] if size > 1 else ():
                near = unrepeated(near, share)
            # a slice of many values that shows no repeat says more than a sketch
            tried = [s for s in near if size == 1 or not any(max(distinct[c] for c in s) >= share * LEAST_SLICE for share in shares[:-1])]
            estimates = dict(zip(tried, _estimates(df, tried))) if tried else {}
            if size == 1:
                distinct.update({s[0]: e * (1 + DOUBT) + 1 for s, e in estimates.items()})
            open_sets += [s for s in near if s not in estimates or estimates[s] * (1 + DOUBT) + 1 >= rows]
        settled, repeating = _repeating_by_base(df, open_sets, rare)
        # the rest is looked at in the thickest slice and counted over all rows, one by one
        left = [s for s in open_sets if s not in settled]
        for share in shares[-1:] if size > 1 else ():
            left = [s for at in range(0, len(left), sets_per_scan) for s in unrepeated(left[at : at + sets_per_scan], share)]
        for s in left:
            settled.add(s)
            if _repeats(df, s):
                repeating.add(s)
                rare[s] = 0.0
        keys += [s for s in open_sets if s in settled and s not in repeating]
    found = [(table, ",".join(k), len(k)) for k in keys]
    return df.sparkSession.createDataFrame(found, "table_name string, key_columns string, column_count int")
