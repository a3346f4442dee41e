"""Join keys: shared values between same-named columns of many tables, exact or by sketch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.values import is_float, is_temporal, key_text, named
from attest.functions.vocab import OVERLAP_KEEP, OVERLAP_RECOMMEND

# Tables per bit mask.
MASK_BITS = 60


# Classes of columns that can be keys. Those of numbers are compared with each other, the rest within themselves.
KEY_CLASSES = ("integer", "decimal", "float", "text", "date", "timestamp", "boolean")
NUMBERS = ("integer", "decimal", "float")
# Doubles below it are cast to bigint without loss of range.
LEAST_WIDE = 9.2e18


def key_class(dtype: T.DataType) -> str | None:
    """Class of columns that can be keys; nested, binary and interval columns have none."""
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if is_float(dtype):
        return "float"
    if is_temporal(dtype):
        return "date" if isinstance(dtype, T.DateType) else "timestamp"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "text" if isinstance(dtype, T.StringType) else None


def shared_columns(tables: dict[str, DataFrame], classes: tuple[str, ...] = KEY_CLASSES) -> dict[tuple[str, str], list[str]]:
    """(column, class it is compared in) to the tables that hold it, where there are at least two."""
    if unknown := set(classes) - set(KEY_CLASSES):
        raise ValueError(f"no such key classes: {sorted(unknown)}")
    holders: dict[tuple[str, str], list[str]] = {}
    for name in sorted(tables):
        for field in tables[name].schema.fields:
            kind = key_class(field.dataType)
            if kind in classes:
                holders.setdefault((field.name.lower(), "number" if kind in NUMBERS else kind), []).append(name)
    return {key: names for key, names in holders.items() if len(names) > 1}


def _key_cell(col: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """A key in canonical form, as a number or as a text: equal for equal values whatever their type and scale.

    Numbers without a fraction are integers where these reach, so a decimal 7.00 and a double 7.0 are the integer 7. NaN
    is missing.
    """
    kind = key_class(dtype)
    no_number, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    if kind == "text":
        return no_number, key_text(col)
    if kind == "date":
        return F.unix_date(col).cast("bigint"), no_text
    if kind == "timestamp":
        return F.unix_micros(col.cast("timestamp")), no_text
    if kind != "decimal" and kind != "float":
        return col.cast("int").cast("bigint") if kind == "boolean" else col.cast("bigint"), no_text
    own = dtype if kind == "decimal" else T.DoubleType()
    value = col if kind == "decimal" else F.when(~F.isnan(col), col.cast(own))
    whole = value.try_cast("bigint")
    fits = whole.cast(own) == value
    if kind == "float":
        fits = (F.abs(value) < LEAST_WIDE) & fits
    scaled = value.try_cast("decimal(38,18)")
    exact = F.coalesce(scaled.try_cast(own) == value, F.lit(False))
    spelled = value.cast("string")
    if kind == "decimal":
        spelled = F.when(spelled.contains("."), F.rtrim(spelled, F.lit("0"))).otherwise(spelled)
        spelled = F.rtrim(spelled, F.lit("."))
    fits = F.coalesce(fits, F.lit(False))
    return F.when(fits, whole), F.when(~fits, F.when(exact, scaled.cast("string")).otherwise(spelled))


def _cells(tables: dict[str, DataFrame], classes: tuple[str, ...]) -> DataFrame:
    """(column, value, table) for every shared column; NULL values never join and are dropped.

    The table is a bit in one of the masks, so a set of tables is folded by OR.
    """
    shared = shared_columns(tables, classes)
    names = sorted(tables)
    parts = []
    for i, name in enumerate(names):
        cells = []
        for field in tables[name].schema.fields:
            column, kind = field.name.lower(), key_class(field.dataType)
            compared = "number" if kind in NUMBERS else kind
            if kind in classes and name in shared.get((column, compared), ()):
                number, text = _key_cell(named(field.name), field.dataType)
                cells.append(F.struct(F.lit(f"{column}:{compared}").alias("join_key"), number.alias("number"), text.alias("text")))
        bits = {_mask(j): F.lit(1 << (i % MASK_BITS) if _mask(j) == _mask(i) else 0).cast("bigint")
                for j in range(len(names))}
        if cells:
            parts.append(tables[name].select(F.inline(F.array(*cells)))
                         .filter("number is not null or text is not null")
                         .select("*", F.lit(name).alias("table_name"), *[b.alias(m) for m, b in bits.items()]))
    if not parts:
        raise ValueError("no two tables share a column that could be a key")
    return reduce(DataFrame.unionByName, parts)


def _mask(table_index: int) -> str:
    return f"mask{table_index // MASK_BITS}"


def _value_sets(tables: dict[str, DataFrame], classes: tuple[str, ...]) -> DataFrame:
    """Per column and set of tables: how many distinct values exactly those tables hold.

    A hot value is one row per task before the shuffle. The result has one row per set that occurs.
    """
    names = sorted(tables)
    masks = list(dict.fromkeys(_mask(i) for i in range(len(names))))
    held = _cells(tables, classes).groupBy("join_key", "number", "text").agg(*[F.bit_or(m).alias(m) for m in masks])
    counted = held.groupBy("join_key", *masks).agg(F.count("*").alias("n"))
    holders = F.array_compact(F.array(*[
        F.when(F.col(_mask(i)).bitwiseAND(F.lit(1 << (i % MASK_BITS))) != 0, F.lit(name))
        for i, name in enumerate(names)]))
    return counted.select("join_key", holders.alias("held_by"), "n")


def key_overlap(tables: dict[str, DataFrame], classes: tuple[str, ...] = KEY_CLASSES) -> DataFrame:
    """Distinct shared values and containment ratios of all table pairs, in one shuffle of values.

    Pairs are formed only from the counted sets of tables, never from values. Pairs are kept when a
    ratio exceeds 0.1. `classes` chooses which of KEY_CLASSES can be keys.
    """
    counted = _value_sets(tables, classes)
    sizes = counted.select("join_key", F.explode("held_by").alias("table_name"), "n") \
        .groupBy("join_key", "table_name").agg(F.sum("n").alias("size"))
    pairs = (
        counted.select("join_key", "n", "held_by", F.explode("held_by").alias("table_a"))
        .select("join_key", "n", "table_a", F.explode("held_by").alias("table_b"))
        .filter("table_a < table_b")
        .groupBy("join_key", "table_a", "table_b").agg(F.sum("n").alias("overlap_count"))
    )
    # one row per (column, table)
    size_a = F.broadcast(sizes.withColumnsRenamed({"table_name": "table_a", "size": "size_a"}))
    size_b = F.broadcast(sizes.withColumnsRenamed({"table_name": "table_b", "size": "size_b"}))
    rated = pairs.join(size_a, ["join_key", "table_a"]).join(size_b, ["join_key", "table_b"])
    ratio_a = F.col("overlap_count").cast("double") / F.col("size_a")
    ratio_b = F.col("overlap_count").cast("double") / F.col("size_b")
    return _judged(rated, ratio_a, ratio_b).select(
        "table_a", "table_b", F.substring_index("join_key", ":", 1).alias("join_key"),
        "overlap_count", "ratio_a", "ratio_b", "is_recommended")


def _judged(rated: DataFrame, ratio_a, ratio_b) -> DataFrame:
    return rated.filter((ratio_a > OVERLAP_KEEP) | (ratio_b > OVERLAP_KEEP)).select(
        "*",
        F.round(ratio_a, 3).alias("ratio_a"),
        F.round(ratio_b, 3).alias("ratio_b"),
        ((ratio_a > OVERLAP_RECOMMEND) | (ratio_b > OVERLAP_RECOMMEND)).alias("is_recommended"),
    )


def recommended_joins(relationships: DataFrame) -> DataFrame:
    """The best recommended key per table pair: highest ratio, then name."""
    best = F.greatest("ratio_a", "ratio_b")
    return relationships.filter("is_recommended").groupBy("table_a", "table_b").agg(
        F.min_by(F.struct("join_key", "ratio_a", "ratio_b"), F.struct(-best, F.col("join_key"))).alias("k")
    ).select("table_a", "table_b", "k.*")


def _sketched(tables: dict[str, DataFrame], log_size: int, classes: tuple[str, ...]) -> DataFrame:
    """Estimates of sizes and shared values for all table pairs; one row per (column, table) is shuffled, not the values."""
    sketches = _cells(tables, classes).groupBy("join_key", "table_name").agg(
        F.theta_sketch_agg(F.coalesce("text", F.col("number").cast("string")), log_size).alias("sketch"))
    side_a = sketches.withColumnsRenamed({"table_name": "table_a", "sketch": "sketch_a"})
    side_b = sketches.withColumnsRenamed({"table_name": "table_b", "sketch": "sketch_b"})
    met = side_a.join(side_b, "join_key").filter("table_a < table_b")
    return met.select(
        "table_a", "table_b", F.substring_index("join_key", ":", 1).alias("join_key"),
        F.theta_sketch_estimate(F.theta_intersection("sketch_a", "sketch_b")).alias("overlap_count"),
        F.theta_sketch_estimate("sketch_a").alias("size_a"),
        F.theta_sketch_estimate("sketch_b").alias("size_b"),
    )


def key_overlap_sketch(tables: dict[str, DataFrame], log_size: int = 14, classes: tuple[str, ...] = KEY_CLASSES) -> DataFrame:
    """`key_overlap` by theta sketches: one row per (column, table) is shuffled, not the values."""
    sized = _sketched(tables, log_size, classes)
    ratio_a = F.least(F.lit(1.0), F.col("overlap_count").cast("double") / F.col("size_a"))
    ratio_b = F.least(F.lit(1.0), F.col("overlap_count").cast("double") / F.col("size_b"))
    return _judged(sized, ratio_a, ratio_b).drop("size_a", "size_b")


def overlap_bounds(tables: dict[str, DataFrame], log_size: int = 14, classes: tuple[str, ...] = KEY_CLASSES, deviations: float = 3.0) -> DataFrame:
    """Estimated shared values of all table pairs with an interval: table_a, table_b, join_key, estimate, low, high.

    A sketch of a set of n values keeps a share of about k / n of them, so of the shared values it finds that share; the
    interval spans `deviations` standard deviations of that draw. Sets of up to k values are counted exactly.
    """
    sized = _sketched(tables, log_size, classes)
    kept = F.least(F.lit(1.0), F.lit(float(1 << log_size)) / F.greatest("size_a", "size_b"))
    estimate = F.col("overlap_count").cast("double")
    # at least one drawn value's worth of doubt, so that an estimate of 0 has an interval too
    spread = F.lit(deviations) * F.sqrt(F.greatest(estimate, 1 / kept) * (1 - kept) / kept)
    return sized.select("table_a", "table_b", "join_key", estimate.alias("estimate"),
                        F.greatest(F.lit(0.0), estimate - spread).alias("low"), (estimate + spread).alias("high"))
