"""Exact quantiles of whole columns by radix selection.

A number becomes a 64-bit integer that is ordered as the number is. Ranks are found 16 bits at a time: one scan counts
the rows of all columns by the leading bits, the bin that holds a rank is chosen from the running counts, and the
next scan counts only rows that share its bits. No rows are ordered, only the counts of at most BINS bins.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.values import present

DIGIT = 16
BINS = 1 << DIGIT
MANTISSA = 52
_LEAST_EXPONENT = -1022
_BIAS = 1023
_SIDES = ("low", "high")


def with_key(df: DataFrame, value: str, name: str = "key") -> DataFrame:
    """Adds a double as the integer of its bits, negated for negative numbers: ordered as doubles are, -0.0 and 0.0 alike.

    NULL and NaN have none. Dividing by a power of two is exact, so exponent and fraction are. Each step is a projection of its own,
    so that none is computed twice.
    """
    kept = df.columns
    size, power, guess, exponent = (F.col(f"_{n}") for n in ("size", "power", "guess", "exponent"))
    step = df.withColumn("_size", F.abs(F.when(~F.isnan(value), F.col(value))))
    finite = (size > 0) & (size < float("inf"))
    step = step.withColumn("_guess", F.when(finite, F.floor(F.log2(size)).cast("int")).otherwise(0))
    step = step.withColumn("_power", F.pow(F.lit(2.0), guess))
    step = step.withColumn("_exponent", F.greatest(F.when(power > size, guess - 1).when(power * 2 <= size, guess + 1).otherwise(guess), F.lit(_LEAST_EXPONENT)))
    # below the least exponent there is no leading one
    fraction = F.when(finite, (size / F.pow(F.lit(2.0), exponent) * F.lit(float(1 << MANTISSA))).cast("bigint")).otherwise(0)
    bits = F.shiftleft((exponent + (_BIAS - 1)).cast("bigint"), MANTISSA) + fraction
    step = step.withColumn("_bits", F.when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), F.lit(0x7FF << MANTISSA).cast("bigint")).otherwise(bits))
    return step.select(*kept, F.when(size.isNotNull(), F.when(F.col(value) < 0, -F.col("_bits")).otherwise(F.col("_bits"))).alias(name))


def key_value(key: int) -> float:
    """The double that an order key stands for."""
    size = struct.unpack(">d", struct.pack(">q", abs(key)))[0]
    return -size if key < 0 else size


def _chosen(counts: DataFrame, targets: DataFrame) -> list:
    """The bin that holds each target's rank, and the rank within it. At most BINS rows meet for a prefix.

    Targets without a rank get it from the number of rows; two rows for each column and probability reach the driver.
    """
    whole = Window.partitionBy("column_id", "prefix")
    running = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("upto", F.sum("rows").over(running)).withColumn("n", F.sum("rows").over(whole))
    place = (F.col("n") - 1) * F.col("p")
    met = placed.join(F.broadcast(targets), ["column_id", "prefix"]).withColumn("rank", F.coalesce(
        "rank", F.when(F.col("side") == "low", F.floor(place)).otherwise(F.ceil(place)) + 1))
    met = met.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("rows")))
    return met.select("column_id", "probability_id", "side", "bin", (F.col("rank") - F.col("upto") + F.col("rows")).alias("rank"), "rows", "n").collect()


def quantiles(df: DataFrame, columns: list[str], probabilities: tuple[float, ...]) -> DataFrame:
    """Exact interpolated quantiles (column_name, probability, quantile_value) of numeric columns, missing values skipped.

    All columns and probabilities share each scan, of which there are at most four; the last one comes as soon as no more than BINS
    rows are left in any chosen bin. A column without values has NULL quantiles. Values are read as doubles.
    """
    if not columns or not probabilities:
        raise ValueError("quantiles need a column and a probability")
    spark = df.sparkSession
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("column_id"), present(df, name).cast("double").alias("value")) for i, name in enumerate(columns)])))
    cells = with_key(cells.filter("value is not null"), "value").select("column_id", "key")
    target = "column_id int, probability_id int, side string, p double, prefix bigint, rank bigint"
    targets = [(c, i, side, float(p), 0, None) for c in range(len(columns)) for i, p in enumerate(probabilities) for side in _SIDES]
    shift, lower, totals = 64, 64 - DIGIT, {}
    while True:
        frame = spark.createDataFrame(targets, target)
        if shift == 64:
            near = cells.withColumn("prefix", F.lit(0).cast("bigint"))
        else:
            near = cells.withColumn("prefix", F.shiftright("key", shift)).join(
                F.broadcast(frame.select("column_id", "prefix").distinct()), ["column_id", "prefix"], "left_semi")
        counts = near.groupBy("column_id", "prefix", F.shiftright("key", lower).alias("bin")).agg(F.count("*").alias("rows"))
        found = _chosen(counts, frame)
        if shift == 64:
            totals = {r["column_id"]: r["n"] for r in found}
        targets = [(r["column_id"], r["probability_id"], r["side"], float(probabilities[r["probability_id"]]), r["bin"], r["rank"]) for r in found]
        if lower == 0 or not found:
            break
        shift, lower = lower, 0 if max(r["rows"] for r in found) <= BINS else lower - DIGIT
    keys = {(c, i, side): key for c, i, side, _, key, _ in targets}

    def value(c: int, i: int) -> float | None:
        if c not in totals:
            return None
        low, high = (key_value(keys[c, i, side]) for side in _SIDES)
        place = (totals[c] - 1) * float(probabilities[i])
        share = place - math.floor(place)
        return low if low == high else low * (1 - share) + high * share

    rows = [(name, float(p), value(c, i)) for c, name in enumerate(columns) for i, p in enumerate(probabilities)]
    return spark.createDataFrame(rows, "column_name string, probability double, quantile_value double")
