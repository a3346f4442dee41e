"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.values import named, present
from attest.session import broadcast_if_small

ACCURACY = 100_000
# The bracket is five times as wide as the stated rank error of percentile_approx.
MARGIN = 5.0 / ACCURACY


def quantile_by(df: DataFrame, keys: list[str], value: str, probability: float,
                name: str = "quantile_value") -> DataFrame:
    """Exact interpolated quantile per key, missing values skipped.

    `percentile` keeps every distinct value of a group in one task. Here an approximate bracket
    around the rank comes first; rows below it are only counted, and just the distinct values
    inside it, about 1 in 10,000 of a group, are ordered. The result is exact: a rank outside the
    bracket, which the stated error rules out, is an error and never a guess. Quantiles of whole columns of any size,
    many at once, are in `quantiles`.
    """
    given, keys = keys, [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[named(g).alias(k) for g, k in zip(given, keys)], present(df, value).alias("_v"))
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    edges = [max(probability - MARGIN, 0.0), min(probability + MARGIN, 1.0)]
    bracket = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", edges, ACCURACY).alias("_b"))
    bracket = broadcast_if_small(bracket.select(
        *keys, "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi")))
    if keys:
        placed = rows.join(bracket, keys)
    else:
        placed = rows.select("_v", *[bracket.select(c).scalar().alias(c) for c in ("_n", "_lo", "_hi")])
    inside = (
        placed.filter(F.col("_v") <= F.col("_hi"))
        # all rows below the bracket fall into one counted NULL value
        .select(*keys, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
        .groupBy(*keys, "_n", "_v").agg(F.count("*").alias("_c"))
    )
    running = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("_upto", F.sum("_c").over(running))

    def at(rank):
        hit = F.col("_v").isNotNull() & (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank)
        return F.max(F.when(hit, F.col("_v"))).cast("double")

    place = (F.col("_n") - 1) * F.lit(probability)
    picked = ranked.groupBy(*keys, "_n").agg(
        at(F.floor(place) + 1).alias("_low"), at(F.ceil(place) + 1).alias("_high"))
    missed = F.col("_low").isNull() | F.col("_high").isNull()
    share = place - F.floor(place)
    result = picked.select(*keys, F.when(
        missed, F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"),
    ).otherwise(F.col("_low") * (1 - share) + F.col("_high") * share).alias(name))
    # groups without any value have no row left inside the bracket
    empty = bracket.filter(F.col("_n") == 0).select(*keys, F.lit(None).cast("double").alias(name))
    return result.unionByName(empty).toDF(*given, name)


def median_by(df: DataFrame, keys: list[str], value: str, name: str = "median_value") -> DataFrame:
    """Exact median per key: the mean of the middle two."""
    return quantile_by(df, keys, value, 0.5, name)
