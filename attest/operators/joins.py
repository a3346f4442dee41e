"""Reports on a join without running it: match rate, fan-out, and what it does to a total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.values import addend, is_float, percent, present, type_of


def join_report(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None,
                metric: str | None = None, scale: int | None = None) -> DataFrame:
    """One row: rows and total of `metric` (a left column) before and after an inner join.

    Both sides are folded to one row per key and meet in one aggregate, so neither a hot key nor
    a fan-out is ever multiplied out.
    """
    money = addend(present(left, metric), type_of(left, metric), scale) if metric else F.lit(0).cast("decimal(18,0)")
    zero = F.lit(0).cast("bigint")
    ours = left.select(F.col(left_on).alias("k"), money.alias("v")).groupBy("k").agg(
        F.count("*").alias("left_rows"), F.coalesce(F.sum("v"), F.lit(0)).alias("total"))
    theirs = right.groupBy(F.col(right_on or left_on).alias("k")).agg(F.count("*").alias("right_rows"))
    met = (
        ours.select("k", "left_rows", zero.alias("right_rows"), "total")
        .unionByName(theirs.select("k", zero.alias("left_rows"), "right_rows",
                                   F.lit(0).cast(ours.schema["total"].dataType).alias("total")))
        .groupBy("k").agg(F.sum("left_rows").alias("l"), F.sum("right_rows").alias("r"),
                          F.sum("total").alias("t"))
    )
    # NULL keys never match
    r = F.when(F.col("k").isNotNull(), F.col("r")).otherwise(0)
    folded = met.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.when(r > 0, F.col("l"))), F.lit(0)).alias("matched_rows"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("l"))), F.lit(0)).alias("null_key_rows"),
        F.count_if((r > 0) & (F.col("l") == 0)).alias("right_only_keys"),
        F.coalesce(F.max(r), F.lit(0)).alias("max_right_copies"),
        F.coalesce(F.sum(F.col("l") * r), F.lit(0)).alias("joined_rows"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.col("t") * (r if is_float(ours.schema["total"].dataType) else r.cast("decimal(18,0)"))), F.lit(0)).alias("after"),
    )
    return folded.select(
        "left_rows", "right_rows", "matched_rows",
        percent(F.col("matched_rows"), F.col("left_rows")).alias("match_pct"),
        "null_key_rows", "right_only_keys", "max_right_copies", "joined_rows",
        (F.col("max_right_copies") > 1).alias("fans_out"),
        F.col("before").cast("double").alias("total_before"),
        F.col("after").cast("double").alias("total_after"),
    )


def unmatched_rows(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None) -> DataFrame:
    """Left rows without a partner, those with a NULL key included."""
    keys = right.select(F.col(right_on or left_on).alias("_key"))
    return left.join(keys, F.col(left_on) == F.col("_key"), "left_anti")
