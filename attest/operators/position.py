"""Row positions in a declared order without bringing an ordered group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.session import broadcast_if_small, checkpointed

# monotonically_increasing_id holds the partition above the row number.
ROW_BITS = 33


def with_position(
    df: DataFrame,
    order: list[str],
    keys: list[str] | None = None,
    name: str = "position",
) -> DataFrame:
    """Adds the 1-based position of each row within its key, in the given order.

    Rows are range-partitioned on (keys, order), so one hot key spreads over many tasks; only the
    per-partition counts meet in a window, at most one row per (key, partition). The ranges are
    sampled, so the ranged rows are checkpointed before they are read twice.
    """
    keys = keys or []
    ordering = [F.col(c).asc_nulls_first() for c in keys + order]
    ranged = df.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
    row_id = F.monotonically_increasing_id()
    tagged = checkpointed(ranged.withColumn("_row", row_id)).select(
        "*",
        F.shiftright("_row", ROW_BITS).alias("_slice"),
        F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_in_slice"),
    ).drop("_row")
    counts = tagged.groupBy(*keys, "_slice").agg(
        F.count("*").alias("_rows"), F.min("_in_slice").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = broadcast_if_small(counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_s"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    ))
    match: Column = F.col("_slice") == F.col("_s")
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    return tagged.join(offsets, match).select(
        *df.columns, (F.col("_in_slice") + F.col("_shift")).alias(name))
