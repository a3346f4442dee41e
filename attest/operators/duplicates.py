"""Exact duplicate rows: dropping, counting, sampling, and what they do to a total.

Rows are grouped by what identifies them: numbers and dates as they are, texts by one SHA-256 digest,
so that no shuffle carries whole texts. Copies collapse on the map side: a row repeated millions of
times travels once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.values import addend, named, percent, present, row_digest, type_of
from attest.functions.vocab import DUPLICATE_SAMPLE_ROWS


# Bytes of a value by its type; a text counts 20.
TYPE_BYTES = {"string": 20, "double": 8, "bigint": 8, "date": 4, "int": 4, "float": 4, "boolean": 1,
              "smallint": 2, "tinyint": 1, "timestamp": 8, "timestamp_ntz": 8}
NARROW_ROW = 64
NARROW_NUMBERS = 128


def row_key(df: DataFrame) -> dict[str, Column]:
    """Group keys that are equal exactly for equal rows, and narrow."""
    def width(names: list[str]) -> int:
        return sum(TYPE_BYTES.get(kinds[n], NARROW_NUMBERS) for n in names)

    kinds = dict(df.dtypes)
    numbers = [c for c in df.columns if kinds[c] in TYPE_BYTES and kinds[c] != "string"]
    if width(df.columns) <= NARROW_ROW:
        plain, digested = df.columns, []
    elif width(numbers) <= NARROW_NUMBERS:
        plain, digested = numbers, [c for c in df.columns if c not in numbers]
    else:
        plain, digested = [], df.columns
    key = {f"_key{i}": named(c) for i, c in enumerate(plain)}
    if digested:
        key["_digest"] = row_digest(df, digested)
    return key


def distinct_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per distinct whole row of `df`, with the columns in `keep` and the copy count."""
    key = row_key(df)
    return (
        df.select(*[c.alias(n) for n, c in key.items()], *[named(k) for k in keep])
        # the key fixes the kept columns; as group keys they stay in the hash aggregate
        .groupBy(*key, *[named(k) for k in keep]).agg(F.count("*").alias("_copies"))
        .drop(*key)
    )


def duplicate_profile(df: DataFrame, table: str) -> DataFrame:
    """Row count, rows beyond the first of their kind, percentage and advice."""
    counted = distinct_rows(df, []).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_count"),
    )
    return counted.select(
        F.lit(table).alias("table_name"),
        "row_count",
        "duplicate_count",
        percent(F.col("duplicate_count"), F.col("row_count")).alias("duplicate_pct"),
        (F.col("duplicate_count") > 0).alias("has_duplicates"),
        duplicate_advice(F.col("row_count"), F.col("duplicate_count")).alias("advice"),
    )


def duplicate_advice(rows: Column, duplicates: Column) -> Column:
    return (
        F.when(rows == 0, F.lit("table is empty"))
        .when(duplicates > 0, F.concat(
            duplicates.cast("string"),
            F.lit(" duplicate rows; sums and counts include them unless deduplicated")))
        .otherwise(F.lit("all rows are unique"))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Each repeated row once, with its copy count."""
    key = row_key(df)
    keyed = df.select("*", *[c.alias(n) for n, c in key.items()])
    if "_digest" not in key:
        return df.groupBy(*[named(c) for c in df.columns]).agg(F.count("*").alias("copies")).filter("copies > 1")
    repeated = keyed.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    # only repeated rows travel whole, and their copies collapse before the shuffle
    same = [keyed[k].eqNullSafe(repeated[k]) for k in key]
    held = keyed.join(repeated, same, "left_semi")
    return held.groupBy("_digest", *[named(c) for c in df.columns]).agg(F.count("*").alias("copies")).drop("_digest")


def duplicate_samples(df: DataFrame, rows: int = DUPLICATE_SAMPLE_ROWS) -> DataFrame:
    """The first repeated rows in column order."""
    return duplicate_rows(df).orderBy(*[named(c) for c in df.columns]).limit(rows)


def duplicate_impact(df: DataFrame, metric: str, scale: int | None = None) -> DataFrame:
    """A total with and without exact duplicates, and the difference."""
    money = addend(present(df, metric), type_of(df, metric), scale)
    totals = distinct_rows(df, [metric]).agg(
        F.coalesce(F.sum(money * F.col("_copies")), F.lit(0)).alias("raw"),
        F.coalesce(F.sum(money), F.lit(0)).alias("clean"),
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_raw"),
        F.count("*").alias("rows_clean"),
    )
    return totals.select(
        F.col("rows_raw").cast("bigint").alias("rows_raw"),
        "rows_clean",
        F.col("raw").cast("double").alias("total_raw"),
        F.col("clean").cast("double").alias("total_clean"),
        (F.col("raw") - F.col("clean")).cast("double").alias("difference"),
        percent(F.col("raw") - F.col("clean"), F.col("raw")).alias("difference_pct"),
    )
