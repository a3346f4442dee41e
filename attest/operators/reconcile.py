"""Agreement of totals between tables, of results between runs, and sanity of results.

Two results are compared by stacking them and folding on the key, never by joining them: a key
missing on one side, repeated on one side or NULL is one group like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.money_units import is_currency_column
from attest.functions.values import addend, is_float, is_numeric, present, same_value, type_of
from attest.functions.vocab import CONTRADICTION_RATIO, REVENUE_WORDS
from attest.operators.position import with_position


def revenue_column(df: DataFrame, words: list[str] = REVENUE_WORDS) -> str | None:
    """The first numeric column that names revenue."""
    for field in df.schema.fields:
        if any(word in field.name.lower() for word in words):
            return field.name if is_numeric(field.dataType) else None
    return None


def metric_totals(tables: dict[str, DataFrame], metrics: dict[str, str], metric: str = "revenue",
                  currencies: dict[str, str] | None = None, scale: int | None = None) -> DataFrame:
    """One total per table: table_name, metric, column_name, currency, value."""
    parts = []
    for name, column in metrics.items():
        money = addend(present(tables[name], column), type_of(tables[name], column), scale)
        parts.append(tables[name].agg(F.coalesce(F.sum(money), F.lit(0)).alias("value")).select(
            F.lit(name).alias("table_name"), F.lit(metric).alias("metric"),
            F.lit(column).alias("column_name"), F.lit((currencies or {}).get(name, "UNKNOWN")).alias("currency"),
            F.col("value").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def contradictions(totals: DataFrame) -> DataFrame:
    """Pairs of tables in one currency whose totals differ by more than 5 % of the larger.

    `column_a` and `column_b` are the columns the totals come from, where `totals` tells them.
    """
    if "column_name" not in totals.columns:
        totals = totals.withColumn("column_name", F.lit(None).cast("string"))
    a = totals.select(F.col("table_name").alias("table_a"), "metric", F.upper("currency").alias("currency"),
                      F.col("value").alias("value_a"), F.col("column_name").alias("column_a"))
    b = totals.select(F.col("table_name").alias("table_b"), "metric", F.upper("currency").alias("currency"),
                      F.col("value").alias("value_b"), F.col("column_name").alias("column_b"))
    gap = F.abs(F.col("value_a") - F.col("value_b"))
    ratio = gap / F.greatest("value_a", "value_b", F.lit(1.0))
    return a.join(b, ["metric", "currency"]).filter("table_a < table_b").filter(
        (ratio > CONTRADICTION_RATIO) & (F.least("value_a", "value_b") > 0)
    ).select("table_a", "table_b", "metric", "value_a", "value_b", gap.alias("difference"),
             F.round(ratio * 100, 2).alias("difference_pct"), "column_a", "column_b")


def compare_grouped_totals(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value",
                           ratio: float = CONTRADICTION_RATIO) -> DataFrame:
    """Totals of two sources per key, and whether they contradict."""
    met = _stacked(left, right, keys, [value])
    a, b = F.col(f"left_{value}"), F.col(f"right_{value}")
    gap = F.abs(a - b)
    share = gap / F.greatest(a, b, F.lit(1.0))
    return met.select(
        *keys, a.alias("value_a"), b.alias("value_b"), gap.alias("difference"),
        F.coalesce((share > ratio) & (F.least(a, b) > 0), F.lit(False)).alias("contradicts"))


def _stacked(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key: rows and values of each side, folded in one shuffle."""
    sides = left.select(*keys, *values, F.lit(True).alias("_left")).unionByName(
        right.select(*keys, *values, F.lit(False).alias("_left")))
    folds = [F.count_if("_left").alias("left_rows"), F.count_if(~F.col("_left")).alias("right_rows")]
    for v in values:
        folds += [F.max(F.when(F.col("_left"), F.col(v))).alias(f"left_{v}"),
                  F.max(F.when(~F.col("_left"), F.col(v))).alias(f"right_{v}")]
    return sides.groupBy(*keys).agg(*folds)


def compare_results(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keyed comparison: one row per key with its status and the first value that differs.

    Status: match, differs, only_left, only_right, repeated_key. Floats agree within tolerance,
    integers exactly, numbers written as text as numbers, other text after trimming.
    """
    met = _stacked(left, right, keys, values)
    differing = F.lit(None).cast("string")
    for v in reversed(values):
        same = same_value(F.col(f"left_{v}"), F.col(f"right_{v}"), type_of(left, v))
        differing = F.when(~same, F.lit(v)).otherwise(differing)
    status = (
        F.when((F.col("left_rows") > 1) | (F.col("right_rows") > 1), "repeated_key")
        .when(F.col("right_rows") == 0, "only_left")
        .when(F.col("left_rows") == 0, "only_right")
        .when(differing.isNotNull(), "differs")
        .otherwise("match")
    )
    sides = [F.col(f"{side}_{v}") for v in values for side in ("left", "right")]
    return met.select(*keys, *sides, status.alias("status"),
                      F.when(status == "differs", differing).alias("first_difference"))


def mismatches(compared: DataFrame) -> DataFrame:
    return compared.filter("status <> 'match'")


def summary(compared: DataFrame) -> DataFrame:
    """One row: keys compared, keys per status, overall agreement."""
    return compared.agg(
        F.count("*").alias("key_count"),
        *[F.count_if(F.col("status") == s).alias(s)
          for s in ("match", "differs", "only_left", "only_right", "repeated_key")],
        (F.count_if(F.col("status") != "match") == 0).alias("agrees"),
    )


def compare_ordered(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str],
                    values: list[str]) -> DataFrame:
    """Position-by-position comparison in a declared order; a longer side shows as only_left/right."""
    def placed(df: DataFrame, order: list[str]) -> DataFrame:
        return with_position(df.select(*dict.fromkeys(order + values)), order).select("position", *values)

    a, b = placed(left, order_left), placed(right, order_right)
    return compare_results(a, b, ["position"], values)


def rerun(compute: Callable[[DataFrame], DataFrame], source: DataFrame, columns: list[str],
          keys: list[str], values: list[str]) -> DataFrame:
    """Runs a computation twice, independently, and compares the results by key.

    The second run reads the source again and spreads the columns it needs evenly over other
    partitions, so rows are folded in another order. Nothing is cached between the runs.
    """
    first = compute(source.select(*columns))
    second = compute(source.select(*columns).hint("rebalance"))
    return compare_results(first, second, keys, values)


def sanity_flags(result: DataFrame, value: str = "value", rows: str | None = "rows_used") -> DataFrame:
    """Warnings on result values: not finite, missing (a division by zero), not positive, empty filter."""
    col = F.col(value)
    odd = F.isnan(col) | (F.abs(col) == float("inf")) if is_float(type_of(result, value)) else F.lit(False)
    empty = F.col(rows) == 0 if rows else F.lit(False)
    return result.select(
        "*",
        F.coalesce(odd, F.lit(False)).alias("is_not_finite"),
        col.isNull().alias("is_missing"),
        F.coalesce((col <= 0) & ~odd, F.lit(False)).alias("is_not_positive"),
        empty.alias("is_empty_filter"),
    )


def unknown_literals(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Values asked for in a filter that the column never holds."""
    literal = wanted.columns[0]
    return wanted.join(df.select(F.col(column).alias("_held")), F.col(literal) == F.col("_held"), "left_anti")
