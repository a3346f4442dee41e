"""Row conditions of a metric query. All are conjunctive and built from plain expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.values import is_float, named, type_of

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "in", "not_in", "contains", "between")


@dataclass(frozen=True)
class Condition:
    """column, operator, value.

    `=` on text ignores case; `!=` and `not_in` keep rows whose value is missing; `contains` is a
    regular expression that ignores case, or plain text with `literal`. For `in` and `not_in` the
    value may be a one-column DataFrame.
    """

    column: str
    operator: str
    value: Any
    literal: bool = False

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator '{self.operator}'")

    @property
    def against_table(self) -> bool:
        return isinstance(self.value, DataFrame)

    def expression(self, df: DataFrame) -> Column:
        col, value = named(self.column), self.value
        dtype = type_of(df, self.column)

        def ordered(test: Column) -> Column:
            # Spark orders NaN above all numbers; a missing value passes no comparison.
            return test & ~F.isnan(col) if is_float(dtype) else test

        match self.operator:
            case "=":
                if isinstance(value, str):
                    return F.lower(col.cast("string")) == value.lower()
                return col == F.lit(value)
            case "!=":
                return ~col.eqNullSafe(F.lit(value))
            case ">":
                return ordered(col > F.lit(value))
            case ">=":
                return ordered(col >= F.lit(value))
            case "<":
                return ordered(col < F.lit(value))
            case "<=":
                return ordered(col <= F.lit(value))
            case "in":
                return col.isin(_given(value))
            case "not_in":
                return ~col.isin(_given(value)) | col.isNull()
            case "between":
                return ordered(col.between(F.lit(value[0]), F.lit(value[1])))
            case _:
                text = col.cast("string")
                if self.literal:
                    return F.contains(F.lower(text), F.lit(str(value).lower()))
                return text.rlike(f"(?iu){value}")

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.against_table:
            return df.filter(self.expression(df))
        listed = self.value.select(named(self.value.columns[0]).alias("_listed"))
        how = "left_semi" if self.operator == "in" else "left_anti"
        return df.join(listed, named(self.column) == F.col("_listed"), how)


def _given(values) -> list:
    """A NULL in a list stands for no value."""
    return [v for v in values if v is not None]


def apply_conditions(df: DataFrame, conditions) -> DataFrame:
    for condition in conditions:
        df = condition.apply(df)
    return df
