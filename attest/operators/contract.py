"""Declared tables: conformance of columns and types, and identities between metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.values import ABS_TOL, addend, is_numeric, is_temporal, present, type_of

CONTRACT_TYPES = ("string", "datetime", "integer", "float")


@dataclass(frozen=True)
class TableContract:
    """What a table promises: column types, currency, units, metric definitions, authority."""

    table: str
    columns: dict[str, str]
    currency: str = "UNKNOWN"
    units: dict[str, str] = field(default_factory=dict)
    glossary: dict[str, str] = field(default_factory=dict)
    authoritative: bool = True

    def __post_init__(self):
        unknown = set(self.columns.values()) - set(CONTRACT_TYPES)
        if unknown:
            raise ValueError(f"unknown contract types {sorted(unknown)}")


def contract_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if is_numeric(dtype):
        return "float"
    return "datetime" if is_temporal(dtype) else "string"


def contract_violations(contract: TableContract, profile: DataFrame) -> DataFrame:
    """Missing, extra and mistyped columns of a table, from its column profile."""
    spark = profile.sparkSession
    expected = spark.createDataFrame(
        [(name.lower(), kind) for name, kind in contract.columns.items()],
        "column_name string, expected_type string")
    kind = (
        F.when(F.col("data_type").isin("tinyint", "smallint", "int", "bigint"), "integer")
        .when(F.col("column_class") == "numeric", "float")
        .when(F.col("column_class") == "temporal", "datetime")
        .otherwise("string")
    )
    actual = profile.select(F.lower("column_name").alias("column_name"), kind.alias("actual_type"))
    met = expected.join(actual, "column_name", "full")
    problem = (
        F.when(F.col("actual_type").isNull(), "missing column")
        .when(F.col("expected_type").isNull(), "extra column")
        .when(F.col("expected_type") != F.col("actual_type"), "wrong type")
    )
    return met.select(F.lit(contract.table).alias("table_name"), "column_name", "expected_type",
                      "actual_type", problem.alias("problem")).filter("problem is not null")


def metric_identity(df: DataFrame, metric: str, *factors: str, tolerance: float = ABS_TOL,
                    scale: int | None = None) -> DataFrame:
    """Rows checked against metric = product of factors: checked, broken, largest difference.

    Compared in the columns' own types; with a `scale` as decimals rounded to it.
    """
    product = None
    for name in factors:
        value = addend(present(df, name), type_of(df, name), scale)
        product = value if product is None else product * value
    difference = F.abs(addend(present(df, metric), type_of(df, metric), scale) - product)
    return df.agg(
        F.count(difference).alias("checked_rows"),
        F.count_if(difference > (F.lit(tolerance) if scale is None else F.lit(tolerance).cast("decimal(18,9)"))).alias("broken_rows"),
        F.coalesce(_reported(F.max(difference), scale), F.lit(0)).cast("double").alias("max_difference"),
    )


def _reported(difference: Column, scale: int | None) -> Column:
    """Binary fractions are reported to the nine decimals of the tolerance."""
    return difference if scale is not None else F.round(difference, 9)
