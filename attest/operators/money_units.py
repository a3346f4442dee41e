"""Currencies and units of tables, with the rows that show them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.money_units import (
    code_currency,
    is_currency_column,
    name_currency,
    name_unit,
    symbol_currencies,
    unit_dimension,
    value_unit,
)
from attest.functions.values import named
from attest.functions.vocab import UNKNOWN_CURRENCY

FOUND = "table_name string, column_name string, currency string, origin string, row_count bigint"
FOUND_UNIT = "table_name string, column_name string, unit string, origin string, row_count bigint"


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _value_hits(df: DataFrame, cells: list, found: str) -> DataFrame:
    """Counts of (column, found value); rows without a hit are dropped before the shuffle."""
    return df.select(F.inline(F.array(*cells))).select("column_name", "origin", F.explode("hits").alias(found)) \
        .groupBy("column_name", "origin", found).agg(F.count("*").alias("row_count"))


def currency_profile(df: DataFrame, table: str) -> DataFrame:
    """Currencies by table name, column name, code column and symbols in texts.

    A column that names its currency is not searched. A code column reports every code it holds.
    """
    spark = df.sparkSession
    spoken = [(table, None, name_currency(table), "table name", None)] if name_currency(table) else []
    cells = []
    for column in df.columns:
        if name_currency(column):
            spoken.append((table, column, name_currency(column), "column name", None))
        elif column in _text_columns(df):
            by_code = is_currency_column(column)
            code = code_currency(named(column))  # other texts of such a column are no currencies
            hits = F.array_compact(F.array(F.when(code.rlike("^[A-Z]{3}$"), code))) if by_code \
                else symbol_currencies(named(column))
            cells.append(F.struct(F.lit(column).alias("column_name"),
                                  F.lit("code" if by_code else "symbol").alias("origin"),
                                  hits.alias("hits")))
    result = spark.createDataFrame(spoken, FOUND)
    if cells:
        counted = _value_hits(df, cells, "currency")
        result = result.unionByName(counted.select(
            F.lit(table).alias("table_name"), "column_name", "currency", "origin", "row_count"))
    return result


def table_currency(profile: DataFrame, tables: list[str]) -> DataFrame:
    """One row per table: its currency, all its currencies, whether they are several.

    A stated name wins over codes, codes over symbols; within one origin the value on most rows.
    UNKNOWN when nothing is found, never a default.
    """
    rank = F.when(F.col("origin") == "table name", 0).when(F.col("origin") == "column name", 1) \
        .when(F.col("origin") == "code", 2).otherwise(3)
    found = profile.groupBy("table_name").agg(
        F.min_by("currency", F.struct(rank, -F.coalesce("row_count", F.lit(0)), F.col("currency")))
        .alias("currency"),
        F.array_sort(F.collect_set("currency")).alias("currencies"),
    )
    names = profile.sparkSession.createDataFrame([(t,) for t in tables], "table_name string")
    return names.join(found, "table_name", "left").select(
        "table_name",
        F.coalesce("currency", F.lit(UNKNOWN_CURRENCY)).alias("currency"),
        F.coalesce(F.array_join("currencies", ","), F.lit("")).alias("currencies"),
        (F.coalesce(F.size("currencies"), F.lit(0)) > 1).alias("is_multi_currency"),
    )


def currency_codes(df: DataFrame, column: str) -> DataFrame:
    """Codes of a currency column with their row counts."""
    return df.groupBy(code_currency(named(column)).alias("code")).agg(F.count("*").alias("row_count")) \
        .filter(F.col("code").isNotNull())


def unit_profile(df: DataFrame, table: str) -> DataFrame:
    """Units by column name, else by the values of text columns."""
    spark = df.sparkSession
    spoken, cells = [], []
    for column in df.columns:
        if name_unit(column):
            spoken.append((table, column, name_unit(column), "column name", None))
        elif column in _text_columns(df):
            cells.append(F.struct(F.lit(column).alias("column_name"), F.lit("value").alias("origin"),
                                  F.array_compact(F.array(value_unit(named(column)))).alias("hits")))
    result = spark.createDataFrame(spoken, FOUND_UNIT)
    if cells:
        counted = _value_hits(df, cells, "unit")
        result = result.unionByName(counted.select(
            F.lit(table).alias("table_name"), "column_name", "unit", "origin", "row_count"))
    return result.withColumn("dimension", unit_dimension(F.col("unit")))
