"""Dates: which columns hold them, their range, the months present and missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.dates import as_date_value, is_ambiguous, month_text
from attest.functions.values import is_temporal, named
from attest.functions.vocab import DATE_PARSE_THRESHOLD


DATE_PROFILE = ("table_name string, column_name string, parse_ratio double, is_date boolean, min_date date, "
                "max_date date, months array<date>, ambiguous_count bigint, ambiguous_example string")


def month_span(first: Column, last: Column) -> Column:
    """All month starts from first to last."""
    return F.sequence(first, last, F.expr("interval 1 month"))


def date_profile(df: DataFrame, table: str) -> DataFrame:
    """Per temporal or text column: share of values that are dates, range, months, ambiguity.

    One aggregate over one scan of those columns. The set of months is bounded by the calendar.
    """
    fields = [f for f in df.schema.fields if is_temporal(f.dataType) or isinstance(f.dataType, T.StringType)]
    if not fields:
        return df.sparkSession.createDataFrame([], DATE_PROFILE)
    # each text is parsed once, in a projection below the aggregate
    parsed = df.select(
        *[named(f.name).alias(f"value{i}") for i, f in enumerate(fields)],
        *[as_date_value(df, f.name).alias(f"date{i}") for i, f in enumerate(fields)],
        *[is_ambiguous(named(f.name)).alias(f"maybe{i}") for i, f in enumerate(fields)
          if isinstance(f.dataType, T.StringType)])
    aggregates = []
    for i, field in enumerate(fields):
        value, date = F.col(f"value{i}"), F.col(f"date{i}")
        aggregates += [
            F.count(value).alias(f"filled{i}"),
            F.count(date).alias(f"parsed{i}"),
            F.to_date(F.min(date)).alias(f"min{i}"),
            F.to_date(F.max(date)).alias(f"max{i}"),
            F.collect_set(F.trunc(date, "MM")).alias(f"months{i}"),
        ]
        if isinstance(field.dataType, T.StringType):
            unsure = F.col(f"maybe{i}")
            aggregates += [F.count_if(unsure).alias(f"unsure{i}"),
                           F.min(F.when(unsure, value)).alias(f"example{i}")]
    folded = parsed.agg(*aggregates)
    structs = []
    for i, field in enumerate(fields):
        text = isinstance(field.dataType, T.StringType)
        ratio = F.try_divide(F.col(f"parsed{i}").cast("double"), F.col(f"filled{i}").cast("double"))
        structs.append(F.struct(
            F.lit(table).alias("table_name"),
            F.lit(field.name).alias("column_name"),
            F.coalesce(ratio, F.lit(0.0)).alias("parse_ratio"),
            (F.coalesce(ratio, F.lit(0.0)) >= DATE_PARSE_THRESHOLD).alias("is_date"),
            F.col(f"min{i}").alias("min_date"),
            F.col(f"max{i}").alias("max_date"),
            F.array_sort(F.col(f"months{i}")).alias("months"),
            (F.col(f"unsure{i}") if text else F.lit(0).cast("bigint")).alias("ambiguous_count"),
            (F.col(f"example{i}") if text else F.lit(None).cast("string")).alias("ambiguous_example"),
        ))
    return folded.select(F.inline(F.array(*structs)))


def date_columns(profile: DataFrame) -> DataFrame:
    """Date columns with their range, present and missing months as yyyy-MM lists."""
    missing = F.array_except(month_span(F.array_min("months"), F.array_max("months")), F.col("months"))
    return profile.filter("is_date and min_date is not null").select(
        "table_name", "column_name", "min_date", "max_date",
        F.transform("months", month_text).alias("present_months"),
        F.array_sort(F.transform(missing, month_text)).alias("missing_months"),
        "ambiguous_count", "ambiguous_example",
    )


def present_months(df: DataFrame, date: str) -> DataFrame:
    """Distinct months that have a row, with their row counts."""
    value = as_date_value(df, date)
    return df.filter(value.isNotNull()).groupBy(month_text(value).alias("month")).agg(
        F.count("*").alias("row_count"))


def missing_months(df: DataFrame, date: str, keys: list[str] | None = None) -> DataFrame:
    """Months between the first and last of each key that have no row.

    The months of a key are first reduced to distinct values, so a list is as long as its
    calendar and not as its rows.
    """
    keys = keys or []
    months = df.select(*keys, F.trunc(as_date_value(df, date), "MM").alias("_m")).filter("_m is not null") \
        .groupBy(*keys, "_m").agg(F.lit(1).alias("_one"))
    held = months.groupBy(*keys).agg(F.collect_list("_m").alias("_held"))
    span = month_span(F.array_min("_held"), F.array_max("_held"))
    return held.select(*keys, F.explode(F.array_except(span, F.col("_held"))).alias("_gap")) \
        .select(*keys, month_text(F.col("_gap")).alias("month"))


def ambiguous_dates(df: DataFrame, column: str) -> DataFrame:
    """Values that read as MM/DD or as DD/MM: count and smallest example."""
    unsure = is_ambiguous(named(column))
    return df.agg(
        F.count(named(column)).alias("value_count"),
        F.count_if(unsure).alias("ambiguous_count"),
        F.min(F.when(unsure, named(column))).alias("example"),
    )
