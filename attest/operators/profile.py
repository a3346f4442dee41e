"""Profiles of tables: one row per column, one row per table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.dates import as_date_value
from attest.functions.values import (
    addend,
    column_class,
    is_float,
    is_missing,
    is_nested,
    is_numeric,
    is_temporal,
    key_text,
    named,
    percent,
    present,
    value_text,
)
from attest.functions.vocab import DATE_PARSE_THRESHOLD, ID_WORDS_NUMERIC, ID_WORDS_TEXT, NOT_ID_WORDS
from attest.operators.duplicates import row_key
from attest.operators.quantiles import quantiles

# Log size of the distinct-count sketches (1.6 % standard error), and the share of distinct values
# from which a column is counted exactly: far more than ten standard errors below unique.
SKETCH_SIZE = 12
SCREEN_SHARE = 0.8


def _rows_from_one(df: DataFrame, structs: list) -> DataFrame:
    """The one row of `df` unfolded into one row per struct."""
    return df.select(F.inline(F.array(*structs)))


def distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Exact distinct non-missing values per column: column_name, distinct_count.

    Every value becomes one narrow (column, text) row that is combined before the shuffle.
    """
    schema = {f.name: f.dataType for f in df.schema.fields}
    cells = [
        F.struct(F.lit(name).alias("column_name"),
                 key_text(value_text(present(df, name), schema[name])).alias("value"))
        for name in names
    ]
    return (
        df.select(F.inline(F.array(*cells))).filter("value is not null")
        .groupBy("column_name", "value").agg(F.lit(1).alias("one"))
        .groupBy("column_name").agg(F.count("*").alias("distinct_count"))
    )


def column_profile(df: DataFrame, table: str, distinct: str = "approx", scale: int | None = None) -> DataFrame:
    """Type, class, missing values, distinct values and numeric range of every column.

    One aggregate over one scan. `distinct` is "approx" (in the same scan) or "exact" (a shuffle of
    the distinct values). `scale` sums floats as decimals, so that the mean does not depend on the
    order of rows.
    """
    # values are cleaned once, in a projection below the aggregate
    fields = df.schema.fields
    cleaned = df.select(
        *[present(df, f.name).alias(f"value{i}") for i, f in enumerate(fields)],
        *[is_missing(named(f.name), f.dataType).alias(f"blank{i}") for i, f in enumerate(fields)])
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, field in enumerate(fields):
        value = F.col(f"value{i}")
        aggregates.append(F.count_if(f"blank{i}").alias(f"missing{i}"))
        if distinct == "approx" and not is_nested(field.dataType):
            # a sketch is one binary value; the buffers of approx_count_distinct are 52 numbers a column
            hashed = F.when(value.isNotNull(), F.xxhash64(value))
            aggregates.append(F.hll_sketch_estimate(F.hll_sketch_agg(hashed, SKETCH_SIZE)).alias(f"distinct{i}"))
        if is_numeric(field.dataType):
            exact = is_float(field.dataType) and scale is not None
            summed = addend(value, field.dataType, scale if exact else None)
            aggregates += [F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}"),
                           F.sum(summed).alias(f"sum{i}"), F.count(value).alias(f"filled{i}")]
    folded = cleaned.agg(*aggregates)
    none = F.lit(None)
    structs = []
    for i, field in enumerate(df.schema.fields):
        numeric = is_numeric(field.dataType)
        counted = distinct == "approx" and not is_nested(field.dataType)
        structs.append(F.struct(
            F.lit(table).alias("table_name"),
            F.lit(field.name).alias("column_name"),
            F.lit(i + 1).alias("position"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.lit(column_class(field.dataType)).alias("column_class"),
            F.col("n").alias("row_count"),
            F.col(f"missing{i}").alias("missing_count"),
            percent(F.col(f"missing{i}"), F.col("n")).alias("missing_pct"),
            (F.coalesce(f"distinct{i}", F.lit(0)) if counted else none.cast("bigint")).alias("distinct_count"),
            (F.col(f"min{i}") if numeric else none).cast("double").alias("min_value"),
            (F.col(f"max{i}") if numeric else none).cast("double").alias("max_value"),
            (F.try_divide(F.col(f"sum{i}").cast("double"), F.col(f"filled{i}").cast("double"))
             if numeric else none.cast("double")).alias("mean_value"),
        ))
    rows = _rows_from_one(folded, structs)
    if distinct == "approx":
        return rows
    plain = [f.name for f in df.schema.fields if not is_nested(f.dataType)]
    exact = distinct_counts(df, plain)
    # one row per column of the schema
    joined = rows.drop("distinct_count").join(F.broadcast(exact), "column_name", "left")
    return joined.withColumn("distinct_count", F.coalesce(F.col("distinct_count"), F.when(
        F.col("column_name").isin(plain), F.lit(0)))).select(*rows.columns)


def distinct_bounds(df: DataFrame, table: str, deviations: float = 3.0) -> DataFrame:
    """Estimated distinct values of every column with an interval: table_name, column_name, estimate, low, high.

    The standard error of a merged sketch is 1.04 / sqrt(2 ** SKETCH_SIZE); the interval spans `deviations` of it, and one value.
    """
    error = F.lit(deviations * 1.04 / 2 ** (SKETCH_SIZE / 2))
    estimate = F.col("distinct_count").cast("double")
    return column_profile(df, table).filter("distinct_count is not null").select(
        "table_name", "column_name", estimate.alias("estimate"),
        F.greatest(F.lit(0.0), estimate / (1 + error) - 1).alias("low"), (estimate / (1 - error) + 1).alias("high"))


def missing_profile(df: DataFrame, table: str) -> DataFrame:
    """Missing values per column, the column report: NULL, NaN and white space."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(is_missing(named(f.name), f.dataType)).alias(f"missing{i}")
        for i, f in enumerate(df.schema.fields)])
    return _rows_from_one(counts, [
        F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"),
                 F.col("n").alias("row_count"), F.col(f"missing{i}").alias("missing_count"),
                 percent(F.col(f"missing{i}"), F.col("n")).alias("missing_pct"))
        for i, f in enumerate(df.schema.fields)])


def missing_summary(profile: DataFrame) -> DataFrame:
    """Per table: columns with missing values, fully empty columns, total missing cells."""
    some = F.col("missing_count") > 0
    full = some & (F.col("missing_count") == F.col("row_count"))
    return profile.groupBy("table_name").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(some, F.col("column_name")))), ",")
        .alias("columns_with_missing"),
        F.array_join(F.array_sort(F.collect_list(F.when(full, F.col("column_name")))), ",")
        .alias("empty_columns"),
        F.sum("missing_count").alias("total_missing"),
    )


def names_an_id(name: str, numeric: bool) -> bool:
    """Whether a column name speaks of an identifier; `id` must be a word of its own."""
    lowered = name.lower()
    if numeric and any(word in lowered for word in NOT_ID_WORDS):
        return False
    words = ID_WORDS_NUMERIC if numeric else ID_WORDS_TEXT
    return any(re.search(r"(^|_)id(_|$)", lowered) if word == "id" else word in lowered for word in words)


def id_candidates(df: DataFrame, table: str) -> DataFrame:
    """Identifier and primary-key candidates per column.

    Approximate distinct counts decide which columns could be unique; only those are counted
    exactly. The screen reads one row per column on the driver.
    """
    plain = [f for f in df.schema.fields if not is_nested(f.dataType)]
    screen = column_profile(df.select(*[named(f.name) for f in plain]), table)
    near = [row["column_name"] for row in screen.collect()
            if row["distinct_count"] >= SCREEN_SHARE * (row["row_count"] - row["missing_count"])
            and row["row_count"] > 0]
    filled = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count(present(df, f.name)).alias(f"filled{i}") for i, f in enumerate(plain)])
    rows = _rows_from_one(filled, [
        F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"),
                 F.lit(is_numeric(f.dataType)).alias("numeric"),
                 F.lit(names_an_id(f.name, is_numeric(f.dataType))).alias("named"),
                 F.col("n"), F.col(f"filled{i}").alias("filled"))
        for i, f in enumerate(plain)])
    if near:
        rows = rows.join(F.broadcast(distinct_counts(df, near)), "column_name", "left")
    else:
        rows = rows.withColumn("distinct_count", F.lit(None).cast("bigint"))
    unique = F.coalesce(F.col("distinct_count") == F.col("n"), F.lit(False)) & (F.col("n") > 0)
    candidate = F.when(F.col("numeric"), F.col("named") & unique).otherwise(
        (F.col("named") | unique) & (F.col("n") > 0))
    return rows.select(
        "table_name", "column_name",
        candidate.alias("is_id_candidate"),
        (candidate & unique & (F.col("filled") == F.col("n"))).alias("is_pk_candidate"),
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per composite key that repeats; empty when the keys identify rows."""
    return df.groupBy(*[named(k) for k in keys]).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def column_quantiles(df: DataFrame, table: str, columns: list[str],
                     probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles of numeric columns, long form; all of them share each scan."""
    return quantiles(df, columns, probabilities).select(
        F.lit(table).alias("table_name"), "column_name", "probability", "quantile_value")


def table_profile(df: DataFrame, table: str) -> DataFrame:
    """Rows, columns, duplicates, missing cells and missing months of a table, in two scans.

    Copies of a row miss the same cells, so duplicates and missing cells share one aggregate.
    """
    missing = sum((F.when(is_missing(named(f.name), f.dataType), 1).otherwise(0)
                   for f in df.schema.fields), F.lit(0))
    key = row_key(df)
    folded = (
        df.select(*[c.alias(n) for n, c in key.items()], missing.alias("m")).groupBy(*key, "m")
        .agg(F.count("*").alias("c"))
        .agg(F.coalesce(F.sum("c"), F.lit(0)).alias("row_count"),
             F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_count"),
             F.coalesce(F.sum(F.col("c") * F.col("m")), F.lit(0)).alias("missing_cells"))
    )
    gaps = F.lit(0)
    dated = [f for f in df.schema.fields if is_temporal(f.dataType) or isinstance(f.dataType, T.StringType)]
    if dated:
        # a text column counts if it passes as a date column
        read = df.select(*[named(f.name).alias(f"v{i}") for i, f in enumerate(dated)],
                         *[as_date_value(df, f.name).alias(f"d{i}") for i, f in enumerate(dated)])
        gap_row = read.agg(*[F.when(F.count(f"d{i}") >= DATE_PARSE_THRESHOLD * F.count(f"v{i}"), _month_gaps(f"d{i}")).otherwise(0)
                             .alias(f"g{i}") for i in range(len(dated))])
        gaps = gap_row.select(sum((F.col(f"g{i}") for i in range(len(dated))), F.lit(0)).alias("gaps")).scalar()
    return folded.select(
        F.lit(table).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        "duplicate_count",
        percent(F.col("duplicate_count"), F.col("row_count")).alias("duplicate_pct"),
        "missing_cells",
        F.coalesce(gaps, F.lit(0)).cast("bigint").alias("missing_months"),
    )


def _month_gaps(name: str):
    """Months between the first and last that have no row; the set is bounded by the calendar."""
    month = F.trunc(name, "MM")
    span = F.months_between(F.max(month), F.min(month)) + 1
    return F.coalesce((span - F.count_distinct(month)).cast("bigint"), F.lit(0))


def table_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """Profiles of a table set, one row per table."""
    result = None
    for name, df in tables.items():
        part = table_profile(df, name)
        result = part if result is None else result.unionByName(part)
    return result


def portfolio_totals(profiles: DataFrame) -> DataFrame:
    """Tables, rows, columns, duplicates and missing cells over all tables."""
    return profiles.agg(
        F.count("*").alias("table_count"),
        *[F.sum(c).alias(c) for c in ("row_count", "column_count", "duplicate_count", "missing_cells")],
    )


def table_health(profiles: DataFrame) -> DataFrame:
    """'clean' or the list of issues, per table."""
    issues = F.array_compact(F.array(
        F.when(F.col("duplicate_count") > 0,
               F.concat(F.col("duplicate_count").cast("string"), F.lit(" duplicate rows"))),
        F.when(F.col("missing_cells") > 0,
               F.concat(F.col("missing_cells").cast("string"), F.lit(" missing values"))),
        F.when(F.col("missing_months") > 0,
               F.concat(F.col("missing_months").cast("string"), F.lit(" missing months"))),
    ))
    return profiles.select(
        "table_name",
        F.when(F.size(issues) == 0, F.lit("clean")).otherwise(F.array_join(issues, "; ")).alias("health"),
    )
