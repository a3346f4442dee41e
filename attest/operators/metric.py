"""Metric queries: filter, deduplicate, join, group, aggregate, rank.

A `MetricQuery` is a description; `run` turns it into one DataFrame. Filters and deduplication are
applied to the table that owns the column, before any join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.dates import TimeRange, as_date_value, month_text
from attest.functions.values import addend, is_temporal, named, present, type_of
from attest.operators.duplicates import distinct_rows
from attest.operators.filters import Condition, apply_conditions
from attest.operators.median import median_by

AGGREGATIONS = ("sum", "mean", "median", "min", "max", "count", "count_distinct")
DEDUPLICATED = ("sum", "mean", "count")
JOIN_TYPES = ("inner", "left", "right", "full", "left_semi", "left_anti")


@dataclass(frozen=True)
class Join:
    left_on: str
    right_on: str | None = None


@dataclass(frozen=True)
class MonthOf:
    """Group key: calendar month of a date column, as yyyy-MM."""

    column: str
    name: str = "month"


@dataclass(frozen=True)
class MetricQuery:
    """One aggregate over one table, or over two tables joined on a key.

    `scale` reads the metric as a decimal with that many places, so that sums do not depend on the
    order of rows. `time` filters on `date_column` of the first table.
    """

    tables: tuple[str, ...]
    metric: str
    aggregation: str = "sum"
    filters: tuple[Condition, ...] = ()
    time: TimeRange | None = None
    date_column: str | None = None
    group_by: tuple[str | MonthOf, ...] = ()
    join: Join | None = None
    dedup: bool = False
    ascending: bool = False
    limit: int | None = None
    scale: int | None = None

    def __post_init__(self):
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation '{self.aggregation}'")
        if (len(self.tables) == 2) != (self.join is not None) or len(self.tables) not in (1, 2):
            raise ValueError("one table, or two tables and a join")
        if self.time is not None and self.date_column is None:
            raise ValueError("a time range needs date_column")


def join_tables(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None,
                how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join on keys that may differ in name. NULL keys never match.

    Keys of one name become one column, filled from whichever side has the row. Other columns that both tables
    have get `suffixes`. Rows with a NULL key take no part in the join: outer joins add them afterwards, so that
    they do not all meet in one task.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type '{how}'")
    right_on = right_on or left_on
    shared = left_on.lower() == right_on.lower()
    if how in ("left_semi", "left_anti"):
        return left.join(right.select(named(right_on).alias("_key")), named(left_on) == F.col("_key"), how)
    ours = {c.lower() for c in left.columns}
    theirs = {c.lower() for c in right.columns}
    clash = (ours & theirs) - ({left_on.lower()} if shared else set())
    left_names = {c: c + suffixes[0] if c.lower() in clash else c for c in left.columns}
    right_names = {c: c + suffixes[1] if c.lower() in clash else c for c in right.columns if not (shared and c.lower() == right_on.lower())}
    a = left.select(*[named(c).alias(f"l{i}") for i, c in enumerate(left_names)], named(left_on).alias("lk"))
    b = right.select(*[named(c).alias(f"r{i}") for i, c in enumerate(right_names)], named(right_on).alias("rk"))
    # A left or right join shuffles NULL keys too, but is split where they are many; a full join is not.
    apart = how == "full"
    met = (a.filter("lk is not null") if apart else a).join(b.filter("rk is not null") if apart else b, F.col("lk") == F.col("rk"), how)
    if apart:
        met = met.unionByName(a.filter("lk is null"), allowMissingColumns=True).unionByName(b.filter("rk is null"), allowMissingColumns=True)
    key = left_on.lower()
    return met.select(
        *[(F.coalesce(f"l{i}", "rk") if shared and c.lower() == key else F.col(f"l{i}")).alias(n) for i, (c, n) in enumerate(left_names.items())],
        *[F.col(f"r{i}").alias(n) for i, n in enumerate(right_names.values())])


def combine(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns a table lacks are NULL."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def run(query: MetricQuery, tables: dict[str, DataFrame]) -> DataFrame:
    """Grouped: the group columns and `value`, ranked. Otherwise one row: `value`, `rows_total`,
    `rows_used` and, with dedup, `duplicates_excluded` (copies among the rows used)."""
    sources = [tables[name] for name in query.tables]
    owners = [_prepare(query, sources, i) for i in range(len(sources))]
    if query.group_by:
        result = _grouped(query, owners)
        order = F.col("value").asc_nulls_last() if query.ascending else F.col("value").desc_nulls_last()
        result = result.orderBy(order, *[named(g) for g in _group_names(query)])
        return result.limit(query.limit) if query.limit else result
    return _ungrouped(query, sources[0], owners)


def _group_names(query: MetricQuery) -> list[str]:
    return [g.name if isinstance(g, MonthOf) else g for g in query.group_by]


def _has(df: DataFrame, column: str) -> bool:
    return column.lower() in {c.lower() for c in df.columns}


def _prepare(query: MetricQuery, sources: list[DataFrame], index: int) -> DataFrame:
    """Filtered rows of one table with just the columns the query needs, and their copy count."""
    df = sources[index]
    earlier = sources[:index]

    def owns(column: str) -> bool:
        return _has(df, column) and not any(_has(other, column) for other in earlier)

    df_filtered = apply_conditions(df, [c for c in query.filters if owns(c.column)])
    if query.time is not None and index == 0:
        date = as_date_value(df, query.date_column)
        dtype = type_of(df, query.date_column)
        stamped = dtype if is_temporal(dtype) else None
        df_filtered = df_filtered.filter(query.time.condition(date, stamped))
    needed = {}
    for group in query.group_by:
        column = group.column if isinstance(group, MonthOf) else group
        if owns(column):
            needed[column.lower()] = column
    if owns(query.metric):
        needed[query.metric.lower()] = query.metric
    if query.join is not None:
        key = query.join.left_on if index == 0 else (query.join.right_on or query.join.left_on)
        needed[key.lower()] = key
    columns = list(needed.values())
    if query.dedup and query.aggregation in DEDUPLICATED:
        slim = distinct_rows(df_filtered, columns)
    else:
        slim = df_filtered.select(*[named(c) for c in columns], F.lit(1).alias("_copies"))
    for group in query.group_by:
        if isinstance(group, MonthOf) and owns(group.column):
            slim = slim.withColumn(group.name, month_text(as_date_value(df, group.column)))
    for name in _group_names(query):
        if _has(slim, name):
            slim = slim.filter(named(name).isNotNull())
    return slim


def _number(query: MetricQuery, df: DataFrame) -> Column:
    value = present(df, query.metric)
    if query.aggregation not in ("sum", "mean") and query.scale is None or query.aggregation in ("count", "count_distinct"):
        return value
    return addend(value, type_of(df, query.metric), query.scale)


# Parts of an aggregate: how rows are folded, and how folded parts are merged.
_PARTS = {
    "rows": (lambda v: F.count(F.lit(1)), F.sum),
    "total": (F.sum, F.sum),
    "filled": (F.count, F.sum),
    "low": (F.min, F.min),
    "high": (F.max, F.max),
}
_NEEDS = {"sum": ["total"], "mean": ["total", "filled"], "min": ["low"], "max": ["high"],
          "count": ["filled"], "count_distinct": []}


def _finish(query: MetricQuery, grouped: bool) -> Column:
    match query.aggregation:
        case "sum":
            return F.coalesce(F.col("total"), F.lit(0)).cast("double")
        case "mean":
            return F.try_divide(F.col("total").cast("double"), F.col("filled").cast("double"))
        case "min":
            return F.col("low").cast("double")
        case "max":
            return F.col("high").cast("double")
        case "count":  # rows when ungrouped, non-missing metric values per group
            return F.coalesce(F.col("filled" if grouped else "rows"), F.lit(0))
        case _:
            return F.col("distinct_values")


def _fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size estimate is within its broadcast threshold."""
    plan = df._jdf.queryExecution().optimizedPlan()
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(plan.stats().sizeInBytes())) <= limit


def _joined(query: MetricQuery, owners: list[DataFrame], parts: list[str],
            fold: bool = True) -> tuple[DataFrame, bool]:
    """The joined rows, and whether the left rows are already folded into parts per key.

    A right table within the broadcast threshold is joined row by row, without a shuffle. With a
    larger one the left rows are folded per join key first: a key that holds a third of all rows
    is then one row per task before it is shuffled, and the join reuses the partitioning.
    """
    if len(owners) == 1:
        return owners[0], False
    left, right = owners
    key = query.join.left_on
    right_key = query.join.right_on or key
    slim = right.select(named(right_key).alias("_key"),
                        *[named(c) for c in right.columns if c not in (right_key, "_copies")],
                        *([named(right_key)] if right_key not in left.columns else []))
    folded = fold and _has(left, query.metric) and not _fits_broadcast(slim)
    if folded:
        groups = list(dict.fromkeys([key] + [n for n in _group_names(query) if _has(left, n)]))
        if query.aggregation == "count_distinct":
            left = left.select(*[named(g) for g in groups], _number(query, left).alias("_value")).distinct()
        else:
            left = left.select(*[named(g) for g in groups], _number(query, left).alias("_value")).groupBy(*[named(g) for g in groups]).agg(
                *[_PARTS[p][0](F.col("_value")).alias(p) for p in parts])
    return left.filter(named(key).isNotNull()).join(slim, named(key) == F.col("_key")).drop("_key"), folded


def _folded(query: MetricQuery, owners: list[DataFrame], parts: list[str], groups: list[str], copies: bool = False) -> DataFrame:
    """Parts of the aggregate per group; with `copies` also `excluded`, the copies among the rows of a table that stands alone."""
    rows, folded = _joined(query, owners, parts)
    if query.aggregation == "count_distinct":
        value = F.col("_value") if folded else _number(query, rows)
        return rows.groupBy(*[named(g) for g in groups]).agg(F.count_distinct(value).alias("distinct_values"))
    if folded:
        return rows.groupBy(*[named(g) for g in groups]).agg(*[_PARTS[p][1](F.col(p)).alias(p) for p in parts])
    value = _number(query, rows)
    more = [F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("excluded")] if copies else []
    return rows.groupBy(*[named(g) for g in groups]).agg(*[_PARTS[p][0](value).alias(p) for p in parts], *more)


def _grouped(query: MetricQuery, owners: list[DataFrame]) -> DataFrame:
    groups = _group_names(query)
    if query.aggregation == "median":
        rows, _ = _joined(query, owners, [], fold=False)
        return median_by(rows, groups, query.metric, "value")
    folded = _folded(query, owners, _NEEDS[query.aggregation], groups)
    return folded.select(*[named(g) for g in groups], _finish(query, grouped=True).alias("value"))


def _ungrouped(query: MetricQuery, source: DataFrame, owners: list[DataFrame]) -> DataFrame:
    counts = query.aggregation in ("count", "count_distinct")
    deduplicates = query.dedup and query.aggregation in DEDUPLICATED
    # rows, totals and copies of one table are folded together: its rows are shuffled once
    alone = deduplicates and len(owners) == 1
    zero = F.lit(0).cast("bigint") if counts else F.lit(0.0)
    if query.aggregation in ("median", "count_distinct"):
        rows, _ = _joined(query, owners, [], fold=False)
        used = rows.agg(F.count("*")).scalar()
        if query.aggregation == "median":
            result = median_by(rows, [], query.metric, "value")
        else:
            result = rows.agg(F.count_distinct(_number(query, rows)).alias("value"))
        result = result.withColumn("rows_used", used)
    else:
        parts = list(dict.fromkeys(_NEEDS[query.aggregation] + ["rows"]))
        folded = _folded(query, owners, parts, [], copies=alone)
        result = folded.select(_finish(query, grouped=False).alias("value"),
                               F.coalesce(F.col("rows"), F.lit(0)).alias("rows_used"), *(["excluded"] if alone else []))
    result = result.select(
        F.when(F.col("rows_used") == 0, zero).otherwise(F.col("value")).alias("value"),
        # no column is read for this count: Parquet answers it from the footers
        source.agg(F.count("*")).scalar().alias("rows_total"),
        "rows_used",
        *([F.col("excluded").cast("bigint").alias("duplicates_excluded")] if alone else []),
    )
    if deduplicates and not alone:
        excluded = F.lit(0).cast("bigint")
        for owner in owners:
            excluded = excluded + owner.agg(
                F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0))).scalar()
        result = result.withColumn("duplicates_excluded", excluded)
    return result


def summarize(df: DataFrame, metric: str, keys: list[str] | None = None, scale: int | None = None) -> DataFrame:
    """All seven aggregates of a metric in one scan, and one more for the exact median.

    Columns: value_sum, value_mean, value_median, value_min, value_max, value_count,
    value_distinct, row_count. Rows with a missing key are left out; an empty table gives zeros.
    """
    keys = keys or []
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    value = present(df, metric)
    number = value.cast(f"decimal(18,{scale})") if scale is not None else value
    folded = df.groupBy(*keys).agg(
        F.sum(number).alias("s"), F.count(value).alias("value_count"), F.count(F.lit(1)).alias("row_count"),
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_distinct(value).alias("value_distinct"))
    middle = median_by(df, keys, metric, "value_median")
    if keys:
        folded = folded.join(middle, keys)
    else:
        folded = folded.withColumn("value_median", middle.scalar())

    def filled(column: Column) -> Column:
        return F.when(F.col("row_count") == 0, F.lit(0.0)).otherwise(column.cast("double"))

    return folded.select(
        *keys,
        F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("value_sum"),
        filled(F.try_divide(F.col("s").cast("double"), F.col("value_count").cast("double"))).alias("value_mean"),
        filled(F.col("value_median")).alias("value_median"),
        filled(F.col("lo")).alias("value_min"), filled(F.col("hi")).alias("value_max"),
        "value_count", "value_distinct", "row_count",
    )


def top_per(df: DataFrame, outer: list[str], key: str, value: str) -> DataFrame:
    """The first key by value within each outer group; equal values give the smaller key."""
    best = F.min_by(F.struct(key, value), F.struct(-F.col(value), F.col(key)))
    return df.groupBy(*outer).agg(best.alias("_best")).select(
        *outer, F.col(f"_best.{key}").alias(key), F.col(f"_best.{value}").alias(value))


def growth_by_month(df: DataFrame, date: str, metric: str, keys: list[str] | None = None,
                    scale: int | None = None) -> DataFrame:
    """Monthly totals with the change against the previous calendar month.

    Each total is also sent to the following month, so previous values meet in one aggregate
    and not in an ordered window. Growth is NULL where the previous month has no rows or is 0.
    """
    keys = keys or []
    money = addend(present(df, metric), type_of(df, metric), scale)
    month = F.trunc(as_date_value(df, date), "MM")
    totals = df.select(*keys, month.alias("_m"), money.alias("_v")).filter("_m is not null") \
        .groupBy(*keys, "_m").agg(F.sum("_v").alias("_t"))
    sent = totals.select(*keys, F.explode(F.array(
        F.struct(F.col("_m").alias("m"), F.col("_t").alias("now"),
                 F.lit(None).cast(totals.schema["_t"].dataType).alias("before"), F.lit(1).alias("own")),
        F.struct(F.add_months("_m", 1).alias("m"),
                 F.lit(None).cast(totals.schema["_t"].dataType).alias("now"),
                 F.col("_t").alias("before"), F.lit(0).alias("own")),
    )).alias("_s")).select(*keys, "_s.*")
    met = sent.groupBy(*keys, "m").agg(
        F.max("now").alias("now"), F.max("before").alias("before"), F.max("own").alias("own"))
    value, earlier = F.col("now").cast("double"), F.col("before").cast("double")
    return met.filter("own = 1").select(
        *keys, month_text(F.col("m")).alias("month"), value.alias("value"),
        earlier.alias("previous_value"),
        F.try_divide((F.col("now") - F.col("before")).cast("double"), earlier).alias("growth"),
    )
