"""CSV records that span lines, read by many tasks.

A line feed ends a record unless it stands within quotes, and whether it does depends on all quotes before it in the
file. So each byte range first counts its quotes; the running sum over ranges tells in which state every range begins, and
the running sum within a range does so for every line. Lines that are records by themselves stay where they are. Only lines of
longer records are grouped, those that cross a range's end by file.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.session import broadcast_if_small, checkpointed

QUOTE = '"'
BYTE_ORDER_MARK = "﻿"


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, range, at, line, odd): lines with the byte range they begin in and their place in it."""
    text = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value") if encoding.upper() in ("UTF-8", "US-ASCII") else F.decode(F.col("value").cast("binary"), encoding)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("at"), line.alias("line"), (quotes % 2).cast("int").alias("odd"))


def _joined_lines(*order: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Records of CSV files (file, record, is_header): the first record of each file is its header.

    Lines end with a line feed, or carriage return and line feed; other breaks are part of a value, and are kept as they are. A quote within quotes is
    doubled, so records are found by counting quotes; one that is never closed reaches to the end of its file.
    Files without such records are not shuffled. The encoding must use one byte for a quote and a line feed.
    """
    if encoding.upper().replace("-", "").replace("_", "").startswith(("UTF16", "UTF32", "UCS")):
        raise ValueError(f"records of '{encoding}' are not found by bytes")
    lines = _lines(spark, path, encoding)
    ranges = lines.groupBy("file", "range").agg((F.sum("odd") % 2).alias("turns"), F.sum("odd").alias("odd_lines"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each byte range
    ranges = broadcast_if_small(ranges.select(
        F.col("file").alias("_file"), F.col("range").alias("_range"), "first", "odd_lines",
        (F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2).cast("int").alias("begins")))
    placed = lines.join(ranges, (F.col("file") == F.col("_file")) & (F.col("range") == F.col("_range")))
    if not ranges.agg(F.sum("odd_lines")).first()[0]:
        header = (F.col("range") == 0) & (F.col("at") == F.col("first"))
        return placed.select("file", _ended(F.col("line"), header).alias("record"), header.alias("is_header"))

    order = Window.partitionBy("file", "range").orderBy("at")
    earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stated = placed.withColumn("inside", (F.col("begins") + F.coalesce(F.sum("odd").over(earlier), F.lit(0))) % 2).withColumn(
        "number", F.sum((F.col("inside") == 0).cast("bigint")).over(so_far))
    alone = (F.col("inside") == 0) & (F.col("odd") == 0)
    header = (F.col("range") == 0) & (F.col("number") == 1)
    single = stated.filter(alone).select("file", _ended(F.col("line"), header).alias("record"), header.alias("is_header"))
    # number 0: lines of a record that an earlier range opened; an odd sum: a record that a later range closes
    pieces = stated.filter(~alone).groupBy("file", "range", "number").agg(_joined_lines("at").alias("line"), (F.sum("odd") % 2).alias("odd"))
    pieces = checkpointed(pieces)
    cut = (F.col("number") == 0) | (F.col("odd") == 1)
    whole = pieces.filter(~cut).select("file", _ended(F.col("line"), header).alias("record"), header.alias("is_header"))
    opened = Window.partitionBy("file").orderBy("range", "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = pieces.filter(cut).withColumn("record_id", F.sum((F.col("number") > 0).cast("bigint")).over(opened))
    crossing = crossing.groupBy("file", "record_id").agg(_joined_lines("range", "number").alias("line"), F.bool_or(header).alias("is_header"))
    return single.unionByName(whole).unionByName(crossing.select("file", _ended(F.col("line"), F.col("is_header")).alias("record"), "is_header"))


def _ended(text: Column, header: Column) -> Column:
    """Without the carriage return before the line feed that ended it, and a header without byte order mark."""
    text = F.when(F.endswith(text, F.lit("\r")), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(header & F.startswith(text, F.lit(BYTE_ORDER_MARK)), F.substring(text, 2, 1 << 30)).otherwise(text)


def header_names(text: str, sep: str) -> list[str]:
    """Column names of a header record; empty names and names that occur before, but for case, get their place."""
    names = next(csv.reader(io.StringIO(text), delimiter=sep), [])
    lowered = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def parse_records(records: DataFrame, sep: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """Records as a table. Without a schema the names come from the header of the first file and the types from all records,
    which reads them once more; with one, the header is passed over."""
    spark = records.sparkSession
    rows = getattr(records.filter("not is_header").select("record")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())

    def reader():
        found = spark.read.option("sep", sep).option("quote", QUOTE).option("escape", QUOTE).option("multiLine", True).option("header", False)
        for name, value in options.items():
            found = found.option(name, value)
        return found

    if schema is None:
        first = records.filter("is_header").orderBy("file").select("record").first()
        names = header_names(first["record"], sep) if first else []
        inferred = DataFrame(reader().option("inferSchema", True)._jreader.csv(rows), spark).schema.fields
        kinds = [f.dataType for f in inferred] + [T.StringType()] * len(names)
        schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
        if not names:
            return spark.createDataFrame([], schema)
    return DataFrame(reader().schema(schema)._jreader.csv(rows), spark)
