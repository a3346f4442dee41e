"""Table files: CSV, TSV, text and Parquet, with encoding choice, rejects and typed errors."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.values import named
from attest.functions.vocab import PREVIEW_ROWS
from attest.sources.records import csv_records, parse_records

FORMATS = {".csv": "csv", ".txt": "csv", ".tsv": "tsv", ".parquet": "parquet"}
REJECT = "_rejected_line"


class SourceError(Exception):
    """A file that cannot be read as a table; the text says why."""


def format_of(path: str) -> str:
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise SourceError(f"unsupported file format '{extension}'; use {', '.join(FORMATS)}")
    return FORMATS[extension]


def choose_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is valid UTF-8 (with or without a byte order mark), else Latin-1."""
    lines = spark.read.text(path)
    invalid = lines.filter(~F.is_valid_utf8("value"))
    return "UTF-8" if invalid.isEmpty() else "ISO-8859-1"


def read_table(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    schema: T.StructType | str | None = None,
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """A table from a file or folder.

    Without a schema the types of a text file are inferred, which reads it once more; give one
    for large files. The encoding "auto" searches the file for invalid UTF-8 first, a scan of its own. A quote
    within quotes is doubled. With `multi_line` quoted values may hold line breaks; byte ranges of such a file are
    still read by many tasks (`records`), each line once more for its quotes.
    """
    kind = format or format_of(path)
    try:
        if kind == "parquet":
            df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
        elif kind in ("csv", "tsv"):
            encoding = choose_encoding(spark, path) if encoding == "auto" else encoding
            if multi_line:
                declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
                return _with_columns(parse_records(csv_records(spark, path, encoding), "\t" if kind == "tsv" else ",", declared), path)
            reader = (
                spark.read.option("header", True)
                .option("sep", "\t" if kind == "tsv" else ",")
                .option("encoding", encoding).option("quote", '"').option("escape", '"')
            )
            reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
            df = reader.csv(path)
        else:
            raise SourceError(f"unsupported format '{kind}'")
    except AnalysisException as error:
        raise SourceError(f"cannot read '{path}': {error.getCondition()}") from error
    return _with_columns(df, path)


def _with_columns(df: DataFrame, path: str) -> DataFrame:
    if not df.columns:
        raise SourceError(f"'{path}' holds no columns")
    return df


@dataclass(frozen=True)
class Checked:
    """Rows that fit the schema, and the raw lines that do not."""

    rows: DataFrame
    rejects: DataFrame


def read_checked(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                 encoding: str = "UTF-8", multi_line: bool = False, header: bool = True) -> Checked:
    """A text file against a declared schema; lines that do not fit go to `rejects`, whole. With `multi_line` these are records,
    found and parsed by many tasks in the same pass."""
    wide = T.StructType(schema.fields + [T.StructField(REJECT, T.StringType())])
    try:
        if multi_line:
            df = parse_records(csv_records(spark, path, encoding), sep, wide, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECT)
        else:
            df = (
                spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
                .option("quote", '"').option("escape", '"')
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECT)
                .schema(wide).csv(path)
            )
    except AnalysisException as error:
        raise SourceError(f"cannot read '{path}': {error.getCondition()}") from error
    # Spark parses only the fields a query needs, so a line would pass when its bad field is not
    # selected; a test that touches every field keeps all of them parsed.
    every_field = F.size(F.array(*[named(f).cast("string") for f in schema.fieldNames()])) > 0
    return Checked(
        rows=df.filter(F.col(REJECT).isNull() & every_field).drop(REJECT),
        rejects=df.filter(F.col(REJECT).isNotNull() & every_field).select(F.col(REJECT).alias("line")),
    )


def undecodable_rows(df: DataFrame) -> DataFrame:
    """Per text column, the rows that hold a replacement character."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    counted = df.agg(*[F.count_if(F.contains(named(n), F.lit("�"))).alias(n) for n in names])
    return counted.unpivot([], [named(n) for n in names], "column", "row_count")


def require_rows(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise SourceError(f"table '{name}' holds no rows")
    return df


def load_tables(spark: SparkSession, paths: dict[str, str], views: bool = False,
                encoding: str = "UTF-8") -> dict[str, DataFrame]:
    """A table set by name; with `views`, also temporary views for SQL."""
    tables = {name: read_table(spark, path, encoding=encoding) for name, path in paths.items()}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def star_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Parquet tables of one folder by name."""
    return {name: read_table(spark, f"{folder}/{name}.parquet") for name in names}


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.limit(rows)
