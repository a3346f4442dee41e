"""Expressions on single values: missing tests, NaN handling, row text and digests, tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.vocab import ABS_TOL, REL_TOL

BLANK = r"(?U)^\s*$"
NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def column_class(dtype: T.DataType) -> str:
    """numeric, temporal, nested or categorical; booleans are categorical."""
    if is_numeric(dtype):
        return "numeric"
    if is_temporal(dtype):
        return "temporal"
    return "nested" if is_nested(dtype) else "categorical"


def type_of(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema.fields:
        if field.name.lower() == name.lower():
            return field.dataType
    raise KeyError(f"no column '{name}' in {df.columns}")


def named(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    col = named(name)
    return F.when(~F.isnan(col), col) if is_float(type_of(df, name)) else col


def is_missing(col: Column, dtype: T.DataType) -> Column:
    """NULL, NaN, or a string of white space only."""
    if isinstance(dtype, T.StringType):
        return col.isNull() | col.rlike(BLANK)
    if is_float(dtype):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def addend(col: Column, dtype: T.DataType, scale: int | None = None) -> Column:
    """A number as it is summed: in its own type, integers as decimals so that no total overflows.

    With a `scale` values are rounded to so many decimals, so that totals do not depend on the order of rows.
    """
    if scale is not None:
        return col.cast(f"decimal(18,{scale})")
    return col.cast("decimal(20,0)") if isinstance(dtype, T.IntegralType) else col


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, 0 for an empty whole."""
    share = F.try_divide(part.cast("double") * 100, whole.cast("double"))
    return F.coalesce(F.round(share, 2), F.lit(0.0))


def value_text(col: Column, dtype: T.DataType) -> Column:
    """One text per distinct value, so equal texts mean equal values."""
    if isinstance(dtype, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(col)))
    if is_nested(dtype):
        return F.to_json(col)
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    if is_float(dtype):
        return (col + F.lit(0.0)).cast("string")  # -0.0 equals 0.0
    return col.cast("string")


def key_text(col: Column) -> Column:
    """The text itself if short, else its SHA-256: equal for equal texts, never long to shuffle.

    Kept texts are shorter than a digest, so the two cannot be confused.
    """
    return F.when(F.length(col) < 64, col).otherwise(F.sha2(col, 256))


def row_text(df: DataFrame, names: list[str] | None = None) -> Column:
    """Length-prefixed text of a row: no separator can be faked and NULL differs from ''."""
    parts = []
    for name in names or df.columns:
        text = value_text(named(name), type_of(df, name))
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text),
                                F.lit("~")))
    return F.concat(*parts)


def row_digest(df: DataFrame, names: list[str] | None = None) -> Column:
    """SHA-256 of the row (32 bytes): what duplicate search shuffles in place of whole rows."""
    return F.unhex(F.sha2(row_text(df, names), 256))


def close_to(a: Column, b: Column) -> Column:
    """Numeric equality with tolerance. NaN equals NaN, infinities by sign, NULL equals NULL."""
    a, b = a.cast("double"), b.cast("double")
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    bound = F.greatest(F.lit(REL_TOL) * F.greatest(F.abs(a), F.abs(b)), F.lit(ABS_TOL))
    return F.coalesce(a.eqNullSafe(b) | (finite & (F.abs(a - b) <= bound)), F.lit(False))


def same_value(a: Column, b: Column, dtype: T.DataType) -> Column:
    """Equality of result values: tolerance for floats, exact integers, numeric or trimmed text."""
    if isinstance(dtype, T.IntegralType):
        return a.eqNullSafe(b)
    if is_numeric(dtype):
        return close_to(a, b)
    text_a, text_b = F.trim(a.cast("string")), F.trim(b.cast("string"))
    numeric = F.when(text_a.rlike(NUMBER) & text_b.rlike(NUMBER),
                     close_to(text_a.cast("double"), text_b.cast("double")))
    return text_a.eqNullSafe(text_b) | F.coalesce(numeric, F.lit(False))
