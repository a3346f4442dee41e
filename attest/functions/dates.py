"""Date texts: shape-checked parsing, ambiguity of day and month, calendar filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.values import is_temporal, named, type_of

# Shape of the text, and the format it is read with. The shape is tested first: parsing a text
# that does not fit is far dearer than a regular expression. Month first where both would do.
DATE_SHAPES = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^(1[3-9]|2\d|3[01]|0?[1-9]|1[0-2])-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "d/M/yyyy H:mm"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "d/M/yyyy H:mm:ss"),
    # ISO times, with fractions and offsets, as Spark reads them itself
    (r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?$", None),
]
AMBIGUOUS = r"^(0*(?:[1-9]|1[0-2]))/(0*(?:[1-9]|1[0-2]))(?:/|$)"


def parse_date(col: Column) -> Column:
    """Timestamp of a date text, NULL where no known shape fits."""
    text = F.trim(col)
    parsed = F.lit(None).cast("timestamp")
    for shape, pattern in reversed(DATE_SHAPES):
        read = F.try_to_timestamp(text, F.lit(pattern)) if pattern else text.try_cast("timestamp")
        parsed = F.when(text.rlike(shape), read).otherwise(parsed)
    # most texts are too long, or hold no digit, and are left after this test
    return F.when(text.rlike(r"^[\w :,/.+-]{6,35}$") & text.rlike(r"\d"), parsed)


def as_date_value(df: DataFrame, name: str) -> Column:
    """The column itself if temporal, the parsed text otherwise."""
    return named(name) if is_temporal(type_of(df, name)) else parse_date(named(name))


def is_ambiguous(col: Column) -> Column:
    """a/b/... where both could be a month and they differ."""
    parts = [F.regexp_extract(col, AMBIGUOUS, i).cast("int") for i in (1, 2)]
    # the shape is tested first, so the casts see digits only
    return F.when(col.rlike(AMBIGUOUS), parts[0] != parts[1]).otherwise(F.lit(False))


def month_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


@dataclass(frozen=True)
class TimeRange:
    """Calendar filter: bounds are inclusive; month and quarter match in any year.

    `fiscal_offset` is the number of months the fiscal year starts after January; with it,
    month, quarter and year are read on the fiscal calendar.
    """

    start: str | None = None
    end: str | None = None
    year: int | None = None
    month: int | None = None
    quarter: int | None = None
    day: str | None = None
    fiscal_offset: int = 0

    def condition(self, date: Column, dtype: T.DataType) -> Column:
        stamp = "date" if isinstance(dtype, T.DateType) else (
            "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp")

        def literal(text: str) -> Column:
            return F.lit(text).cast(stamp)

        shifted = F.add_months(date, -self.fiscal_offset) if self.fiscal_offset else date
        tests = []
        if self.start is not None:
            tests.append(date >= literal(self.start))
        if self.end is not None:
            tests.append(date <= literal(self.end))
        if self.day is not None:
            tests.append((date >= literal(self.day))
                         & (date < F.date_add(F.lit(self.day).cast("date"), 1).cast(stamp)))
        if self.year is not None:
            if self.fiscal_offset:
                tests.append(F.year(shifted) == self.year)
            else:  # a range, so that files and partitions are skipped
                tests.append((date >= literal(f"{self.year:04d}-01-01"))
                             & (date < literal(f"{self.year + 1:04d}-01-01")))
        if self.month is not None:
            tests.append(F.month(shifted) == self.month)
        if self.quarter is not None:
            tests.append(F.quarter(shifted) == self.quarter)
        result = F.lit(True)
        for test in tests:
            result = result & test
        return result
