"""Currencies and units, from names and from values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest.functions.vocab import (
    CURRENCY_KEYWORDS,
    CURRENCY_SYMBOLS,
    UNIT_DIMENSIONS,
    UNITS,
    UNKNOWN_CURRENCY,
)


def _longest_first(words) -> str:
    return "|".join(re.escape(word) for word in sorted(words, key=lambda w: (-len(w), w)))


SYMBOL = f"({_longest_first(CURRENCY_SYMBOLS)})"
CURRENCY_NAME = rf"(?<![a-z])({_longest_first(CURRENCY_KEYWORDS)})s?(?![a-z])"
UNIT_NAME = rf"[_(\[]({_longest_first(UNITS)})(?![a-z0-9])"
UNIT_VALUE = rf"(?i)^\s*[-+]?\d+(?:\.\d+)?\s*({_longest_first(UNITS)})\s*$"


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, NULL for other keys. The key is evaluated once."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)


def name_currency(name: str) -> str | None:
    """Currency that a table or column name states as a word of its own."""
    hit = re.search(CURRENCY_NAME, name.lower())
    return CURRENCY_KEYWORDS[hit.group(1)] if hit else None


def is_currency_column(name: str) -> bool:
    return "currency" in name.lower()


def symbol_currency(text: Column) -> Column:
    """Currency of the first symbol in the text; A$ and C$ are read before $."""
    return lookup(F.regexp_extract(text, SYMBOL, 1), CURRENCY_SYMBOLS)


def symbol_currencies(text: Column) -> Column:
    """All currencies whose symbols the text holds; NULL for none."""
    hits = F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(1))
    found = F.transform(F.array_distinct(hits), lambda s: lookup(s, CURRENCY_SYMBOLS))
    return F.when(text.rlike(SYMBOL), F.array_sort(found))


def code_currency(text: Column) -> Column:
    """Code column: trimmed upper case, blank and UNKNOWN are no code."""
    code = F.upper(F.trim(text))
    return F.when(~code.isin("", "NONE", UNKNOWN_CURRENCY), code)


def name_unit(name: str) -> str | None:
    """Unit that a column name carries: _kg, (kg) or [kg]."""
    hit = re.search(UNIT_NAME, name.lower())
    return UNITS[hit.group(1)] if hit else None


def value_unit(text: Column) -> Column:
    """Unit of a text that is one number followed by a unit."""
    return F.when(text.rlike(UNIT_VALUE), lookup(F.lower(F.regexp_extract(text, UNIT_VALUE, 1)), UNITS))


def unit_dimension(unit: Column) -> Column:
    return lookup(unit, UNIT_DIMENSIONS)
