"""Labels and redaction for text columns, all as built-in expressions over the whole text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest.functions.vocab import (
    DEFAULT_INTENT,
    GROUP_WORDS,
    INTENT_PATTERNS,
    METRIC_LEADS,
    METRIC_WORDS,
    MONTH_NUMBERS,
    NOT_METRICS,
    OPERATION_WORDS,
    SECRET_PATTERNS,
    TOKEN_PATTERN,
)

# (?U): letters of any script are part of a word
YEAR = r"(?U)\b(19|20)[0-9][0-9]\b"


def any_of(words: list[str]) -> str:
    return "(" + "|".join(re.escape(word) for word in words) + ")"


def first_label(text: Column, patterns: dict[str, str], default: str | None) -> Column:
    """Label of the first pattern, in the order given, that the text contains."""
    label = F.lit(default)
    for name, pattern in reversed(list(patterns.items())):
        label = F.when(text.rlike(pattern), F.lit(name)).otherwise(label)
    return label


def intent_label(text: Column) -> Column:
    patterns = {name: "(?U)" + "|".join(parts) for name, parts in INTENT_PATTERNS.items()}
    return F.when(text.isNotNull(), first_label(F.lower(text), patterns, DEFAULT_INTENT))


def month_mention(text: Column) -> Column:
    """Number of the first month of the calendar list that the text names, full names first."""
    lowered = F.lower(text)
    found = F.lit(None).cast("int")
    for name, number in reversed(list(MONTH_NUMBERS.items())):
        found = F.when(lowered.rlike(rf"(?U)\b{name}\b"), F.lit(number)).otherwise(found)
    # One alternation first, so texts that name no month cost one match instead of 23.
    return F.when(lowered.rlike(rf"(?U)\b{any_of(list(MONTH_NUMBERS))}\b"), found)


def months_mentioned(text: Column) -> Column:
    """All month numbers a text names, sorted."""
    hits = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b{any_of(list(MONTH_NUMBERS))}\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(hits, month_number)))


def month_number(name: Column) -> Column:
    entries = [F.lit(part) for pair in MONTH_NUMBERS.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), name)


def mentions_year(text: Column) -> Column:
    return F.lower(text).rlike(YEAR)


def year_mention(text: Column) -> Column:
    return F.when(text.rlike(YEAR), F.regexp_extract(text, YEAR, 0).cast("int"))


def operation_word(text: Column) -> Column:
    patterns = {name: any_of(words) for name, words in OPERATION_WORDS.items()}
    return F.when(text.isNotNull(), first_label(F.lower(text), patterns, "sum"))


NAMED_METRIC = any_of(METRIC_LEADS) + r"\s+([a-zA-Z0-9_\-]+)"


def metric_word(text: Column, default: str = "revenue") -> Column:
    """The first known metric word; else the word after 'average', 'total' and the like; else the default."""
    lowered = F.lower(text)
    named = F.regexp_extract(lowered, NAMED_METRIC, 2)
    known = first_label(lowered, {word: re.escape(word) for word in METRIC_WORDS}, None)
    return F.when(text.isNotNull(), F.coalesce(
        known, F.when(~named.isin("", *NOT_METRICS), named), F.lit(default)))


def group_word(text: Column) -> Column:
    return first_label(F.lower(text), {name: any_of(words) for name, words in GROUP_WORDS.items()}, None)


def redact_secrets(text: Column, tokens: bool = True) -> Column:
    """Key, bearer and password texts replaced; `tokens` adds texts such as token = "..."."""
    for pattern, replacement in SECRET_PATTERNS + ([TOKEN_PATTERN] if tokens else []):
        text = F.regexp_replace(text, "(?i)" + pattern, replacement)
    return text
