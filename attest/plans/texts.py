"""Labels and redaction over whole text columns."""

from pyspark.sql import functions as F

from attest.functions import text
from attest.functions.vocab import (
    GROUP_WORDS,
    INTENT_PATTERNS,
    METRIC_LEADS,
    METRIC_WORDS,
    MONTH_NUMBERS,
    NOT_METRICS,
    OPERATION_WORDS,
)
from attest.plans.registry import query

SENTENCES = [
    "What will revenue be next year?", "Why did sales drop in March 2025?", "Should we sell more units?",
    "What was the total revenue in August?", "How many orders came in Sept 2024, by region?",
    "What is the average price per product category?", "Which item had the lowest profit?",
    "May I see the highest monthly quantity?", "What caused churn in jan?", "Is it worth it?",
    "Count the customers by area", "Show EBITDA for Dec 1999", "Revenue between February and July",
    "What do you think of the bounce rate?", "Totals are projected for 2027", "Customer satisfaction by month",
    "Mean discount by area", "Total orders in May", "Max of tax_rate per item", "What is the total customer count?",
]
# One sentence per turn, before the text of the turn.
ASKED = "concat({array}[(conv_id * 7 + turn) % " + str(len(SENTENCES)) + "{shift}], ' ', text)"
LISTED = ", ".join(f"'{s}'" for s in SENTENCES)
ASKED_SQL = f"(SELECT conv_id, turn, lower({ASKED.format(array=f'[{LISTED}]', shift=' + 1')}) AS q FROM conversations)"


def asked(t):
    return t.conversations.select("conv_id", "turn", F.expr(
        ASKED.format(array=f"array({LISTED})", shift="")).alias("question"))


def _word(pattern: str) -> str:
    """A pattern with word bounds for the SQL side, where \\b knows ASCII letters only."""
    start, end = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
    return pattern.replace(r"\b", start, 1).replace(r"\b", end, 1)


def _case(tests: dict[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{label}'" for label, test in tests.items()) + f" ELSE {default} END"


INTENT_SQL = _case({
    name: " OR ".join(f"regexp_matches(q, '{_word(p)}')" for p in patterns) for name, patterns in INTENT_PATTERNS.items()
}, "'historical_analytics'")


@query(f"SELECT conv_id, turn, {INTENT_SQL} AS intent FROM {ASKED_SQL}")
def intent_labels(t):
    return asked(t).select("conv_id", "turn", text.intent_label(F.col("question")).alias("intent"))


MONTH_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(q, '{_word(chr(92) + 'b' + name + chr(92) + 'b')}') THEN {number}"
    for name, number in MONTH_NUMBERS.items()) + " END"
YEAR_SQL = _word(r"\b(19|20)[0-9][0-9]\b")


@query(f"""
SELECT conv_id, turn, {MONTH_SQL} AS month, regexp_matches(q, '{YEAR_SQL}') AS has_year FROM {ASKED_SQL}
""")
def month_mentions(t):
    return asked(t).select("conv_id", "turn", text.month_mention(F.col("question")).alias("month"),
                           text.mentions_year(F.col("question")).alias("has_year"))


def _contains(words) -> str:
    return " OR ".join(f"contains(q, '{w}')" for w in words)


NAMED = f"regexp_extract(q, '({'|'.join(METRIC_LEADS)})\\s+([a-zA-Z0-9_\\-]+)', 2)"
NOT_NAMED = ", ".join(f"'{w}'" for w in ["", *NOT_METRICS])
NAMED_SQL = f"CASE WHEN {NAMED} IN ({NOT_NAMED}) THEN 'revenue' ELSE {NAMED} END"


@query(f"""
SELECT conv_id, turn, {_case({n: _contains(w) for n, w in OPERATION_WORDS.items()}, "'sum'")} AS operation,
  {_case({w: _contains([w]) for w in METRIC_WORDS}, NAMED_SQL)} AS metric,
  {_case({n: _contains(w) for n, w in GROUP_WORDS.items()}, "NULL")} AS grouping_column FROM {ASKED_SQL}
""")
def request_words(t):
    q = F.col("question")
    return asked(t).select("conv_id", "turn", text.operation_word(q).alias("operation"),
                           text.metric_word(q).alias("metric"), text.group_word(q).alias("grouping_column"))


SECRETS = [
    "key sk-abcDEF0123456789_-xyzXYZ end", "API_KEY = \"q1w2e3\"; next", "api-key: zzz999 tail",
    "Authorization: Bearer abc.DEF-123_456 ok", "password= hunter2; rest", "PassWord : 'topsecret' x",
    "token = \"tok-42\" y", "nothing to hide",
]
SECRET_LIST = ", ".join("'" + s.replace("'", "{q}'") + "'" for s in SECRETS)
LEAKY = "concat(text, ' ', {array}[doc_id % " + str(len(SECRETS)) + "{shift}])"


def _redacted_sql(column: str) -> str:
    for pattern, replacement in text.SECRET_PATTERNS + [text.TOKEN_PATTERN]:
        escaped = pattern.replace("'", "''")
        column = f"regexp_replace({column}, '{escaped}', '{replacement.replace('$1', chr(92) + '1')}', 'gi')"
    return column


@query(f"""
SELECT doc_id, md5({_redacted_sql("leaky")}) AS redacted_md5
FROM (SELECT doc_id, {LEAKY.format(array="[" + SECRET_LIST.replace("{q}", "'") + "]", shift=" + 1")} AS leaky FROM documents)
""")
def redact_secrets(t):
    leaky = t.documents.select("doc_id", F.expr(
        LEAKY.format(array="array(" + SECRET_LIST.replace("{q}", "\\") + ")", shift="")).alias("leaky"))
    return leaky.select("doc_id", F.md5(text.redact_secrets(F.col("leaky"))).alias("redacted_md5"))
