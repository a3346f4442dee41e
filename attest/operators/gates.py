"""Gates: which metric requests the data can support, and why not the others.

A request is a row, and so is every fact. The names that requests mention are looked up in an index of the parts of table
names, once for each different list of tables; facts, key pairs and contradicting totals join that list, and
the lists join the requests. No plan holds a value that grows with the catalog or with the requests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.money_units import unit_dimension
from attest.functions.values import column_class
from attest.functions.vocab import (
    ABSENT_METRICS,
    DEFAULT_INTENT,
    MONTH_TITLES,
    TIME_FILTER_WORDS,
    UNKNOWN_CURRENCY,
)
from attest.operators.coverage import date_columns, date_profile
from attest.operators.duplicates import duplicate_profile
from attest.operators.metric import DEDUPLICATED
from attest.operators.money_units import currency_profile, unit_profile
from attest.operators.profile import missing_profile
from attest.session import checkpointed

# Fields of a request, with the SQL default of those a table of requests may leave out.
REQUEST_DEFAULTS = {
    "aggregation": "'sum'",
    "months": "cast(array() as array<int>)",
    "year": "cast(null as int)",
    "is_growth": "false",
    "group_by": "cast(array() as array<string>)",
    "filter_columns": "cast(array() as array<string>)",
    "sort_column": "cast(null as string)",
    "combines": "false",
    "requires_join": "false",
    "join_key": "cast(null as string)",
    "authoritative_table": "cast(null as string)",
    "intent": f"'{DEFAULT_INTENT}'",
    "answerable": "true",
    "has_warning": "false",
}
NUMERIC_AGGREGATIONS = ["sum", "mean", "median", "min", "max"]
COUNTING = ["count", "count_distinct"]

FACTS = ("currency", "units", "dates", "duplicates", "missing")


# --- facts ------------------------------------------------------------------


def table_facts(tables: dict[str, DataFrame], parts: tuple[str, ...] = FACTS) -> DataFrame:
    """One row per table. `parts` names the facts that need a scan; the rest comes from the schema.

    The facts are written once, so that judging any number of requests scans no table again.
    """
    rows = []
    for name, df in tables.items():
        columns = [f.name.lower() for f in df.schema.fields]
        numeric = [f.name.lower() for f in df.schema.fields if column_class(f.dataType) == "numeric"]
        rows.append((name, columns, numeric))
    spark = next(iter(tables.values())).sparkSession
    facts = spark.createDataFrame(
        rows, "table_name string, columns array<string>, numeric_columns array<string>")

    def collected(part: str, build, fold: dict[str, Column]) -> DataFrame | None:
        if part not in parts:
            return None
        found = reduce(DataFrame.unionByName, [build(df, name) for name, df in tables.items()])
        return found.groupBy("table_name").agg(*[c.alias(n) for n, c in fold.items()])

    known = F.when(F.upper("currency") != UNKNOWN_CURRENCY, F.upper("currency"))
    pieces = {
        # a code column may hold anything; only three-letter codes are currencies
        "currency": collected("currency", currency_profile, {
            "currencies": F.array_sort(F.collect_set(F.when(
                (F.col("origin") != "code") | F.col("currency").rlike("^[A-Z]{3}$"), known)))}),
        "units": collected("units", unit_profile, {"units": F.array_sort(F.collect_set("unit"))}),
        "dates": collected("dates", lambda df, name: date_columns(date_profile(df, name)), {
            "dates": F.array_sort(F.collect_list(F.struct(
                F.col("column_name").alias("column"), F.col("present_months").alias("year_months"),
                F.transform("present_months", lambda m: F.substring(m, 6, 2).cast("int")).alias("months"),
                F.date_format("min_date", "yyyy-MM-dd").alias("first"),
                F.date_format("max_date", "yyyy-MM-dd").alias("last"),
                F.array_join("missing_months", ", ").alias("gaps"),
                F.col("ambiguous_example").alias("unsure"))))}),
        "duplicates": collected("duplicates", duplicate_profile, {
            "row_count": F.max("row_count"), "duplicate_count": F.max("duplicate_count"),
            "duplicate_pct": F.max("duplicate_pct")}),
        "missing": collected("missing", missing_profile, {
            "missing": F.array_sort(F.collect_list(F.when(F.col("missing_count") > 0, F.concat(
                "column_name", F.lit(": "), F.col("missing_count").cast("string")))))}),
    }
    empty = {
        "currencies": "cast(array() as array<string>)",
        "units": "cast(array() as array<string>)",
        "dates": "cast(array() as array<struct<column:string,year_months:array<string>,"
                 "months:array<int>,first:string,last:string,gaps:string,unsure:string>>)",
        "row_count": "cast(null as bigint)",
        "duplicate_count": "0L",
        "duplicate_pct": "0D",
        "missing": "cast(array() as array<string>)",
    }
    for piece in pieces.values():
        if piece is not None:
            facts = facts.join(F.broadcast(piece), "table_name", "left")  # one row per table
    return checkpointed(facts.select("table_name", "columns", "numeric_columns", *[
        F.coalesce(F.col(n), F.expr(d)).alias(n) if n in facts.columns else F.expr(d).alias(n)
        for n, d in empty.items()]))


# --- judging ----------------------------------------------------------------


def complete(requests: DataFrame) -> DataFrame:
    """Adds the fields a table of requests leaves out."""
    for name, default in REQUEST_DEFAULTS.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.expr(default))
    return requests


def name_index(facts: DataFrame) -> DataFrame:
    """The inverted index of table names: every lower-case part of a name (`part`) and the table it stands for (`found`).

    A name stands for its table without regard to case, a part of it where no other name holds it. A name that two
    tables have but for case stands for neither. A name of n characters has at most n * (n + 1) / 2 + 1 parts, and each part one row.
    """
    names = facts.select(F.lower("table_name").alias("name"))
    size = F.length("name")
    parts = F.transform(F.sequence(F.lit(1), size), lambda start: F.transform(
        F.sequence(F.lit(1), size - start + 1), lambda n: F.substring(F.col("name"), start, n)))
    listed = names.select("name", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(parts)))).alias("part"))
    folded = listed.groupBy("part").agg(
        F.count_if(F.col("part") == F.col("name")).alias("whole"), F.count("*").alias("n"), F.min("name").alias("name"))
    found = F.when(F.col("whole") == 1, F.col("part")).when((F.col("whole") == 0) & (F.col("n") == 1), F.col("name"))
    return folded.select("part", found.alias("found")).filter("found is not null")


def table_lists(requests: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different lists of tables that requests name: (`listed`, `scope`, `unresolved`), and (`listed`, `found`), a row for each table in
    scope. Requests are folded to their lists before anything is joined."""
    entries = F.struct(*[F.col(c) for c in facts.columns])
    alone = facts.groupBy(F.lower("table_name").alias("name")).agg(F.any_value(entries).alias("fact"), F.count("*").alias("n"))
    mentioned = requests.select(F.col("tables").alias("listed")).distinct().select("listed", F.posexplode("listed").alias("at", "mention"))
    met = mentioned.join(name_index(facts), F.lower("mention") == F.col("part"), "left").drop("part")
    met = met.join(alone.filter("n = 1").drop("n"), F.col("found") == F.col("name"), "left")
    members = met.filter("found is not null").select("listed", "found").distinct()
    held = met.groupBy("listed").agg(F.array_sort(F.collect_list(F.struct("at", "mention", "found", "fact"))).alias("held"))
    scopes = held.select(
        "listed", F.array_distinct(F.transform(F.filter("held", lambda h: h["found"].isNotNull()), lambda h: h["fact"])).alias("scope"),
        F.transform(F.filter("held", lambda h: h["found"].isNull()), lambda h: h["mention"]).alias("unresolved"))
    return scopes, members


def _between(members: DataFrame, pairs: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """For each list of tables, the rows of `pairs` (table_a, table_b) with both tables in it, as one array `name`."""
    named = pairs.select(F.lower("table_a").alias("_a"), F.lower("table_b").alias("_b"), F.struct(*columns).alias("_pair"))
    second = members.select(F.col("listed").alias("_listed"), F.col("found").alias("_found"))
    met = members.join(named, F.col("found") == F.col("_a")).join(
        second, (F.col("listed") == F.col("_listed")) & (F.col("_b") == F.col("_found")), "left_semi")
    return met.groupBy("listed").agg(F.array_sort(F.collect_list("_pair")).alias(name))


_PAIR_TYPE = "array<struct<table_a:string,table_b:string,join_key:string,best:double>>"
_CLAIM_TYPE = ("array<struct<table_a:string,table_b:string,metric:string,value_a:double,"
               "value_b:double,difference_pct:double,column_a:string,column_b:string>>")


def with_scope(requests: DataFrame, facts: DataFrame, relationships: DataFrame | None = None,
               contradictions: DataFrame | None = None) -> DataFrame:
    """Adds what a request's tables bring: `scope` (their facts), `unresolved` (names not found), `_pairs` (recommended keys
    between them) and `_claims` (totals on which they differ)."""
    scopes, members = table_lists(requests, facts)
    if relationships is not None:
        scopes = scopes.join(_between(members, relationships.filter("is_recommended"), [
            F.lower("table_a").alias("table_a"), F.lower("table_b").alias("table_b"), F.col("join_key"),
            F.greatest("ratio_a", "ratio_b").alias("best")], "_pairs"), "listed", "left")
    if contradictions is not None:
        for column in ("column_a", "column_b"):
            if column not in contradictions.columns:
                contradictions = contradictions.withColumn(column, F.lit(None).cast("string"))
        scopes = scopes.join(_between(members, contradictions, [F.col(c) for c in (
            "table_a", "table_b", "metric", "value_a", "value_b", "difference_pct", "column_a", "column_b")], "_claims"), "listed", "left")
    empty = {"scope": f"array<{_fact_type(facts)}>", "unresolved": "array<string>", "_pairs": _PAIR_TYPE, "_claims": _CLAIM_TYPE}
    # Where all requests name one list, it is a literal, and without a key of its own the join would have none left.
    same = F.xxhash64(requests["request_id"]).bitwiseAND(F.lit(0)) == F.xxhash64(scopes["scope"]).bitwiseAND(F.lit(0))
    met = requests.join(scopes, requests["tables"].eqNullSafe(F.col("listed")) & same, "left")
    return met.select(*[requests[c] for c in requests.columns], *[
        F.coalesce(F.col(n), F.expr(f"cast(array() as {kind})")).alias(n) if n in scopes.columns else F.expr(f"cast(array() as {kind})").alias(n)
        for n, kind in empty.items()])


def _fact_type(facts: DataFrame) -> str:
    return facts.schema.simpleString()


def _refusal(test: Column, rule: str, reason: Column, issue: str, needed: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(
        F.lit(rule).alias("rule"), reason.alias("reason"), F.lit(issue).alias("data_issue"),
        F.lit(needed).alias("needed")))


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?"))
                      for p in parts])


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _month_title(number: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTH_TITLES]), number - 1)


def _over_scope(pick) -> Column:
    return F.flatten(F.transform("scope", pick))


def month_gaps() -> Column:
    """Asked months that a date column in scope lacks; with a year, that month of that year."""
    def lacks(date: Column, month: Column) -> Column:
        exact = F.format_string("%04d-%02d", F.col("year"), month)
        return ~F.when(F.col("year").isNull(), F.array_contains(date["months"], month)).otherwise(
            F.array_contains(date["year_months"], exact))

    return F.flatten(F.transform("months", lambda month: _over_scope(lambda table: F.transform(
        F.filter(table["dates"], lambda date: lacks(date, month)),
        lambda date: F.struct(month.alias("month"), table["table_name"].alias("table_name"),
                              date["column"].alias("column"), date["first"].alias("first"),
                              date["last"].alias("last"))))))


def judge(requests: DataFrame, facts: DataFrame, relationships: DataFrame | None = None,
          contradictions: DataFrame | None = None) -> DataFrame:
    """Verdict rows: request_id, verdict, confidence, rule, reason, data_issue, needed, assumptions,
    advisories, evidence. Rules are tried in order; the first that fires refuses the request.

    Requests that differ in request_id alone are judged once: they are folded to their bodies, which the verdicts join again."""
    asked = complete(requests).select(F.col("request_id").alias("_id"), F.struct("tables", "metric", *REQUEST_DEFAULTS).alias("_body"))
    bodies = asked.select(F.col("_body").alias("request_id")).distinct().select("request_id", "request_id.*")
    verdicts = _judged(with_scope(bodies, facts, relationships, contradictions))
    # fields of a struct are equal when both are null; the second key stays where all bodies are one literal
    same = F.xxhash64(asked["_id"]).bitwiseAND(F.lit(0)) == F.xxhash64(verdicts["verdict"]).bitwiseAND(F.lit(0))
    met = asked.join(verdicts, (asked["_body"] == verdicts["request_id"]) & same, "left")
    return met.select(F.col("_id").alias("request_id"), *[c for c in verdicts.columns if c != "request_id"])


def _judged(scoped: DataFrame) -> DataFrame:
    metric = F.lower("metric")
    columns = _over_scope(lambda t: t["columns"])
    names = F.transform("scope", lambda t: F.lower(t["table_name"]))
    scoped = (
        scoped.withColumn("_columns", F.array_distinct(columns))
        .withColumn("_numeric", F.array_distinct(_over_scope(lambda t: t["numeric_columns"])))
        .withColumn("_in_scope", names)
        .withColumn("_currencies", F.array_sort(F.array_distinct(_over_scope(lambda t: t["currencies"]))))
        .withColumn("_units", F.array_sort(F.array_distinct(_over_scope(lambda t: t["units"]))))
        .withColumn("_gap", _first(month_gaps()))
        .withColumn("_duplicates", F.aggregate(
            "scope", F.lit(0).cast("bigint"), lambda acc, t: acc + t["duplicate_count"]))
        .withColumn("_keys", F.transform(F.array_sort(F.transform(
            "_pairs", lambda p: F.struct((-p["best"]).alias("b"), p["join_key"].alias("k")))), lambda s: s["k"]))
        .withColumn("_key", F.coalesce("join_key", _first(F.col("_keys"))))
        .withColumn("_claim", _first(F.filter("_claims", lambda c:
            (F.contains(metric, F.lower(c["metric"])) | F.coalesce(metric == F.lower(c["column_a"]), F.lit(False))
             | F.coalesce(metric == F.lower(c["column_b"]), F.lit(False)))
            & ~F.coalesce(F.lower("authoritative_table").isin(F.lower(c["table_a"]), F.lower(c["table_b"])),
                          F.lit(False)))))
    )

    def unknown(listed: Column, extra: list[str]) -> Column:
        allowed = F.array(*[F.lit(e) for e in extra]).cast("array<string>")
        return F.array_except(F.transform(listed, F.lower), F.array_union("_columns", allowed))

    bad_group = _first(unknown(F.col("group_by"), []))
    bad_filter = _first(unknown(F.col("filter_columns"), TIME_FILTER_WORDS))
    dimensions = F.array_distinct(F.array_compact(F.transform("_units", unit_dimension)))
    absent = _first(F.filter(F.array(*[F.lit(w) for w in ABSENT_METRICS]), lambda w: F.contains(metric, w)
                             & ~F.exists("_columns", lambda c: F.contains(c, w))))
    key = F.lower("_key")
    joins = F.col("requires_join")
    gap = F.col("_gap")
    rules = [
        _refusal(F.col("intent") != DEFAULT_INTENT, "intent",
                 _say("questions of kind ", F.col("intent"), " are not answered from records"),
                 "the question is not about recorded facts", "a question about recorded facts"),
        _refusal(~F.col("answerable"), "unanswerable", _say("the request is marked unanswerable"),
                 "parameters of the request cannot be met", "other data or another request"),
        _refusal(F.size("unresolved") > 0, "table",
                 _say("there is no table '", _first(F.col("unresolved")), "'"),
                 "a table is missing", "the table, or its exact name"),
        _refusal(F.size("scope") == 0, "table", _say("the request names no table"),
                 "a table is missing", "the table, or its exact name"),
        # a metric known to be a business term is refused by its own rule below
        _refusal(~F.array_contains("_columns", metric) & ~F.col("aggregation").isin(COUNTING)
                 & absent.isNull(), "metric",
                 _say("there is no column '", F.col("metric"), "'"),
                 "the metric column is missing", "a table with that column"),
        _refusal(F.col("aggregation").isin(NUMERIC_AGGREGATIONS) & ~F.array_contains("_numeric", metric)
                 & absent.isNull(), "numeric",
                 _say(F.col("aggregation"), " needs a number, and '", F.col("metric"), "' is none"),
                 "the metric column is not numeric", "a numeric column"),
        _refusal(bad_group.isNotNull(), "group_by", _say("there is no column '", bad_group, "' to group by"),
                 "a grouping column is missing", "a table with that column"),
        _refusal(bad_filter.isNotNull(), "filter", _say("there is no column '", bad_filter, "' to filter on"),
                 "a filter column is missing", "a table with that column"),
        _refusal(F.col("sort_column").isNotNull() & ~F.array_contains("_columns", F.lower("sort_column")),
                 "sort", _say("there is no column '", F.col("sort_column"), "' to sort by"),
                 "a sort column is missing", "a column of the tables, or the metric"),
        _refusal(joins & (F.size("scope") < 2), "join", _say("a join needs two tables"),
                 "only one table is in scope", "a second, related table"),
        _refusal(joins & key.isNull(), "join", _say("no key relates ", F.array_join("_in_scope", " and ")),
                 "the tables share no key", "tables with a common key column"),
        _refusal(joins & ~F.forall("scope", lambda t: F.array_contains(t["columns"], key)), "join_key",
                 _say("key '", F.col("_key"), "' is not in every table"),
                 "the key is missing in a table", "a column that all tables hold"),
        _refusal(F.size("_currencies") > 1, "currency",
                 _say("the data mixes ", F.array_join("_currencies", " and "), " without a rate"),
                 "several currencies are in scope", "an exchange rate, or one request per currency"),
        _refusal(F.col("_claim").isNotNull(), "contradiction",
                 _say(F.col("_claim.table_a"), " and ", F.col("_claim.table_b"), " differ on ",
                      F.col("_claim.metric"), " by ", F.col("_claim.difference_pct"), " %"),
                 "two sources claim different totals", "which table is authoritative"),
        _refusal(gap.isNotNull(), "month", F.when(
            F.col("is_growth"), _say(_month_title(gap["month"]), " is missing, so growth cannot be computed"),
        ).otherwise(_say(_month_title(gap["month"]), " is not in ", gap["table_name"], ", which covers ",
                         gap["first"], " to ", gap["last"])),
                 "a month has no rows", "rows for that month"),
        _refusal(F.col("combines") & (F.size(dimensions) > 1), "units",
                 _say("units of different kinds: ", F.array_join("_units", ", ")),
                 "units cannot be added", "conversion factors, or one request per unit"),
        _refusal(absent.isNotNull(), "absent_metric", _say("no column is about '", absent, "'"),
                 "the business metric is not recorded", "a table that records it"),
    ]
    judged = scoped.withColumn("_r", _first(F.array_compact(F.array(*rules))))
    refused = F.col("_r").isNotNull()
    deduplicated = (F.col("_duplicates") > 0) & F.col("aggregation").isin(list(DEDUPLICATED))
    assumes = deduplicated | F.col("has_warning")
    return judged.select(
        "request_id",
        F.when(refused, "REFUSED").when(assumes, "ANSWERED_WITH_ASSUMPTIONS").otherwise("ANSWERED").alias("verdict"),
        F.when(refused, "LOW").when(assumes, "MEDIUM").otherwise("HIGH").alias("confidence"),
        "_r.rule", "_r.reason", "_r.data_issue", "_r.needed",
        _assumptions(deduplicated).alias("assumptions"),
        _advisories().alias("advisories"),
        _evidence().alias("evidence"),
    )


def _assumptions(deduplicated: Column) -> Column:
    years = F.array_sort(F.array_distinct(_over_scope(lambda t: F.flatten(F.transform(
        t["dates"], lambda d: F.array(F.substring(d["first"], 1, 4), F.substring(d["last"], 1, 4)))))))
    months = F.transform("months", lambda m: _say(_month_title(m), " is read as calendar month ", m))
    others = F.array(
        F.when(F.col("year").isNull() & (F.size(years) == 1), _say("year is read as ", _first(years))),
        F.when(F.col("year").isNull() & (F.size(years) > 1),
               _say("all years of the data are used, ", F.array_join(years, ", "))),
        F.when(deduplicated, _say(F.col("_duplicates"), " duplicate rows are left out")),
    )
    return F.array_distinct(F.array_compact(F.concat(months, others)))


def _advisories() -> Column:
    """Quality notes per table in scope."""
    def notes(t: Column) -> Column:
        head = F.concat(F.lit("["), t["table_name"], F.lit("] "))
        return F.concat(
            F.array(
                F.when(t["duplicate_count"] > 0,
                       _say(head, t["duplicate_count"], " duplicate rows (", t["duplicate_pct"], " %)")),
                F.when(F.size(t["missing"]) > 0, _say(head, "missing values in ", F.array_join(t["missing"], ", "))),
            ),
            F.transform(t["dates"], lambda d: F.when(
                d["gaps"] != "", _say(head, d["column"], " lacks ", d["gaps"]))),
            F.transform(t["dates"], lambda d: F.when(
                d["unsure"].isNotNull(), _say(head, d["column"], " is unclear about day and month, as in ", d["unsure"]))),
        )
    return F.array_compact(_over_scope(notes))


def _evidence() -> Column:
    return F.to_json(F.struct(
        F.transform("scope", lambda t: t["table_name"]).alias("tables"),
        F.transform("scope", lambda t: t["row_count"]).alias("rows"),
        "aggregation", "metric", "filter_columns",
        F.array_distinct(F.concat(F.array("metric"), "group_by")).alias("columns"),
        F.when(F.col("requires_join"), F.col("_key")).alias("join_key"),
    ))


def refusal_text(verdicts: DataFrame) -> DataFrame:
    """Refusals as one text each: reason, data issue, what is needed."""
    return verdicts.filter("verdict = 'REFUSED'").select("request_id", F.concat_ws(
        "\n\n", F.lit("REFUSED"), F.concat(F.lit("Reason: "), "reason"),
        F.concat(F.lit("Data issue: "), "data_issue"),
        F.concat(F.lit("What would be needed: "), "needed")).alias("text"))
