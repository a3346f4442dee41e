"""One metric query from gate to ledger: judge, compute twice, compare, record."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.operators import gates, overlap, reconcile
from attest.operators.ledger import content_sum
from attest.operators.metric import MetricQuery, MonthOf, run

VERIFIED = {True: "PASSED", False: "FAILED"}
REQUEST = ("request_id string, tables array<string>, metric string, aggregation string, months array<int>, year int, "
           "group_by array<string>, filter_columns array<string>, requires_join boolean, join_key string, "
           "is_growth boolean, combines boolean, authoritative_table string, intent string")


@dataclass(frozen=True)
class Answer:
    """A verdict row and, unless refused, the result and its comparison with a second run."""

    verdict: DataFrame
    result: DataFrame | None = None
    compared: DataFrame | None = None

    @property
    def refused(self) -> bool:
        return self.result is None


def request_of(query: MetricQuery, spark, request_id: str = "query", authoritative_table: str | None = None,
               intent: str = "historical_analytics", combines: bool = False) -> DataFrame:
    """The gate's view of a query: what it names, not what it computes."""
    time = query.time
    groups = [g.column if isinstance(g, MonthOf) else g for g in query.group_by]
    key = None
    if query.join is not None and query.join.right_on in (None, query.join.left_on):
        key = query.join.left_on
    body = (request_id, list(query.tables), query.metric, query.aggregation,
            [time.month] if time and time.month else [], time.year if time else None, groups,
            [c.column for c in query.filters], key is not None, key, False, combines, authoritative_table, intent)
    return spark.createDataFrame([body], REQUEST)


def answer(query: MetricQuery, tables: dict[str, DataFrame], facts: DataFrame | None = None,
           relationships: DataFrame | None = None, contradictions: DataFrame | None = None,
           **request) -> Answer:
    """Judges a query against the facts of its tables and, if it may run, runs it twice.

    The second run reads the tables again and folds their rows in another distribution. One verdict
    row and one comparison row reach the driver; results stay distributed. `facts` and the other
    profile frames come from a stored collection, or are computed for the tables of the query.
    """
    scope = {name: tables[name] for name in query.tables}
    spark = next(iter(scope.values())).sparkSession
    if facts is None:
        facts = gates.table_facts(scope)
    if relationships is None and query.join is not None and overlap.shared_columns(scope):
        relationships = overlap.key_overlap(scope)
    asked = request_of(query, spark, **request)
    verdict = gates.judge(asked, facts, relationships, contradictions)
    if verdict.select("verdict").first()["verdict"] == "REFUSED":
        return Answer(verdict.withColumn("verification", F.lit("NOT_EXECUTED")))
    first = run(query, tables)
    second = run(query, {name: df.hint("rebalance") for name, df in tables.items()})
    keys = [c for c in first.columns if c not in ("value", "rows_total", "rows_used", "duplicates_excluded")]
    compared = reconcile.compare_results(first, second, keys, ["value"])
    agrees = reconcile.summary(compared).first()["agrees"]
    flags = reconcile.sanity_flags(first, rows="rows_used" if "rows_used" in first.columns else None)
    warns = not flags.filter("is_not_finite or is_missing or is_not_positive or is_empty_filter").isEmpty()
    verdict = gates.judge(asked.withColumn("has_warning", F.lit(warns)), facts, relationships, contradictions)
    return Answer(verdict.withColumn("verification", F.lit(VERIFIED[agrees])), first, compared)


def ledger_record(given: Answer, run_id: str, fingerprints: DataFrame) -> DataFrame:
    """One row for the audit ledger: the payload that a chain hashes.

    A result enters as its row count, its total and a digest of all its rows, so the row stays small.
    The time is fixed here, so every reading of the row gives the same.
    """
    data = fingerprints.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("fingerprint")), "|"), 256))
    empty = F.lit("")
    primary = secondary = empty
    if not given.refused:
        def digest(side: str):
            keys = [c for c in given.result.columns if c in given.compared.columns]
            return given.compared.agg(F.to_json(F.struct(
                F.count(f"{side}_value").alias("rows"), F.sum(f"{side}_value").alias("total"),
                content_sum(given.compared, [*keys, f"{side}_value"]).cast("string").alias("content")))).scalar()
        primary, secondary = digest("left"), digest("right")
    return given.verdict.select(
        F.lit(run_id).alias("run_id"),
        F.lit(datetime.now(timezone.utc)).alias("timestamp"),
        F.substring(data.scalar(), 1, 16).alias("dataset_hash"),
        F.col("evidence").alias("query_plan_json"),
        F.coalesce("reason", empty).alias("code"),
        primary.alias("primary_result"), secondary.alias("secondary_result"),
        F.col("verification").alias("verification_status"), "confidence",
    )
