"""Registered queries: a name, a Spark plan over the whole tables, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from attest.session import configure
from attest.sources.files import read_table

Plan = Callable[["Tables"], DataFrame]


class Tables:
    """The Parquet tables of one folder, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self._folder = folder
        self._open: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._open:
            self._open[name] = read_table(self.spark, f"{self._folder}/{name}.parquet")
        return self._open[name]

    def named(self, *names: str) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in names}


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under its function name."""

    def register(plan: Plan) -> Plan:
        if plan.__name__ in QUERIES:
            raise ValueError(f"query '{plan.__name__}' is registered twice")
        QUERIES[plan.__name__] = Query(plan.__name__, plan, sql)
        return plan

    return register
