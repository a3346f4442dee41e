"""Everything known about a set of tables, as tables."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.operators import coverage, money_units, overlap, profile, reconcile


@dataclass(frozen=True)
class Collection:
    """Profile frames of a table set; each is computed when it is read."""

    columns: DataFrame
    dates: DataFrame
    tables: DataFrame
    currencies: DataFrame
    units: DataFrame
    relationships: DataFrame | None
    contradictions: DataFrame | None

    def save(self, folder: str) -> None:
        """Writes each frame as Parquet, so that later gates and reports scan no data table."""
        for field in fields(self):
            frame = getattr(self, field.name)
            if frame is not None:
                frame.write.mode("overwrite").parquet(f"{folder}/{field.name}")


def profile_collection(tables: dict[str, DataFrame], distinct: str = "approx") -> Collection:
    def each(build) -> DataFrame:
        return reduce(DataFrame.unionByName, [build(df, name) for name, df in tables.items()])

    currencies = each(money_units.currency_profile)
    money = money_units.table_currency(currencies, list(tables))
    shared = overlap.shared_columns(tables)
    metrics = {n: c for n, c in ((n, reconcile.revenue_column(df)) for n, df in tables.items()) if c}
    claims = None
    if len(metrics) > 1:
        # totals meet only within one currency; both frames have one row per table
        totals = reconcile.metric_totals(tables, metrics).drop("currency").join(
            F.broadcast(money.select("table_name", "currency")), "table_name")
        claims = reconcile.contradictions(totals)
    return Collection(
        columns=each(lambda df, name: profile.column_profile(df, name, distinct)),
        dates=coverage.date_columns(each(coverage.date_profile)),
        tables=profile.table_profiles(tables).join(F.broadcast(money), "table_name"),
        currencies=currencies,
        units=each(money_units.unit_profile),
        relationships=overlap.key_overlap(tables) if shared else None,
        contradictions=claims,
    )
