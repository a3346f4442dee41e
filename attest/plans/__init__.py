"""Registered queries by topic."""

from importlib import import_module

TOPICS = ("aggregates", "filters", "profiling", "cross_table", "verification", "audit", "texts",
          "gating", "files")


def all_queries():
    """Every registered query by name."""
    for topic in TOPICS:
        import_module(f"attest.plans.{topic}")
    from attest.plans.registry import QUERIES

    return QUERIES
