"""Connected components of large graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import written


def _mins(edges: DataFrame, name: str) -> DataFrame:
    return written(edges.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("least")), name)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node reaches: node, component. Reads columns `a` and `b`, both bigint.

    Every node is hooked to the least neighbour of its neighbours until all edges lead to the least node of
    their component (large-star and small-star steps in turn). Each step takes a least neighbour per node, which
    is combined before the shuffle, and joins it back from a written table, a join that adaptive execution
    splits at hubs. Nodes without an edge, null ends and loops are left out; an empty table gives no rows.
    """
    kept = edges.filter("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))
    kept = written(kept.distinct(), "edges")
    before = None
    while (now := _state(kept)) != before and now[0]:
        before = now
        least = _mins(kept, "least")
        large = kept.join(least, kept["small"] == least["node"], "left").select(
            "big", F.coalesce("least", "small").alias("small"))
        large = written(large.distinct(), "large-star")
        least = _mins(large, "least")
        joined = large.join(least, large["big"] == least["node"])
        small = joined.select(F.explode(F.array(
            F.struct(F.col("big").alias("big"), F.col("least").alias("small")),
            F.struct(F.col("small").alias("big"), F.col("least").alias("small")))).alias("e")).select("e.big", "e.small")
        kept = written(small.filter("big <> small").distinct(), "small-star")
    roots = kept.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    return kept.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(roots)


def least_roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least reachable index of each of `size` nodes."""
    label = np.arange(size)
    while True:
        least = label.copy()
        np.minimum.at(least, left, label[right])
        np.minimum.at(least, right, label[left])
        least = least[least]
        if (least == label).all():
            return label
        label = least
