"""Near duplicates among embeddings: sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import written
from attest.llm.graph import components, least_roots

BUCKET = 64
RECALL = 0.99
BLOCK = 1024
SEED = 20_011


def shape(vectors: int, threshold: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits so that unlike vectors fill a bucket with about `bucket`, and tables so that a pair at the
    threshold shares a bucket with probability `recall`."""
    bits = max(4, math.ceil(math.log2(max(1, vectors) / bucket)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _codes(units: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    planes = np.random.Generator(np.random.PCG64([seed, units.shape[1]])).standard_normal((units.shape[1], tables * bits))
    signs = (units @ planes >= 0).reshape(len(units), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _units(data: list[bytes], dim: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(data), "<f8").reshape(len(data), dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _vectors(batches):
    """vec_id, key of the vector's bytes, and the bytes; key and bytes are null where the vector cannot link."""
    for batch in batches:
        keys, data = [], []
        for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
            known = vec_id is not None and values and None not in values
            row = np.array(values, "<f8") + 0.0 if known else None  # + 0.0: one zero
            known = known and bool(np.isfinite(row).all()) and bool(row.any())
            data.append(row.tobytes() if known else None)
            keys.append(hashlib.blake2b(data[-1], digest_size=16).digest() if known else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "key", "data"])


def link(vectors: DataFrame, threshold: float = 0.9, seed: int = SEED) -> DataFrame:
    """Links of every vector with the others at cosine `threshold` or more, and their components.

    Equal vectors are one class, which is hashed and compared once and counts as many links as it has rows.
    Classes meet in the buckets of each table. A bucket of more than BLOCK classes is cut into blocks, and each
    pair of blocks is a task's group of its own, so that no group is larger than two blocks. All pairs
    of a group are compared in double precision, but only their counts and a spanning forest leave it; a pair
    that an earlier table has brought together is counted there.

    Reads `vec_id` and `embedding` only, so other columns cannot clash. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without vec_id, link with nothing; vectors of unlike length do
    not link. Repeated rows are vectors of their own. An empty table gives no rows.
    Returns a row per row: vec_id, n_links, component_id (smallest vec_id reached, itself included), kept.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(source.mapInArrow(_vectors, "vec_id long, key binary, data binary"), "vectors")
    classes = written(rows.filter("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("data").alias("data")), "classes")
    bits, tables = shape(classes.count(), threshold)

    def hashed(batches):
        for batch in batches:
            data = batch.column("data").to_pylist()
            dims = np.array([len(d) // 8 for d in data])
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(own))
                codes = _codes(_units([data[i] for i in own], int(dim)), bits, tables, seed)
                whole = pa.array([c.astype("<i8").tobytes() for c in codes], pa.binary())
                for t in range(tables):
                    bucket = [pa.array(np.full(len(own), t, np.int32)), pa.array(np.full(len(own), dim, np.int32)), pa.array(codes[:, t])]
                    yield pa.RecordBatch.from_arrays([*bucket, whole, part.column("key"), part.column("copies"), part.column("data")], names=["t", "dim", "code", "codes", "key", "copies", "data"])

    placed = written(classes.mapInArrow(hashed, "t int, dim int, code long, codes binary, key binary, copies long, data binary"), "placed")
    bucket = ["t", "dim", "code"]
    large = written(placed.groupBy(bucket).count().filter(F.col("count") > BLOCK).select(
        *bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large-buckets")
    held = placed.join(large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    held = held.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    spread = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t, dim, _, low, high = (k.as_py() for k in key)
        names = table.column("key").to_pylist()
        own = table.column("own").to_numpy()
        units = _units(table.column("data").to_pylist(), dim)
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), "<i8").reshape(len(names), -1)
        copies = table.column("copies").to_numpy().astype(np.float64)
        one, two = np.flatnonzero(own == low), np.flatnonzero(own == high)
        i, j = np.nonzero(units[one] @ units[two].T >= threshold)
        i, j = one[i], two[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        new = ~(codes[i, :t] == codes[j, :t]).any(axis=1) if t else np.ones(len(i), bool)
        links = np.bincount(i[new], copies[j[new]], len(names)) + np.bincount(j[new], copies[i[new]], len(names))
        roots = least_roots(len(names), i, j)
        told = np.flatnonzero((links > 0) | (roots != np.arange(len(names))))
        return pa.table({"key": pa.array([names[x] for x in told], pa.binary()), "links": pa.array(links[told].astype(np.int64)),
                         "root": pa.array([names[roots[x]] for x in told], pa.binary())})

    found = written(spread.select(*bucket, "low", "high", "own", "codes", "key", "copies", "data").groupBy(
        *bucket, "low", "high").applyInArrow(verify, "key binary, links long, root binary"), "links")
    counted = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.select(F.col("key").alias("root"), F.col("first").alias("b"))
    edges = found.filter("key <> root").select("key", "root").distinct().join(named, "root").join(
        classes.select("key", F.col("first").alias("a")), "key").select("a", "b")
    parts = components(edges)
    result = written(classes.select("key", "first", "copies").join(counted, "key", "left").join(
        parts, F.col("first") == F.col("node"), "left").select(
        "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "first").alias("component")), "classes-linked")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", "key").join(result, "key", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
