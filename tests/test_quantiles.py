"""Radix selection against sorted lists, and order keys against the bits of doubles."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from attest.operators import profile
from attest.operators import quantiles as q
from attest.operators.median import median_by

EDGES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
         math.inf, -math.inf, 0.1, 3.0, 2.0**52, 2.0**53 - 1, 1 - 2.0**-53, 1 + 2.0**-52, 1e-310, 1e300, math.pi]


def by_bits(x):
    bits = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -bits if x < 0 else bits


def interpolated(values, p):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    if not values:
        return None
    place = (len(values) - 1) * p
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low if low == high else low * (1 - (place - math.floor(place))) + high * (place - math.floor(place))


def test_keys_are_the_bits(spark):
    rng = random.Random(2)
    values = EDGES + [2.0**e * s for e in range(-1074, 1024, 7) for s in (1, -1)] + [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)]
    rows = q.with_key(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
    assert len(rows) == len(values) and all(r["key"] == by_bits(r["v"]) and q.key_value(r["key"]) == r["v"] for r in rows)
    none = q.with_key(spark.createDataFrame([(None,), (math.nan,)], "v double"), "v").collect()
    assert [r["key"] for r in none] == [None, None]


@pytest.mark.parametrize("bins", [q.BINS, 3])
def test_quantiles_of_several_columns_at_once(spark, monkeypatch, bins):
    monkeypatch.setattr(q, "BINS", bins)  # with few bins every digit is scanned
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1) * 10 ** rng.randrange(-3, 9), rng.randrange(-5, 5), None, rng.choice([None, math.nan, 7.5]), rng.choice(EDGES[:10])) for _ in range(999)]
    df = spark.createDataFrame(rows, "`net.price` double, small int, empty double, holes double, edges double")
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.999, 1.0)
    found = {(r["column_name"], r["probability"]): r["quantile_value"] for r in profile.column_quantiles(df, "t", df.columns, probabilities).collect()}
    assert len(found) == len(df.columns) * len(probabilities)
    for i, name in enumerate(df.columns):
        for p in probabilities:
            assert found[name, p] == interpolated([r[i] for r in rows], p), (name, p)


def test_no_rows_and_one_row(spark):
    one = spark.createDataFrame([(2.5,)], "v double")
    assert median_by(one, [], "v").collect()[0][0] == 2.5
    assert median_by(one.limit(0), [], "v").collect()[0][0] is None
    with pytest.raises(ValueError):
        q.quantiles(one, [], (0.5,))


def test_decimals_and_wide_integers(spark):
    df = spark.range(1, 1001).select((F.col("id") * 10**15).alias("wide"), (F.col("id").cast("decimal(20,0)") / 4).cast("decimal(30,2)").alias("exact"))
    found = {r["column_name"]: r["quantile_value"] for r in q.quantiles(df, ["wide", "exact"], (0.5,)).collect()}
    assert found == {"wide": 500.5 * 10**15, "exact": 125.125}
