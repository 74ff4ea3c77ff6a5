"""Exact quantiles of several columns against numpy."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from perexpo.operators import quantiles

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 2.0, 0.9999999999999999, 1.0000000000000002]
ODD += [1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 3.0, 1e15, 2.0**52, 2.0**53 - 1, 8.0, 7.999999999999999, 1e-310]


def test_keys_are_the_bits_of_the_values(spark):
    rng = random.Random(1)
    values = ODD + [math.ldexp(rng.uniform(-1, 1), rng.randint(-1074, 1000)) for _ in range(5000)] + [2.0**k for k in range(-1074, 1024)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.order_key(F.col("v")).alias("key"))
    for r in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.key == (-bits if r.v < 0 else bits) and quantiles.value_of(r.key) == r.v
    odd = spark.createDataFrame([(math.nan,), (None,)], "v double").select(quantiles.order_key(F.col("v")).alias("key")).collect()
    assert odd[1].key is None and math.isnan(quantiles.value_of(odd[0].key))


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_equal_numpy(spark, n):
    rng = random.Random(n)
    rows = [(rng.gauss(0, 1e6), rng.choice([1, 1, 1, 5]), None if rng.random() < 0.3 and n > 2 else rng.random() * 1e-300, None) for _ in range(n)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {(r.column_name, r.prob): r for r in quantiles.exact_quantiles(df, ["a", "b", "c", "d"], probs).collect()}
    assert len(found) == 24
    for i, name in enumerate("abcd"):
        known = [float(r[i]) for r in rows if r[i] is not None]
        for p in probs:
            r = found[name, p]
            assert r.n == len(known)
            assert r.value == (pytest.approx(float(np.quantile(known, p)), rel=1e-12) if known else None)


def test_reads_do_not_grow_with_columns(spark, monkeypatch):
    df = spark.range(1000).select(*[(F.col("id") * k % 97).alias(f"c{k}") for k in range(1, 6)])
    written = []
    real = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda frame, name: written.append(name) or real(frame, name))
    quantiles.exact_quantiles(df, df.columns, [0.1, 0.5, 0.9])
    assert len(written) == quantiles.ROUNDS


def test_empty_and_wrong_input(spark):
    df = spark.createDataFrame([], "a double")
    assert quantiles.exact_quantiles(df, ["a"], [0.5]).collect() == [("a", 0.5, None, 0)]
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(df, ["a"], [1.5])
