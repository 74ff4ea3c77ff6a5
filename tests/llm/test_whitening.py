import math

import numpy as np
import pytest
from llm_fixtures import *  # noqa: F403
from llm_fixtures import SF_DIR
from pyspark.sql import functions as F

from perexpo.llm import whitening
from perexpo.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>"


def whole(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def check(rows, vectors, identity=1e-8):
    """Every column of the result against numpy over all vectors at once."""
    x = np.array([whole(v) for v in vectors.values()], dtype=object)
    different = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(different), different.sum(axis=0)
    centred = ((different * n - sums) / n).astype(float)
    spread = centred.T @ centred / n
    values, axes = np.linalg.eigh(spread)
    values, axes = values[::-1], axes[:, ::-1]
    of = dict(zip(vectors, x, strict=True))
    seen = {}
    for r in rows:
        own = of[r.vec_id]
        k = r.component - 1
        assert r.n == n and r.deviation == int(((own * n - sums) ** 2).sum())
        wanted = float(((own * n - sums) / n).astype(float) @ axes[:, k]) / math.sqrt(values[k])
        assert abs(abs(r.whitened) - abs(wanted)) < 1e-6
        seen.setdefault(k, []).append(np.sign(r.whitened * wanted) if abs(wanted) > 1e-6 else 0)
        assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9
        assert r.identity_error <= identity
    assert all(len({s for s in signs if s}) <= 1 for signs in seen.values())
    return seen


def test_query_equals_numpy(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    rows = QUERIES["op11_whitening"](spark, SF_DIR).collect()
    assert len(rows) == 16 * len(vectors)
    assert len(check(rows, vectors)) == 16


def run(spark, rows, schema=SCHEMA, **more):
    table = spark.createDataFrame(rows, schema)
    model = whitening.fit(table, **more)
    return model, whitening.transform(table, model)


def test_odd_vectors_are_dropped_and_copies_count_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=5).tolist() for i in range(60)}
    vectors |= {100 + i: vectors[3] for i in range(200)}
    vectors[400] = [0.0] * 5
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [math.nan] * 5), (904, [math.inf] * 5), (905, [1.0])]
    path = str(tmp_path / "t")
    table = spark.createDataFrame([*vectors.items(), *odd], SCHEMA)
    table.repartition(7).write.parquet(f"{path}/embeddings.parquet")
    rows = QUERIES["op11_whitening"](spark, path).collect()
    assert len(rows) == 5 * len(vectors)
    check(rows, vectors)


def test_fewer_dimensions_and_no_variance(spark):
    line = [(i, [float(i), 2.0 * i, -float(i)]) for i in range(20)]
    model, rows = run(spark, line)
    assert len(model.eigenvalues) == 1 and all(len(r.whitened) == 1 for r in rows.collect())
    assert model.identity_error < 1e-9
    model, rows = run(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [0.5, 0.5])])
    assert [(r.deviation, r.whitened) for r in rows.collect()] == [(0, [])] * 3


def test_empty_table(spark, tmp_path):
    model, rows = run(spark, [])
    assert model is None and rows.collect() == []
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, None)], SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    assert QUERIES["op11_whitening"](spark, path).collect() == []


def test_clashing_names_and_large_entries(spark):
    table = spark.createDataFrame([(i, [1e300 * (i % 2), float(i)], "a") for i in range(30)], "vec_id bigint, embedding array<double>, x string")
    model = whitening.fit(table)
    rows = whitening.transform(table.withColumn("deviation", F.lit("b")), model).collect()
    assert len(rows) == 30 and all(r.deviation is None for r in rows)


def test_deviation_is_exact_beyond_doubles():
    x = np.array([[2**40 + 1, 3], [5, 9], [7, 2**33]], dtype=np.int64)
    model = whitening.Model(3, x.sum(axis=0), np.zeros((0, 2)), np.zeros(0), 0.0)
    wide = x.astype(object) * 3 - x.sum(axis=0).astype(object)
    wanted = [t if t < 2**63 else -1 for t in (wide * wide).sum(axis=1)]
    assert model.deviation(x).tolist() == wanted


@pytest.mark.parametrize("size", [1, 2, 3, 40])
@pytest.mark.parametrize("kind", ["random", "equal", "close", "steep"])
def test_eigenvectors(size, kind):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    values = {
        "random": rng.uniform(0, 9, size),
        "equal": np.where(np.arange(size) % 2, 5.0, 1.0),
        "close": 1 + np.arange(size) * 1e-12,
        "steep": 10.0 ** -np.arange(size),
    }[kind]
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading_eigenvectors(matrix, 16)
    assert np.allclose(found, np.sort(values)[::-1][:16], rtol=0, atol=1e-13 * values.max())
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-13
    assert np.abs(matrix @ vectors.T - vectors.T * found).max() < 1e-13 * values.max()


def test_sturm_count():
    diagonal, off = np.array([2.0, 2.0, 2.0]), np.array([1.0, 1.0])
    assert [whitening.sturm_count(diagonal, off, v) for v in (0.5, 1.9, 2.1, 4.0)] == [0, 1, 2, 3]
