"""Embedding near-duplicates and nearest neighbours against all pairs."""

import numpy as np
import pytest
from llm_fixtures import TESTDATA, documents, odd_texts, workers  # noqa: F401

from perexpo.llm import embeddings, neighbours
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def table():
    """Clusters of near vectors, many copies of one, and rows that take no part."""
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 8)):
            rows.append(((centre + rng.normal(size=24) * rng.choice([0.05, 0.25])).astype(np.float32).tolist(), c % 3))
    rows += [(rows[0][0], rows[0][1])] * 40
    rows += [(rows[1][0], None), (None, 1), ([0.0] * 24, 1), ([float("nan")] + [1.0] * 23, 1), ([], 1)]
    rows += [([float("inf")] + [1.0] * 23, 1), ([None] + [1.0] * 23, 1), ([1.0, 2.0, 3.0], 1), ([1.0, 2.0, 3.0], 1)]
    return [(i * 5, v, label) for i, (v, label) in enumerate(rows)]


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


@pytest.mark.parametrize("block", [8, 1024])
def test_embedding_links(spark, table, block):
    n = len(table)
    links, group = np.zeros(n, dtype=int), list(range(n))
    for a in range(n):
        for b in range(a):
            (_, v, one), (_, w, two) = table[a], table[b]
            if one is None or one != two or not usable(v) or not usable(w) or len(v) != len(w):
                continue
            v, w = np.float64(v), np.float64(w)
            if v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[a] += 1
                links[b] += 1
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min(table[i][0] for i in range(n) if group[i] == g) for g in set(group)}
    df = spark.createDataFrame(table, VECTORS).withColumn("node", F.lit("own column"))
    rows = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block).collect()}
    assert len(rows) == n and links.max() > 40
    for i, (name, _, _) in enumerate(table):
        assert (rows[name].n_links, rows[name].component_id) == (links[i], least[group[i]])


def test_embeddings_of_an_empty_table(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert embeddings.near_duplicates(empty).collect() == []
    assert neighbours.search(empty, F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("block", [8, 2048])
def test_nearest_neighbours_of_a_small_table_are_exact(spark, table, block):
    known = [(i, np.float64(v)) for i, v, _ in table if usable(v) and len(v) == 24]
    df = spark.createDataFrame(table, VECTORS).withColumn("leaf", F.lit("own column"))
    found = neighbours.search(df, F.col("vec_id") % 20 == 0, k=6, leaf=16, leaves=10_000, block=block)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    queries = [(i, v) for i, v in known if i % 20 == 0]
    assert set(got) == {i for i, _ in queries}
    for i, v in queries:
        scores = sorted(((round(float(v @ w), 9), j) for j, w in known if j != i), key=lambda p: (-p[0], p[1]))[:6]
        assert [round(s, 9) for _, s in got[i]] == [s for s, _ in scores]
        assert [j for j, _ in got[i]] == [j for _, j in scores]


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (21, [1.0, 1.0], None)]
    found = neighbours.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == [
        (0, 1, 21, 1.0),
        (0, 2, 20, 0.0),
        (20, 1, 21, 1.0),
        (20, 2, 0, 0.0),
    ]


def test_recall(spark):

    from perexpo.llm.queries import QUERIES

    d = f"{TESTDATA}/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in QUERIES["op4_neighbours"](spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = m @ m[q]
        scores[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -scores))[:20]]))
    assert hits / (20 * len(got)) >= 0.9


def test_vectors_in_double_precision(spark):
    """Inner products that single precision cannot tell apart, and sizes that it cannot hold."""
    rows = [(0, [1.0, 0.0])] + [(i, [1 + 1e-9 * i, 0.0]) for i in range(1, 6)] + [(7, [1e300, 1.0]), (8, [1e-300, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = neighbours.search(table, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [7, 5, 4, 3, 2, 1, 8]
    assert [r.score for r in found] == [1e300, *[1 + 1e-9 * i for i in (5, 4, 3, 2, 1)], 1e-300]
