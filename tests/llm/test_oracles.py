"""Queries whose result SQL can express, on the driver's tables and on small ones with the cases these lack."""

import numpy as np
import oracle
import pytest
from llm_fixtures import SF_DIR, VECTORS, documents, odd_texts, workers  # noqa: F401

from perexpo.llm.queries import ORACLE_SQL, QUERIES


def equal(spark, name, folder):
    found, wanted = oracle.spark_rows(QUERIES[name](spark, folder)), oracle.duck_rows(oracle.connect(folder), ORACLE_SQL[name])
    assert found[0] == wanted[0] and found[1] == wanted[1]
    return found[1]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert equal(spark, name, SF_DIR)


def test_vectors_with_links(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [1.0], 1)]
    for c in range(40):
        centre, label = rng.normal(size=24), [None, 1, 2][c % 3]
        for i in range(rng.integers(1, 9)):
            rows.append((len(rows) + 1000 * (i % 2), (centre + rng.normal(0, 0.2, 24)).tolist(), label))
    spark.createDataFrame(rows, VECTORS).coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t").rename(tmp_path / "embeddings")
    folder = tmp_path / "sf"
    folder.mkdir()
    next((tmp_path / "embeddings").glob("*.parquet")).rename(folder / "embeddings.parquet")
    found = equal(spark, "op6_embeddings", str(folder))
    assert sum(not r[1] for r in found) > 20


def test_texts_of_all_kinds(spark, documents, odd_texts, tmp_path):
    texts = [*odd_texts, "the cat and the dog", "der Hund und die Katze", "l'été à la plage", "ÀÉÎ"] * 3
    langs = [["en", "de", None, "fr"][i % 4] for i in range(len(texts))]
    documents(texts, langs, [["s", None, "t"][i % 3] for i in range(len(texts))]).coalesce(1).write.parquet(str(tmp_path / "d"))
    folder = tmp_path / "sf"
    folder.mkdir()
    next((tmp_path / "d").glob("*.parquet")).rename(folder / "documents.parquet")
    for name in ("op7_mixing", "op8_language", "op13_merkle"):
        assert equal(spark, name, str(folder))
