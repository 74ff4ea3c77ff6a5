"""Mixing against a plain allocation, and the registered query against its SQL."""

import re

from llm_fixtures import TESTDATA, documents, odd_texts, workers  # noqa: F401
from pyspark.sql import functions as F

from perexpo.llm import mixing
from perexpo.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = f"{TESTDATA}/sf0.001"


def plain_targets(sizes):
    """Reshare the excess until no source is above twice its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in stopped)
        heavy = sum(weight[s] for s in order if s not in stopped)
        new = {s for s in order if s not in stopped and left * weight[s] / heavy > 2 * sizes[s]}
        if not new:
            return {s: 2 * sizes[s] if s in stopped else left * weight[s] / heavy for s in order}
        stopped |= new


def check(rows, texts, sources):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    sums = {}
    for n, s in zip(size, sources, strict=True):
        sums[s] = sums.get(s, 0) + n
    wanted = plain_targets(sums)
    taken, largest = dict.fromkeys(sums, 0), dict.fromkeys(sums, 0)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == sums[sources[r.doc_id]] and 0 <= r.times <= 2
        assert abs(r.target - wanted[sources[r.doc_id]]) < 1e-6 * max(1, r.target)
        taken[sources[r.doc_id]] += r["size"] * r.times
        largest[sources[r.doc_id]] = max(largest[sources[r.doc_id]], r["size"])
    for s in sums:
        assert abs(taken[s] - wanted[s]) <= largest[s] / 2 + 1e-6


def test_targets_and_words_taken(documents):
    texts, sources = [], []
    for s, n in (("b", 400), ("a", 30), ("Z", 5), (None, 60), ("é", 90), ("\U0001f600", 3), ("none", 2)):
        for k in range(n):
            texts.append(None if s == "none" else "w " * (1 + (k * 7) % 40))
            sources.append(s)
    docs = documents(texts, sources=sources).withColumn("limit", F.lit(1))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts, sources)
    again = {r.doc_id: r.times for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.times for r in rows}
    times = {}
    for r in mixing.mixed(docs).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.limit == 1
    assert times == {d: n for d, n in again.items() if n}


def test_one_source_one_document_and_none(documents):
    assert [r.times for r in mixing.mix(documents(["a b c d"], sources=["x"])).collect()] in ([1], [2])
    assert mixing.mix(documents([])).collect() == []
    assert mixing.mixed(documents([])).collect() == []
    rows = mixing.mix(documents([None, ""], sources=[None, "x"], ids=[None, None])).collect()
    assert [(r["size"], r.target) for r in rows] == [(0, 0.0), (0, 0.0)]


def test_a_smaller_budget_takes_a_subset(documents):
    docs = documents([f"w {i} " * (i % 9 + 1) for i in range(300)], sources=["x"] * 300)
    less, more = (
        {r.doc_id for r in mixing.mix(docs, share=s).where("times > 0").collect()} for s in (0.2, 0.6)
    )
    assert less < more


def test_query_against_sql(spark):
    import oracle

    df = QUERIES["op7_mixing"](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    columns, rows = oracle.spark_rows(df)
    plain_columns, plain_rows = oracle.duck_rows(oracle.connect(SF_DIR), ORACLE_SQL["op7_mixing"])
    assert columns == plain_columns
    at = [c for c, _ in columns].index("target")
    near = lambda found: sorted(tuple(round(v, 4) if i == at else v for i, v in enumerate(r)) for r in found.elements())
    assert near(rows) == near(plain_rows)
