import math
import random

import numpy as np
import pytest
from llm_fixtures import *  # noqa: F403
from llm_fixtures import SF_DIR, TESTDATA
from pyspark.sql import functions as F

from perexpo.llm import toxicity
from perexpo.llm.queries import QUERIES

LABELS = "doc_id bigint, toxic int"


def plain_segments(scores):
    """All maximal segments: the best one (first, then shortest, of equals), then the same on both its sides."""
    if not any(s > 0 for s in scores):
        return []
    sums = np.concatenate([[0], np.cumsum(scores)])
    best = max(((sums[b] - sums[a], -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a, b = best[-2:]
    left, right = plain_segments(scores[:a]), plain_segments(scores[b:])
    return left + [(a, b, best[0])] + [(b + x, b + y, s) for x, y, s in right]


@pytest.mark.parametrize("seed", range(60))
def test_scan_finds_all_maximal_segments(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(-0.2, 1, size=rng.integers(0, 40))
    scan = toxicity.Scan()
    for part in np.array_split(scores, 3):
        scan.add(part)
    wanted = plain_segments(scores)
    assert [s[:2] for s in scan.segments()] == [s[:2] for s in wanted]
    assert np.allclose([s[2] for s in scan.segments()], [s[2] for s in wanted])


def test_scan_is_linear():
    """Scores for which a search from the right would look at all candidates each time."""
    scan = toxicity.Scan()
    scan.add(np.tile([1.0, -2.0], 200_000))
    assert len(scan.segments()) == 200_000


def test_words_and_their_beginnings():
    buckets, hashes, ends = toxicity.words("Abcdef, abcdefgh! abcdef É é 12x".encode())
    text = "Abcdef, abcdefgh! abcdef É é 12x".encode()
    assert [text[a:b].decode() for a, b in ends] == ["Abcdef", "abcdefgh", "abcdef", "É", "é", "x"]
    assert buckets[2, 0] == buckets[2, 1] == buckets[2, 2] and buckets[0, 0] == buckets[0, 1]
    assert hashes[0] == hashes[2] != hashes[1] and hashes[3] == hashes[4]
    assert toxicity.words(b"")[2].shape == (0, 2) and toxicity.words(b"12 ?")[2].shape == (0, 2)


def test_log_odds_follow_the_chain_of_priors():
    shape = (len(toxicity.LENGTHS), toxicity.BUCKETS)
    toxic, every = np.zeros(shape), np.zeros(shape)
    buckets, *_ = toxicity.words(b"abcdefgh")
    for row, (t, n) in enumerate([(30, 40), (20, 22), (9, 9), (3, 3)]):
        toxic[row, buckets[row, 0]], every[row, buckets[row, 0]] = t, n
    toxic[-1, (buckets[-1, 0] + 1) % toxicity.BUCKETS], every[-1, (buckets[-1, 0] + 1) % toxicity.BUCKETS] = 97, 897
    share = p = 101 / 902
    for t, n in [(30, 40), (20, 22), (9, 9), (3, 3)]:
        p = (t + 10 * p) / (n + 10)
    wanted = math.log(p / (1 - p)) - math.log(share / (1 - share)) - toxicity.DRIFT
    counts = toxicity.Counts(toxic, every)
    assert np.isclose(counts.scores(buckets)[0], wanted)
    assert np.isclose(counts.scores(toxicity.words(b"zzzzzzz")[0])[0], -toxicity.DRIFT)


def test_scale_solves_its_equation():
    scores, weights = np.array([-2.0, -0.5, 1.0, 3.0]), np.array([50.0, 40.0, 6.0, 2.0])
    x = toxicity.scale_of(scores, weights)
    assert np.isclose(np.exp(x * scores) @ weights / weights.sum(), 1)
    assert toxicity.scale_of(np.array([-1.0]), np.array([3.0])) == 1.0 and toxicity.scale_of(np.zeros(0), np.zeros(0)) == 1.0


def test_tail_is_the_law_of_maxima():
    law = toxicity.Law(1.0, math.log(0.5), 1.0)
    assert np.isclose(law.tail(9.0, 100), 1 - math.exp(-0.5 * 100 * math.exp(-9.0)))
    assert law.tail(1e6, 10) == 0.0 and law.tail(-1e6, 10) == 1.0


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(4)
    text = " ".join(("bad" if rng.random() < 0.005 else rng.choice(["alpha", "é" * 3, "word", "x1y"])) for _ in range(3000)).encode()
    toxic, every = np.zeros((4, toxicity.BUCKETS)), np.ones((4, toxicity.BUCKETS))
    for row, bucket in enumerate(toxicity.words(b"bad")[0][:, 0]):
        toxic[row, bucket], every[row, bucket] = 50, 50
    counts = toxicity.Counts(toxic, every)
    whole, ends, like = *toxicity.segments(text, counts), toxicity.likeness(text)
    monkeypatch.setattr(toxicity, "_BLOCK", 64)
    parts, cut, other = *toxicity.segments(text, counts), toxicity.likeness(text)
    assert (ends == cut).all() and like == other and np.allclose(np.array(whole), np.array(parts)) and len(whole) > 5


def test_near_copies_mostly_share_their_likeness():
    rng = random.Random(5)
    same = 0
    for _ in range(200):
        text = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(100)]
        near = [*text]
        near[rng.randrange(100)] = "other"
        same += toxicity.likeness(" ".join(text).encode()) == toxicity.likeness(" ".join(near).encode())
    assert same > 160
    assert toxicity.likeness(None) == toxicity.likeness(b"") == toxicity.likeness(b" 12 ")


@pytest.fixture(scope="module")
def planted(spark):
    """A model of made-up text in which three words and one family of words are toxic, and the texts that it knows."""
    rng = random.Random(8)
    common = ["".join(rng.choice("abcdeéfghi") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def text(toxic, n=None):
        words = rng.choices(common, k=n or rng.randint(20, 200))
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["Vilest", "nastyone", "rotten", f"zzgr{rng.choice(common)}"])
        return " ".join(words)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], LABELS)
    return docs, labels, toxicity.fit(docs, labels), text


def test_toxic_passages_are_found(spark, planted):
    *_, model, text = planted
    long = text(False, 5000) + " nastyone rotten vilest " + text(False, 5000)
    rows = [(0, text(False)), (1, text(True)), (2, long), (3, "zzgrnever and zzgrother zzgrmore"), (4, text(False, 8000)), (5, "ab " * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in toxicity.score(df, model, passages="spans").collect()}
    assert [found[i].score >= 0.5 for i in range(6)] == [False, True, True, True, False, False]
    span = max(found[2].spans, key=lambda s: s.evidence)
    assert long.encode()[span.start : span.end].decode().split()[0] in ("nastyone", "rotten", "vilest")


def test_held_out_documents(spark, planted):
    *_, model, text = planted
    rows = [(i, text(i % 2 == 0), i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic boolean")
    right = toxicity.score(df, model).where((F.col("score") >= 0.5) == F.col("toxic")).count()
    assert right >= 390


def test_odd_texts_and_names(spark, planted, odd_texts):
    docs, labels, model, _ = planted
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(odd_texts)], "doc_id bigint, text string, score string, label string")
    found = toxicity.score(df, model).collect()
    assert len(found) == len(odd_texts) and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if not (r.text or "").strip()} == {model.score(0.0)}
    assert toxicity.score(df.limit(0), model).collect() == []
    more = docs.withColumn("label", F.lit("x")).withColumn("half", F.lit("y")).withColumn("id", F.lit("z"))
    again = toxicity.fit(more, labels.withColumn("id", F.lit("z")).withColumn("half", F.lit("y")))
    assert again.weights == pytest.approx(model.weights)


def test_few_labels(spark, planted):
    docs, labels, *_ = planted
    none = toxicity.fit(docs, labels.limit(0))
    assert none.score(5.0) == 0.5
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 0), (4, 0)], LABELS)
    clean = toxicity.fit(docs, odd)
    assert np.isclose(clean.score(0.0), 1 / 4) and clean.score(9.0) == clean.score(0.0)


def test_query_on_held_out_labels(spark):
    folder = f"{TESTDATA}/sf0.01"
    rows = QUERIES["op12_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.94 * len(held)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


def test_query_columns(spark):
    df = QUERIES["op12_toxicity"](spark, SF_DIR)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert df.count() == 200
