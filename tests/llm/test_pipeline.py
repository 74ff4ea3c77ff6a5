"""The pipeline's stages on small tables, and the whole against its operators."""

import random

import corpus_pipeline as pipeline
import tiktoken
from llm_fixtures import TESTDATA, documents, odd_texts, workers  # noqa: F401
from pyspark.sql import functions as F

from perexpo.llm import mixing, simhash
from perexpo.llm.queries import QUERIES

SF_DIR = f"{TESTDATA}/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in pipeline.STAGES] == [
        "language ID",
        "SimHash near-dedup",
        "secret scan",
        "source mix",
        "byte-level BPE",
    ]


def test_stages_keep_columns_and_survive_odd_rows(spark, documents, odd_texts):
    text = "the cat sat on the mat and looked at the dog for a while"
    texts = [*odd_texts, text, text, text + " password=abcdef123", None]
    ids = [None, *range(1, len(texts) - 1), 5]
    docs = documents(texts, ["en"] * len(texts), ["s"] * len(texts), ids).withColumn("Score", F.lit(0.5))
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == columns, name
        assert out.count() > 0, name
    empty = documents([])
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).collect() == []


def test_decisions_take_effect(spark, documents):
    text = "one more text with words enough for three shingles or four"
    docs = documents(
        [text, text, "12 34", None, "something else, password=abcdef123 inside"],
        ["en"] * 5,
        ["s"] * 5,
        [7, 3, 4, 5, 6],
    )
    known = pipeline.language_id(spark, docs, SF_DIR)
    assert sorted(r.doc_id for r in known.collect()) == [3, 6, 7]
    single = pipeline.near_duplicates(spark, known, SF_DIR)
    assert sorted(r.doc_id for r in single.collect()) == [3, 6]
    clean = pipeline.secret_scan(spark, single, SF_DIR).orderBy("doc_id").collect()
    assert [r.text for r in clean] == [text, "something else, [SECRET] inside"]
    assert [r.n_chars for r in clean] == [len(r.text) for r in clean]


def test_near_duplicates_keep_one_row_of_an_id(spark, documents):
    docs = documents(["a b c d", "a b c d", "e f g h", "i", "i"], ids=[1, 1, 2, None, None])
    found = pipeline.near_duplicates(spark, docs, SF_DIR).collect()
    assert sorted((str(r.doc_id) for r in found)) == ["1", "2", "None", "None"]


def test_near_copies_within_the_bit_distance_do_not_survive(spark, documents):
    """Against all pairs of fingerprints: three-word shingles, at most three bits apart."""
    rng = random.Random(6)
    texts = []
    for n, changes in ((100, 1), (300, 1), (1000, 2), (1000, 30), (5, 1)):
        for _ in range(20):
            own = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
            other = list(own)
            for at in rng.sample(range(n), changes):
                other[at] = "changed"
            texts += [" ".join(own), " ".join(other)]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, documents(texts), SF_DIR).collect()}
    assert kept == set(group) and 0 < len(texts) - len(kept) < 80


def test_texts_in_an_unknown_script_go(spark, documents):
    docs = documents(["the cat and the dog", "der Hund und die Katze", "キツネは犬を飛び越える"], ["en", "de", None])
    found = pipeline.language_id(spark, docs, SF_DIR).collect()
    assert {r.doc_id: r.lang for r in found} == {0: "en", 1: "de"}


def test_clashing_names_pass_through(spark, documents):
    names = ["lang_pred", "score", "base_spans", "spans", "row", "checksum", "component", "fp", "kept", "component_id"]
    text = "one more text with password=abcdef123 and words enough"
    docs = documents([text, text, "another one altogether, longer"], ["en"] * 3, ["s"] * 3)
    for n in names:
        docs = docs.withColumn(n, F.lit("mine"))
    for name, stage in pipeline.STAGES[:3]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        assert {r[n] for r in out.collect() for n in names} == {"mine"}, name


def test_different_texts_of_one_id_stay(spark, documents):
    docs = documents(["a b c d e f", "g h i j k l", "a b c d e f", "m n o p q r"], ids=[1, 1, 2, 3])
    found = pipeline.near_duplicates(spark, docs, SF_DIR).collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(1, "a b c d e f"), (1, "g h i j k l"), (3, "m n o p q r")]


def test_run(spark):
    rows = pipeline.run(spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {r.doc_id for r in QUERIES["op10_simhash"](spark, SF_DIR).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in rows} <= kept and all(r.round_trip for r in rows)
    # The mix of what the other stages keep, worked out without the pipeline.
    staged = docs.where(F.col("doc_id").isin(*kept))
    staged = pipeline.secret_scan(spark, pipeline.language_id(spark, staged, SF_DIR), SF_DIR)
    times = {r.doc_id: r.times for r in mixing.mix(staged).where("times > 0").collect()}
    texts = {r.doc_id: r.text for r in staged.collect()}
    found = {}
    for r in rows:
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == times
    import public_tokenizers as P

    from perexpo.llm.bpe import read_ranks

    ranks = read_ranks(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows[:50]:
        assert r.ids == plain.encode_ordinary(texts[r.doc_id])
