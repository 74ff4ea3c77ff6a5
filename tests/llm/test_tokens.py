"""BPE and wavelet matrices against the public libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from llm_fixtures import TESTDATA, documents, odd_texts, workers  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perexpo.llm import bpe, wavelet
from perexpo.llm.wavelet import WaveletMatrix

RANKS = P.path("byte_bpe_50k.tiktoken")


def definition():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_as_the_library_does_and_decode(documents, odd_texts):
    ranks = bpe.read_ranks(RANKS)
    docs = documents(odd_texts).withColumn("words", F.lit("own column"))
    encoded = bpe.encode(docs, ranks, P.PATTERN, chunk_chars=1_000)
    rows = {r.doc_id: r for r in bpe.decode(encoded, ranks).collect()}
    plain = reference()
    assert len(rows) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        assert rows[i].ids == plain.encode_ordinary(text or ""), repr(text)
        assert rows[i].decoded == (text or "").encode()
        assert rows[i].words == "own column"


def test_long_words_end_and_are_merged_as_by_the_library(documents):
    rng = random.Random(8)
    signs = ["acgt", "-", "-=", "日本語文章", "abcdefghij", "0123456789", "é😀ñ"]
    texts = [f"{s[0]} {''.join(rng.choices(s, k=n))} {s[0] * n} end" for s in signs for n in (10, 11, 31, 32, 33, 3000)]
    texts += ["".join(rng.choices("acgt", k=100_000)), "-" * 100_000] * 2
    rows = bpe.encode(documents(texts), bpe.read_ranks(RANKS), P.PATTERN, chunk_chars=50_000).collect()
    plain = reference()
    for row in rows:
        assert row.ids == plain.encode_ordinary(texts[row.doc_id]), texts[row.doc_id][:50]
    assert len(rows) == len(texts)


def test_encode_empty_table(documents):
    assert bpe.encode(documents([]), bpe.read_ranks(RANKS), P.PATTERN).collect() == []


def test_wavelet_matrix_operations():
    rng = np.random.default_rng(1)
    for size, high in ((0, 5), (1, 5), (63, 3), (64, 40), (5000, 40)):
        ids = rng.integers(0, high, size).astype(np.uint32)
        built = WaveletMatrix.of(ids, 6)
        w = WaveletMatrix.read(size, *built.columns())
        assert (w.ids() == ids).all()
        assert (w.access(np.arange(size)) == ids).all()
        for token in (0, 2, 39, 63, 64):
            places = np.flatnonzero(ids == token).tolist()
            assert w.count(token) == len(places)
            assert w.rank(token, size // 2) == sum(p < size // 2 for p in places)
            assert [w.select(token, k) for k in range(len(places))] == places
            assert w.select(token, len(places)) == -1


def test_shards_hold_all_ids_in_order(spark, documents, odd_texts, tmp_path):
    ids = [None, *range(len(odd_texts) - 1, 0, -1)]
    docs = documents(odd_texts, ids=ids)
    wavelet.write_shards(docs, str(tmp_path / "s"), definition(), shard_ids=1000)
    shards = wavelet.read_shards(spark, str(tmp_path / "s"))
    assert shards.count() > 1
    tokenizer = Tokenizer.from_str(definition())
    tokenizer.encode_special_tokens = True
    rows = sorted(wavelet.read_documents(shards).collect(), key=lambda r: r.start)
    order = sorted(zip(ids, odd_texts, strict=True), key=lambda p: (p[0] is not None, p[0] or 0))
    start, everything = 0, []
    for row, (name, text) in zip(rows, order, strict=True):
        wanted = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.ids) == (name, start, wanted), repr(text)
        start += len(wanted)
        everything += wanted
    found = wavelet.occurrences(shards, everything[0]).collect()
    assert sorted(p for r in found for p in r.places) == [k for k, t in enumerate(everything) if t == everything[0]]


def test_added_tokens_in_texts_are_found_as_by_the_library(spark, documents, tmp_path):
    mark = "<|endoftext|>"
    texts = [
        f"hello {mark} world",
        mark,
        mark * 3,
        f"a{mark}  b {mark}\n c",
        f" {mark} ",
        "<|endoftext| > <|ENDOFTEXT|>",
        f"<|<|endoftext|>|>é{mark}日",
        "no mark at all",
        None,
    ]
    wavelet.write_shards(documents(texts), str(tmp_path / "s"), definition())
    tokenizer = Tokenizer.from_str(definition())
    rows = wavelet.read_documents(wavelet.read_shards(spark, str(tmp_path / "s"))).collect()
    start = 0
    for row, text in zip(sorted(rows, key=lambda r: r.start), texts, strict=True):
        wanted = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.start, row.ids) == (start, wanted), repr(text)
        start += len(wanted)
    assert 50256 in rows[0].ids


def test_shards_of_an_empty_table(spark, documents, tmp_path):
    wavelet.write_shards(documents([]), str(tmp_path / "s"), definition())
    assert wavelet.read_documents(wavelet.read_shards(spark, str(tmp_path / "s"))).collect() == []


def test_checksum_query(spark):

    from perexpo.llm.queries import QUERIES

    d = f"{TESTDATA}/sf0.001"
    tokenizer = Tokenizer.from_str(definition())
    texts = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    rows = {r.doc_id: r for r in QUERIES["op9_wavelet"](spark, d).collect()}
    encoded = {r.doc_id: r for r in QUERIES["op1_byte_bpe"](spark, d).collect()}
    start = 0
    for doc in texts:
        ids = tokenizer.encode(doc.text or "", add_special_tokens=False).ids
        row = rows[doc.doc_id]
        crc = zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids) + 1, crc)
        assert encoded[doc.doc_id].n_tokens == len(ids)
        start += len(ids) + 1


def test_words_are_merged_once_in_a_bounded_cache(documents):
    """No pass over the texts before, no literal vocabulary in the plan, and the same ids however few words are held."""
    ranks = bpe.read_ranks(RANKS)
    texts = ["alpha beta gamma-delta", "zqxj zqxj alpha", "日本 ñandú  x", None, "qwzx " * 50]
    encoded = bpe.encode(documents(texts), ranks, P.PATTERN, kept=2)
    assert "aggregate(" not in encoded._jdf.queryExecution().optimizedPlan().toString().lower()
    plain = reference()
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: plain.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_words_of_a_chunk_are_encoded_once_and_split_as_by_the_library():
    """Every sign up to those beyond Latin between letters, numbers, spaces and marks; null signs and added tokens too."""
    encoder = wavelet.Encoder(definition())
    signs = [chr(c) for c in [*range(0x260), 0x300, 0x2003, 0x2014, 0x65E5, 0x1F600]]
    texts = [f"a{s}b 1{s}2 {s} {s}{s}, it{s}s'll {s}x\n{s}" for s in signs]
    texts += ["", " ", "\0", "a\0b c\0", "<|endoftext|>", "x <|endoftext|>  y", "日本 <|endoftext|>"] + ["same words here"] * 50
    seen, new = [], encoder._new
    encoder._new = lambda words: seen.extend(words) or new(words)
    ids, ends = encoder.encode(texts, 2)
    tokenizer = Tokenizer.from_str(definition())
    start = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[start:end].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], repr(text)
        start = end
    assert len(seen) == len(set(seen))


def test_digests_are_made_in_the_task_that_reads_a_shard(spark):
    """Once the ids went through the JVM to a second step in Python."""
    from perexpo.llm.queries import QUERIES

    plan = QUERIES["op9_wavelet"](spark, f"{TESTDATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
