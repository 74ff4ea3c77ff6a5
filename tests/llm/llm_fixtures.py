import os
import random

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TESTDATA = "/root/testdata"
SF_DIR = f"{TESTDATA}/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    """Python workers find the package wherever the tests are started."""
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture
def documents(spark):
    def make(texts, langs=None, sources=None, ids=None):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        rows = [
            (i, t, lang, src, None if t is None else len(t))
            for i, t, lang, src in zip(ids, texts, langs or [None] * n, sources or [None] * n, strict=True)
        ]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


@pytest.fixture
def odd_texts():
    """Empty and long texts, odd white space, other scripts, and signs outside the basic plane."""
    rng = random.Random(3)
    signs = "ab'sdLlré ñ日1２²_  \n\t\r\x0b\x1c\x85 　,.!?<|endoftext|>\U0001f600"
    noise = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    long = " ".join(rng.choice(["alpha", "beta", "gamma's", "delta."]) for _ in range(20_000))
    return [None, "", " ", "\n\n", "a", "it's we'll don't", "x" * 500, long, *noise, noise[0], noise[0]]
