"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Every passage is encoded by the
frequencies of its bytes and of the kinds of its neighbouring pairs and by how often it
repeats itself, then by one learned layer. Gated attention gives each passage a weight, the weighted mean of the encodings
represents the document, and a logistic layer scores it. All of it is learned from labels
of whole documents; what makes a passage count is not labelled.

The model is fitted on at most ``SAMPLE`` labelled documents, those whose ids have the
smallest hashes, and on at most ``SAMPLE_PASSAGES`` evenly spaced passages of each. Scores
always come from all passages. The softmax runs over a long text in blocks, so memory
does not grow with its length.

Defined cases: a null or empty text is one empty passage and gets a score too. Documents
without a label teach nothing. With no labels at all, every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from perexpo.llm.common import batches_of, with_columns

PASSAGE = 512
SAMPLE = 6_000
SAMPLE_PASSAGES = 64
_HIDDEN, _GATE = 32, 16
_BLOCK = 2048
_EPOCHS, _BATCH, _RATE, _DECAY = 40, 64, 0.01, 1e-4


def _kinds() -> np.ndarray:
    """Kind of each byte: control, space, digit, upper, lower, comma or full stop, other sign, not ASCII."""
    kind = np.full(256, 6, dtype=np.uint8)
    kind[:32], kind[32], kind[128:] = 0, 1, 7
    for name, values in ((2, "0123456789"), (3, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (4, "abcdefghijklmnopqrstuvwxyz"), (5, ",.")):
        kind[[ord(c) for c in values]] = name
    return kind


_KIND = _kinds()
FEATURES = 256 + 64 + 2


def passages(text: bytes | None) -> Iterator[np.ndarray]:
    """Encodings of all passages of a text, in blocks of at most ``_BLOCK``.

    Square roots keep rare signs visible beside frequent letters. The last two features are
    how full a passage is and how many of its three-byte sequences are different ones.
    """
    octets = np.frombuffer(text or b"", dtype=np.uint8)
    for start in range(0, max(len(octets), 1), _BLOCK * PASSAGE):
        own = octets[start : start + _BLOCK * PASSAGE]
        n = max(-(-len(own) // PASSAGE), 1)
        row = np.arange(len(own)) // PASSAGE
        kind = _KIND[own].astype(np.int64)
        three = own.astype(np.int64)
        three = np.unique((row[2:] << 24) | (three[:-2] << 16) | (three[1:-1] << 8) | three[2:])
        size = np.bincount(row, minlength=n).reshape(n, 1)
        counts = np.concatenate(
            [
                np.bincount(row * 256 + own, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1),
                np.bincount(row[1:] * 64 + kind[:-1] * 8 + kind[1:], minlength=n * 64).reshape(n, 64) / np.maximum(size, 1),
                size / PASSAGE,
                (np.bincount(three >> 24, minlength=n).reshape(n, 1) / np.maximum(size, 1)) ** 2 * 4,
            ],
            axis=1,
        )
        yield np.sqrt(counts).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """weights: encoder, attention (two gates and their sum), logistic layer."""

    weights: dict[str, np.ndarray]

    def score(self, text: bytes | None) -> float:
        w = self.weights
        top, total, mixed = -np.inf, 0.0, np.zeros(_HIDDEN)
        for block in passages(text):
            hidden = np.tanh(block @ w["encode"] + w["shift"])
            attention = (np.tanh(hidden @ w["look"]) * _sigmoid(hidden @ w["gate"])) @ w["weigh"]
            now = max(top, float(attention.max()))
            share = np.exp(attention - now)
            scale = np.exp(top - now)
            total = total * scale + float(share.sum())
            mixed = mixed * scale + share @ hidden
            top = now
        return float(_sigmoid(mixed / total @ w["out"] + w["bias"])[()])


def _train(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam on the mean log loss; starting values and order come from a fixed seed."""
    rng = np.random.default_rng(7)

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    w = {
        "encode": start(FEATURES, _HIDDEN) * 3,
        "shift": np.zeros(_HIDDEN),
        "look": start(_HIDDEN, _GATE),
        "gate": start(_HIDDEN, _GATE),
        "weigh": start(_GATE),
        "out": start(_HIDDEN),
        "bias": np.zeros(()),
    }
    if not bags:
        w["out"][:] = 0
        return Model(w)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(_EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), _BATCH):
            pick = order[at : at + _BATCH]
            x = np.concatenate([bags[i] for i in pick]).astype(np.float64)
            sizes = [len(bags[i]) for i in pick]
            first = np.cumsum([0, *sizes[:-1]])
            bag = np.repeat(np.arange(len(pick)), sizes)
            hidden = np.tanh(x @ w["encode"] + w["shift"])
            look, gate = np.tanh(hidden @ w["look"]), _sigmoid(hidden @ w["gate"])
            attention = (look * gate) @ w["weigh"]
            share = np.exp(attention - np.maximum.reduceat(attention, first)[bag])
            share /= np.add.reduceat(share, first)[bag]
            mixed = np.add.reduceat(share[:, None] * hidden, first, axis=0)
            wrong = (_sigmoid(mixed @ w["out"] + w["bias"]) - labels[pick]) / len(pick)
            to_mixed = wrong[:, None] * w["out"]
            to_share = (to_mixed[bag] * hidden).sum(axis=1)
            to_attention = share * (to_share - np.add.reduceat(share * to_share, first)[bag])
            to_look = to_attention[:, None] * w["weigh"] * gate * (1 - look**2)
            to_gate = to_attention[:, None] * w["weigh"] * look * gate * (1 - gate)
            to_hidden = share[:, None] * to_mixed[bag] + to_look @ w["look"].T + to_gate @ w["gate"].T
            to_hidden *= 1 - hidden**2
            slope = {
                "encode": x.T @ to_hidden,
                "shift": to_hidden.sum(axis=0),
                "look": hidden.T @ to_look,
                "gate": hidden.T @ to_gate,
                "weigh": (look * gate).T @ to_attention,
                "out": mixed.T @ wrong,
                "bias": wrong.sum(),
            }
            step += 1
            rate = _RATE * 0.5 * (1 + np.cos(np.pi * epoch / _EPOCHS))
            for k, g in slope.items():
                g = g + _DECAY * w[k]
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                w[k] = w[k] - rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    sample: int = SAMPLE,
) -> Model:
    """Learn from ``labels`` (doc_id, label 0 or 1) of at most ``sample`` documents."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).cast("bigint").alias("labelled_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id")
        .limit(sample)
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            coded = []
            for value in batch["text"].to_pylist():
                n = max(-(-len(value or b"") // PASSAGE), 1)
                wanted = np.unique(np.linspace(0, n - 1, min(n, SAMPLE_PASSAGES)).astype(np.int64))
                found = [b[wanted[(wanted >= k * _BLOCK) & (wanted < (k + 1) * _BLOCK)] - k * _BLOCK]
                         for k, b in enumerate(passages(value))]
                coded.append(np.concatenate(found).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["labelled_id"], batch["label"], pa.array(coded, pa.binary())], ["labelled_id", "label", "bag"]
            )

    # The sample is at most ``sample`` pairs of numbers.
    rows = (
        docs.select(F.col(doc_id).cast("bigint").alias("labelled_id"), F.col(text).cast("binary").alias("text"))
        .join(F.broadcast(chosen), "labelled_id")
        .select("labelled_id", "label", "text")
        .mapInArrow(encode, "labelled_id bigint, label int, bag binary")
        .groupBy("labelled_id")
        .agg(F.max("label").alias("label"), F.max("bag").alias("bag"))
        .collect()
    )
    rows.sort(key=lambda r: r.labelled_id)
    bags = [np.frombuffer(r.bag, dtype=np.float16).reshape(-1, FEATURES) for r in rows]
    return _train(bags, np.array([r.label for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score: near 1 for label 1, near 0 for label 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1024):
            found = [model.score(value) for value in batch[text].cast(pa.binary()).to_pylist()]
            yield with_columns(batch, (), **{name: pa.array(found, pa.float64())})

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
