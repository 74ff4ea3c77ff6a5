"""Toxicity of documents from their maximum-scoring segments.

Every word has a log-odds of toxic against clean text, with Dirichlet priors in a chain: the
prior of a word is what its first 6 bytes say, theirs what the first 5 and 4 say, and at the
start stands the share of toxic words overall. A word that was never seen is judged by
the words that begin as it does, and by nothing if there are none. Counts cover all labelled rows.
They are kept by hash bucket, ``BUCKETS`` for each length, so what goes to the tasks has a
fixed size whatever the vocabulary.

A word's score is its log-odds less ``DRIFT``, so ordinary text sums to less and less. One linear
scan finds all maximal segments of a document: passages whose sum cannot be raised by making
them longer or shorter. How large a sum chance gives in clean text follows an extreme-value
law: with lambda from the clean scores, ``lambda * sum - log(words)`` has a Gumbel distribution,
whose place and width come from clean documents. A segment is significant if its p-value is
at most ``LEVEL``; a document's evidence is the sum of the -log p of its significant segments,
and a logistic function, fitted on labels, makes a score of it. Calibration scores a document with
the counts of the other half of the labelled rows, so that words it was itself counted for
do not make it look extreme.

The calibration is fitted on at most ``SAMPLE`` labelled documents, those whose ids have the
smallest hashes. Long texts are read in blocks of whole words; the scan goes on across them.

Defined cases: words are runs of ASCII letters and of characters beyond ASCII; ASCII and Latin-1 capitals
count as small letters. A null or empty text or one without words has no evidence and gets the
score of that. Labels other than 0 and 1, and null ids, teach nothing. Of several labels of one id
the largest counts; several documents of one id all count. With labels of one kind only,
or none, every score is the share of toxic labels, smoothed to (toxic + 1) / (all + 2).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from perexpo.llm.common import batches_of, stored, with_columns

#: Bytes of the beginnings of words that stand for words too rare to judge; 0 is the whole word.
LENGTHS = (4, 5, 6, 0)
#: Pseudo-occurrences that a prior is worth, and what every word costs a segment.
PRIOR, DRIFT = 10.0, 0.5
LEVEL = 0.05
#: A word that occurred so few words before adds nothing to a segment again.
NEAR = 100
SAMPLE = 20_000
_BITS = 18
#: Bits of the map that tells which ids may have a label.
_HINT_BITS = 1 << 24
#: Word scores are counted in steps, up to a farthest one.
_STEP, _FARTHEST = 0.01, 30.0
BUCKETS = 1 << _BITS
_BLOCK = 1 << 20
_BASE, _FACTOR = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def blocks(text: bytes | None) -> Iterator[bytes]:
    """A text in blocks that cut no word, of about ``_BLOCK`` bytes unless a word is longer."""
    text, start = text or b"", 0
    while start < len(text):
        end = start + _BLOCK
        while end < len(text) and _LETTER[text[end]]:
            end += 1
        yield text[start:end]
        start = end


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes * _FACTOR
    return (hashes ^ (hashes >> np.uint64(32))) * _FACTOR


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length of ``LENGTHS`` (rows) the bucket of every word, hashes of the whole words, and their first and end bytes."""
    octets = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    # Two-byte capitals from A with grave to thorn have their small forms 32 further on.
    second = np.zeros(len(octets), dtype=bool)
    second[1:] = (octets[:-1] == 0xC3) & (octets[1:] >= 0x80) & (octets[1:] <= 0x9E) & (octets[1:] != 0x97)
    octets = np.where(second, octets + np.uint8(32), octets)
    inner = _LETTER[octets]
    change = np.diff(np.concatenate([[False], inner, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # A polynomial hash from the start of the word on: its beginnings come from the same running sum.
    begun = np.zeros(len(octets), dtype=np.int64)
    begun[starts] = starts
    place = np.arange(len(octets)) - np.maximum.accumulate(begun)
    powers = np.cumprod(np.full(int((ends - starts).max(initial=0)) + 1, _BASE))
    terms = np.where(inner, (octets + np.uint64(1)) * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
    buckets = np.empty((len(LENGTHS), len(starts)), dtype=np.int64)
    for row, length in enumerate(LENGTHS):
        upto = np.minimum(starts + length, ends) if length else ends
        mixed = _mixed(sums[upto] - sums[starts])
        buckets[row] = (mixed >> np.uint64(64 - _BITS)).astype(np.int64)
    return buckets, mixed, np.stack([starts, ends], axis=1)


def fresh(hashes: np.ndarray) -> np.ndarray:
    """Whether a word does not occur among the ``NEAR`` words before it."""
    order = np.argsort(hashes, kind="stable")
    near = np.zeros(len(hashes), dtype=bool)
    near[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (np.diff(order) <= NEAR)
    return ~near


def likeness(text: bytes | None) -> int:
    """Smallest hash of the text's runs of five words: near copies mostly share it. Fewer words are one run."""

    def runs(hashes: np.ndarray, size: int) -> np.ndarray:
        n = len(hashes) - size + 1
        return functools.reduce(lambda h, k: _mixed(h + hashes[k : k + n]), range(1, size), hashes[:n])

    least, tail = 2**64 - 1, np.zeros(0, dtype=np.uint64)
    for block in blocks(text):
        hashes = np.concatenate([tail, words(block)[1]])
        if len(hashes) >= 5:
            least = min(least, int(runs(hashes, 5).min()))
        tail = hashes[-4:] if len(hashes) >= 5 else hashes
    if len(tail) and least == 2**64 - 1:
        least = int(runs(tail, len(tail))[0])
    return least >> 1


@dataclass
class Counts:
    """Words of toxic and of all labelled text, by length and bucket."""

    toxic: np.ndarray
    every: np.ndarray

    @property
    def share(self) -> float:
        return float((self.toxic[-1].sum() + 1) / (self.every[-1].sum() + 2))

    def scores(self, buckets: np.ndarray) -> np.ndarray:
        """Log-odds of words, less the drift."""
        share = self.share
        p = np.full(buckets.shape[1], share)
        for row in range(len(LENGTHS)):
            p = (self.toxic[row, buckets[row]] + PRIOR * p) / (self.every[row, buckets[row]] + PRIOR)
        return np.log(p / (1 - p)) - math.log(share / (1 - share)) - DRIFT


class Scan:
    """All maximal scoring segments of a sequence that comes in blocks, in linear time.

    Candidates are kept with the running sums before and after them; each knows the last
    candidate before it that starts lower, so no candidate is passed twice.
    """

    def __init__(self) -> None:
        self.sum, self.at = 0.0, 0
        self.low: list[float] = []
        self.high: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.lower: list[int] = []

    def add(self, scores: np.ndarray) -> None:
        after = self.sum + np.cumsum(scores)
        for k in np.flatnonzero(scores > 0).tolist():
            self._candidate(float(after[k] - scores[k]), float(after[k]), self.at + k)
        self.sum = float(after[-1]) if len(after) else self.sum
        self.at += len(scores)

    def _candidate(self, low: float, high: float, at: int) -> None:
        start = at
        while True:
            j = len(self.low) - 1
            while j >= 0 and self.low[j] >= low:
                j = self.lower[j]
            if j < 0 or self.high[j] >= high:
                break
            # The candidates from j on and what lies between them become one.
            low, start = self.low[j], self.span[j][0]
            del self.low[j:], self.high[j:], self.span[j:], self.lower[j:]
        self.low.append(low)
        self.high.append(high)
        self.span.append((start, at + 1))
        self.lower.append(j)

    def segments(self) -> list[tuple[int, int, float]]:
        """(first word, end word, sum) of all maximal segments."""
        return [(a, b, high - low) for (a, b), low, high in zip(self.span, self.low, self.high, strict=True)]


def scale_of(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda with mean(exp(lambda * score)) = 1; 1 where there is none."""
    keep = weights > 0
    scores, weights = scores[keep], weights[keep] / max(weights.sum(), 1)
    if not len(scores) or scores.max() <= 0 or scores @ weights >= 0:
        return 1.0

    def above(x: float) -> bool:
        top = x * scores.max()
        return top + math.log(np.exp(x * scores - top) @ weights) > 0

    low, high = 0.0, 1.0
    while not above(high):
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if above(middle) else (middle, high)
    return high


def segments(text: bytes | None, counts: Counts) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """Maximal segments of a text, by numbers of its words, and the first and end bytes of all words."""
    scan, bounds, at, tail = Scan(), [np.zeros((0, 2), dtype=np.int64)], 0, np.zeros(0, dtype=np.uint64)
    for block in blocks(text):
        buckets, hashes, ends = words(block)
        scores = counts.scores(buckets)
        again = ~fresh(np.concatenate([tail, hashes]))[len(tail) :]
        scan.add(np.where(again, np.minimum(scores, 0.0), scores))
        tail = np.concatenate([tail, hashes])[-NEAR:]
        bounds.append(ends + at)
        at += len(block)
    return scan.segments(), np.concatenate(bounds)


@dataclass
class Law:
    """Extreme-value law of segment sums in clean text."""

    scale: float
    place: float = 0.0
    width: float = 1.0

    def reduced(self, total: float, n: int) -> float:
        return self.scale * total - math.log(max(n, 1))

    def tail(self, total: float, n: int) -> float:
        """Probability that chance gives a segment of this sum or more to a clean text of ``n`` words."""
        z = (self.reduced(total, n) - self.place) / self.width
        return -math.expm1(-math.exp(min(-z, 700.0)))

    def significant(self, text: bytes | None, counts: Counts) -> list[tuple[int, int, float]]:
        """(first byte, end byte, -log p) of the segments that chance hardly gives."""
        found, ends = segments(text, counts)
        tails = [(a, b, self.tail(total, len(ends))) for a, b, total in found]
        return [(int(ends[a, 0]), int(ends[b - 1, 1]), -math.log(max(p, 1e-300))) for a, b, p in tails if p <= LEVEL]


@dataclass
class Model:
    """counts: of all labelled rows. weights: constant and slope of the score over the evidence."""

    counts: Counts
    law: Law
    weights: tuple[float, float]

    def score(self, evidence: float) -> float:
        x = self.weights[0] + self.weights[1] * math.log1p(evidence)
        return 1 / (1 + math.exp(-min(max(x, -700.0), 700.0)))


def _hinted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose id may be among ``ids``: all that are, and few others.

    A bitmap of id hashes, of fixed size, goes to the tasks. It only spares texts the way to a
    join; when it is full, all go.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(_HINT_BITS))
    # Slots and the bits in them are numbered from 1.
    slots = ids.select((place + 1).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("slot"))
    bits = np.zeros(_HINT_BITS, dtype=bool)
    for r in slots.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map")).collect():
        own = np.unpackbits(np.frombuffer(r["map"], dtype=np.uint8), bitorder="little").astype(bool)
        bits[(r["slot"] - 1) * len(own) :][: len(own)] = own
    packed = np.packbits(bits, bitorder="little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["place"].to_numpy()
            found = (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(found.astype(bool))).select(["id", "text"])

    return texts.withColumn("place", place).mapInArrow(work, "id bigint, text binary")


def _counted(rows: DataFrame) -> np.ndarray:
    """Numbers of documents that hold a word [half, label, length, bucket] of rows of (half, label, text)."""
    shape = (2, 2, len(LENGTHS), BUCKETS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.int64)
        for batch in batches_of(batches, 256):
            for half, label, text in zip(*(batch[c].to_pylist() for c in ("half", "label", "text")), strict=True):
                found = [words(block)[0] for block in blocks(text)]
                for row in range(len(LENGTHS)) if found else ():
                    total[half, label, row, np.unique(np.concatenate([f[row] for f in found]))] += 1
        flat = total.ravel()
        cells = np.flatnonzero(flat)
        for start in range(0, len(cells), 1 << 16):
            part = cells[start : start + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(part.astype(np.int32)), "n": pa.array(flat[part])})

    parts = rows.select("half", "label", "text").mapInArrow(work, "cell int, n bigint")
    sums = parts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(np.prod(shape)), dtype=np.float32)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(shape)


def _score_counts(rows: DataFrame, halves: list[Counts]) -> tuple[np.ndarray, np.ndarray]:
    """Word scores of rows of the sample, in steps of ``_STEP``, and how often each occurs."""
    n = round(2 * _FARTHEST / _STEP) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for batch in batches_of(batches, 256):
            for half, text in zip(batch["half"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for block in blocks(text):
                    found = halves[half].scores(words(block)[0]).clip(-_FARTHEST, _FARTHEST)
                    total += np.bincount(np.rint((found + _FARTHEST) / _STEP).astype(np.int64), minlength=n)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(n)), "n": pa.array(total)})

    parts = rows.select("half", "text").mapInArrow(work, "place bigint, n bigint")
    sums = parts.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    return sums["place"].to_numpy() * _STEP - _FARTHEST, sums["n"].to_numpy().astype(np.float64)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Constant and slope by Newton steps; a small penalty keeps them finite where labels separate."""
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    penalty = np.diag([1e-3, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + penalty @ w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, slope)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """Learn from ``labels`` (doc_id, label 0 or 1); at most ``sample`` of them calibrate."""
    own = F.col(f"`{doc_id}`").cast("bigint")
    told = (
        labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{doc_id}`").isNotNull())
        .groupBy(own.alias("id"))
        .agg(F.max(F.col(f"`{label}`")).cast("int").alias("label"))
    )
    texts = docs.select(own.alias("id"), F.col(f"`{text}`").cast("binary").alias("text")).where("id IS NOT NULL")
    told = stored(told, "told")

    def liken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            keys = pa.array([likeness(t) for t in batch["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"], keys], ["id", "likeness"])

    # Of near copies with one label one counts, and all of them go to one half.
    alike = _hinted(texts, told).mapInArrow(liken, "id bigint, likeness bigint").join(told, "id")
    known = stored(
        alike.groupBy("likeness", "label")
        .agg(F.min("id").alias("id"))
        .select("id", "label", F.pmod(F.xxhash64("likeness"), F.lit(2)).cast("int").alias("half")),
        "labelled",
    )
    # Labels grow with the corpus, so this join is a shuffle at every size; the hint keeps other texts out of it.
    counts = _counted(_hinted(texts, known).join(known.hint("merge"), "id"))
    whole = Counts(counts[:, 1].sum(axis=0), counts.sum(axis=(0, 1)))
    # At most ``sample`` rows of three numbers.
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = stored(_hinted(texts, chosen).join(chosen, "id"), "calibration")
    clean = rows.where("label = 0")
    halves = [Counts(counts[1 - h, 1], counts[1 - h].sum(axis=0)) for h in range(2)]
    law = Law(scale_of(*_score_counts(clean, halves)))

    def largest(value: bytes | None, half: int) -> float:
        found, ends = segments(value, halves[half])
        return law.reduced(max((total for *_, total in found), default=0.0), len(ends))

    top = _each(clean, largest)["value"].to_numpy()
    if len(top):
        # Quartiles, because a few odd documents or wrong labels would move the moments of the law at will.
        low, high = np.quantile(top, [0.25, 0.75])
        law.width = max(float(high - low) / (math.log(math.log(4)) - math.log(math.log(4 / 3))), 0.1)
        law.place = float(high) + law.width * math.log(math.log(4 / 3))

    def evidence(value: bytes | None, half: int) -> float:
        return sum(bits for *_, bits in law.significant(value, halves[half]))

    judged = _each(rows, evidence)
    y = judged["label"].to_numpy().astype(np.float64)
    if 0 < y.sum() < len(y):
        return Model(whole, law, _logistic(np.log1p(judged["value"].to_numpy()), y))
    share = (y.sum() + 1) / (len(y) + 2)
    return Model(whole, law, (math.log(share / (1 - share)), 0.0))


def _each(rows: DataFrame, value) -> pa.Table:
    """(label, value of text and half) of the rows of the sample."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            found = [value(t, h) for t, h in zip(batch["text"].to_pylist(), batch["half"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"label": batch["label"], "value": pa.array(found, pa.float64())})

    return rows.select("label", "half", "text").mapInArrow(work, "label int, value double").toArrow()


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", passages: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the score: near 1 for toxic text, near 0 for clean.

    With ``passages`` also the significant segments: first and end byte of the UTF-8 text, and
    evidence. A column of ``docs`` with one of these names is replaced.
    """
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("evidence", DoubleType())])
    rows = docs.drop(*[c for c in (name, passages) if c and c != text])
    more = [StructField(name, DoubleType())] + [StructField(c, ArrayType(span)) for c in [passages] if c]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            found = [model.law.significant(value, model.counts) for value in batch[text].cast(pa.binary()).to_pylist()]
            columns = {name: pa.array([model.score(sum(e for *_, e in spans)) for spans in found], pa.float64())}
            if passages:
                own = [[dict(zip(("start", "end", "evidence"), s, strict=True)) for s in spans] for spans in found]
                columns[passages] = pa.array(own, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())])))
            yield with_columns(batch, (), **columns)

    return rows.mapInArrow(work, StructType([*rows.schema.fields, *more]))
