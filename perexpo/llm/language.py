"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 letters, word borders
included), most frequent first. A document's own list is compared with every profile by the
out-of-place distance: the sum over its n-grams of how far their ranks are apart, with a
fixed penalty for n-grams that the profile does not hold. The nearest profile wins, ties go
to the smaller name.

Defined cases: a null text or one without any letter is ``und`` with score 0, as is every
text if nothing could be learned. Rows with a null label teach nothing. Repeated rows count
as often as they occur. Other columns pass through untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from perexpo.llm.common import batches_of, give_back, with_columns

UNKNOWN = "und"
TOP = 300
_BLOCK = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text as integers, in blocks of bounded size.

    A gram is up to three code points of 21 bits. What is no letter becomes a space; grams
    of spaces alone or with a space between letters are left out.
    """
    text = f" {text.lower()}  "
    for start in range(0, len(text) - 2, _BLOCK):
        piece = text[start : start + _BLOCK + 2].encode("utf-32-le", "surrogatepass")
        point = np.frombuffer(piece, dtype=np.uint32).astype(np.int64)
        letter = _letters()[point]
        point[~letter] = 32
        pair = (point[:-1] << 21) | point[1:]
        three = (pair[:-1] << 21) | point[2:]
        first, second = letter[:-2], letter[1:-1]
        yield np.concatenate([point[:-2][first], pair[:-1][first | second], three[second]])


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(c, return_counts=True) for c in _codes(text)]
    return parts[0] if len(parts) == 1 else _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


@dataclass(frozen=True)
class Profiles:
    """languages in order of name; all their grams in order; rank[language, gram], or ``top``."""

    languages: list[str]
    grams: np.ndarray
    rank: np.ndarray
    top: int

    def nearest(self, text: str | None, known_only: bool = False) -> tuple[str, float]:
        """Language and score; with ``known_only`` a text none of whose n-grams is in a profile has no language."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        grams, n = _counts(text)
        if not len(grams):
            return UNKNOWN, 0.0
        own = grams[np.lexsort((grams, -n))[: self.top]]
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        ranks = np.where(self.grams[at] == own, self.rank[:, at], self.top)
        if known_only and (ranks == self.top).all():
            return UNKNOWN, 0.0
        away = np.where(ranks == self.top, self.top, np.abs(ranks - np.arange(len(own))))
        distance = away.sum(axis=1) / (self.top * len(own))
        best = int(distance.argmin())
        others = np.delete(distance, best)
        second = float(others.min()) if len(others) else 1.0
        total = float(distance[best]) + second
        return self.languages[best], (second / total if total else 0.5)


def fit(docs: DataFrame, text: str = "text", label: str = "lang", top: int = TOP) -> Profiles:
    """Count all n-grams of all labelled documents, and keep the ``top`` of each language.

    Tasks count their own rows; what is shuffled is one row per task, language and gram, so
    a language that holds most rows is no heavier than another. The driver receives at most
    ``top`` rows per different label, and the profiles go to every task: labels are languages, whose
    number does not grow with the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        waiting: dict[str, list] = {}
        size: dict[str, int] = {}

        def settle(lang: str) -> None:
            grams = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            found[lang] = [_merged([*found.get(lang, []), grams])]
            size[lang] = 0

        for batch in batches_of(batches, 256):
            for lang, value in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for codes in _codes(value):
                    waiting.setdefault(lang, []).append(codes)
                    size[lang] = size.get(lang, 0) + len(codes)
                    if size[lang] > 4 * _BLOCK:
                        settle(lang)
        for lang in list(waiting):
            settle(lang)
        give_back()
        for lang, [(grams, n)] in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["label", "gram", "n"]
            )

    taught = docs.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).dropna()
    counted = (
        taught.mapInArrow(count, "label string, gram bigint, n bigint")
        .groupBy("label", "gram")
        .agg(F.sum("n").alias("n"))
    )
    ordered = Window.partitionBy("label").orderBy(F.desc("n"), "gram")
    rows = (
        counted.withColumn("rank", F.row_number().over(ordered) - 1)
        .where(F.col("rank") < top)
        .select("label", "gram", "rank")
        .collect()
    )
    languages = sorted({r.label for r in rows})
    grams = np.array(sorted({r.gram for r in rows}), dtype=np.int64)
    rank = np.full((len(languages), len(grams)), top, dtype=np.int32)
    if rows:
        lang_at = {name: i for i, name in enumerate(languages)}
        at = np.searchsorted(grams, [r.gram for r in rows])
        rank[[lang_at[r.label] for r in rows], at] = [r.rank for r in rows]
    return Profiles(languages, grams, rank, top)


def predict(
    docs: DataFrame,
    profiles: Profiles,
    text: str = "text",
    name: str = "lang_pred",
    score: str = "score",
    known_only: bool = False,
) -> DataFrame:
    """All columns of ``docs``, the predicted language and a score from 0 to 1.

    Columns of ``docs`` with these two names are replaced. With ``known_only`` a text in a script that no profile holds is
    ``und``; otherwise it is as far from all languages and goes to the first by name.

    The score is the share of the runner-up in the two smallest distances: 0.5 for a tie,
    near 1 for a clear winner.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1024):
            found = [profiles.nearest(value, known_only) for value in batch[text].to_pylist()]
            yield with_columns(
                batch,
                (name, score),
                **{
                    name: pa.array([f[0] for f in found], pa.string()),
                    score: pa.array([f[1] for f in found], pa.float64()),
                },
            )

    more = [StructField(name, StringType()), StructField(score, DoubleType())]
    fields = [f for f in docs.schema.fields if f.name not in (name, score)]
    return docs.mapInArrow(decide, StructType([*fields, *more]))
