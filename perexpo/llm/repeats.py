"""Passages that repeat across documents, by sparse suffix arrays.

Of the suffixes of a text (word by word) only those at minimisers are kept: in every
window of consecutive ``CORE``-word sequences the one with the smallest hash. Which
positions these are depends on the words alone, so two documents that share ``WORDS`` words
keep at least one suffix at the same place of the shared passage. The kept suffixes of all
documents are sorted, by their core and then by the words after it, and each is compared
with the nearest ones of other documents before and after it. Matches are extended right
and left, word by word, and count if they span ``WORDS`` words. A second order, by the words
before the core, finds those that the words after it separate. Overlapping matches of a
document become one span.

A suffix carries its core's 64-bit hash and, for the ``WORDS - CORE`` words on either side,
16 bits each, so one shuffle of numbers does it all and texts stay where they are. A tie
between 16-bit values can lengthen a span by a word, and where several documents share
different stretches around one core, a span can stop a few words before the longest of
them. All occurrences of one core meet in
one task: there the rows of a document are at most one in every few words of it.

Defined cases: words are runs of other than ASCII white space, compared with A-Z in
lower case. Null texts and texts of fewer than ``WORDS`` words have no spans, and a passage that
repeats inside one document only is none. Rows without a doc_id take no part. Repeated rows of
one doc_id are one document. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perexpo.llm.common import batches_of, runs

WORDS = 50
CORE = 31
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_WORDS_KEPT = 1 << 20


class _Hashes(dict):
    """64-bit hashes of words, looked up once per different word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _cores(words: np.ndarray, core: int) -> np.ndarray:
    """A hash of every sequence of ``core`` words, as differences of running sums modulo 2**64."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _BASE)]))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), inverse)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:-1], dtype=np.uint64)])
        found = (sums[core:] - sums[:-core]) * back[: len(words) - core + 1]
        found ^= found >> np.uint64(32)
        found *= _MIX
        return found ^ (found >> np.uint64(29))


def _minimisers(cores: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of every window. A stretch of one hash alone is thinned out."""
    views = np.lib.stride_tricks.sliding_window_view(cores, window)
    least = [views[k : k + 65536].argmin(axis=1) + np.arange(k, min(k + 65536, len(views))) for k in range(0, len(views), 65536)]
    places = np.unique(np.concatenate(least))
    follows = np.concatenate([[False], (np.diff(places) == 1) & (cores[places[1:]] == cores[places[:-1]])])
    first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(places))))
    last = ~np.concatenate([follows[1:], [False]])
    return places[((np.arange(len(places)) - first) % window == 0) | last]


def _around(words: np.ndarray, places: np.ndarray, core: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of the words after the core and, going back, before it; 0 beyond the text."""
    short = np.maximum((words >> np.uint64(48)).astype(np.uint16), 1)
    padded = np.concatenate([np.zeros(reach, np.uint16), short, np.zeros(reach, np.uint16)])
    steps = np.arange(reach)
    right = padded[places[:, None] + (reach + core) + steps]
    left = padded[places[:, None] + (reach - 1) - steps]
    return right, left


def suffixes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, core: int = CORE
) -> DataFrame:
    """(core, doc_id, place, after, before) of the kept suffixes."""
    reach = words - core

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        width = pa.binary(2 * reach)
        for batch in batches_of(batches, 256):
            out: list[tuple] = []
            for name, value in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = value.lower().split()
                if len(found) < words:
                    continue
                hashes = np.array([known[w] for w in found], dtype=np.uint64)
                cores = _cores(hashes, core)
                places = _minimisers(cores, reach + 1)
                out.append((np.full(len(places), name), cores[places], places, *_around(hashes, places, core, reach)))
            if not out:
                continue
            names, hashes, places, right, left = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes.view(np.int64)),
                    pa.array(names),
                    pa.array(places.astype(np.int32)),
                    *[
                        pa.FixedSizeBinaryArray.from_buffers(width, len(x), [None, pa.py_buffer(x.astype(">u2").tobytes())]).cast(pa.binary())
                        for x in (right, left)
                    ],
                ],
                ["core", "doc_id", "place", "after", "before"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text")).dropna()
    return rows.mapInArrow(work, "core bigint, doc_id bigint, place int, after binary, before binary")


def _octets(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Binary values of one size, as rows of bytes."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return np.frombuffer(b"".join(flat.to_pylist()), dtype=np.uint8).reshape(-1, size)


def _sort_words(octets: np.ndarray) -> list[np.ndarray]:
    """Bytes as big-endian numbers, the last first, as ``lexsort`` takes them."""
    size = -(-octets.shape[1] // 8) * 8
    wide = np.zeros((len(octets), size), dtype=np.uint8)
    wide[:, : octets.shape[1]] = octets
    return list(wide.view(">u8").astype(np.uint64).T[::-1])


def _shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many leading values of two tables of rows are equal and not 0."""
    same = (one == two) & (one != 0)
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def _matches(rows: pa.Table, bounds: np.ndarray, words: int, core: int) -> pa.RecordBatch:
    """What the matches of every suffix with suffixes of other documents cover together."""
    sizes = np.diff(bounds)
    several = np.repeat(sizes > 1, sizes)
    rows = rows.filter(pa.array(several))
    run = np.repeat(np.arange(len(sizes)), sizes)[several]
    name, place = rows["doc_id"].to_numpy(), rows["place"].to_numpy()
    reach = words - core
    n = len(name)
    back, ahead = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    other = np.full(n, np.iinfo(np.int64).max)
    if n:
        after, before = _octets(rows["after"], 2 * reach), _octets(rows["before"], 2 * reach)
        right, left = (np.ascontiguousarray(x).view(">u2") for x in (after, before))
        sides = _sort_words(after), _sort_words(before)
        for first, second in (sides, sides[::-1]):
            order = np.lexsort([place, name, *second, *first, run])
            for way in (order, order[::-1]):
                r, d = run[way], name[way]
                at = np.arange(n)
                follows = np.concatenate([[False], (r[1:] == r[:-1]) & (d[1:] == d[:-1])])
                # The nearest row of another document before each.
                near = np.maximum.accumulate(np.where(follows, 0, at)) - 1
                valid = (near >= 0) & (r[near] == r)
                i, j = way[at[valid]], way[near[valid]]
                e, b = _shared(right[i], right[j]), _shared(left[i], left[j])
                long = core + e + b >= words
                i, j, e, b = i[long], j[long], e[long], b[long]
                ahead[i], back[i] = np.maximum(ahead[i], e), np.maximum(back[i], b)
                other[i] = np.minimum(other[i], name[j])
    hit = back >= 0
    return pa.RecordBatch.from_arrays(
        [
            pa.array(name[hit]),
            pa.array((place[hit] - back[hit]).astype(np.int64)),
            pa.array((place[hit] + core + ahead[hit]).astype(np.int64)),
            pa.array(other[hit]),
        ],
        ["doc_id", "start", "stop", "other"],
    )


def repeated_passages(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, core: int = CORE
) -> DataFrame:
    """(doc_id, start_word, end_word, other_doc_id) of every span that repeats elsewhere.

    Words are counted from 0, the end is exclusive. ``other_doc_id`` is the smallest of the
    documents with which parts of the span were matched.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, ["core"]):
            yield _matches(rows, bounds, words, core)

    kept = suffixes(docs, text, doc_id, words, core)
    found = kept.repartition("core").sortWithinPartitions("core").mapInArrow(
        compare, "doc_id bigint, start bigint, stop bigint, other bigint"
    )
    earlier = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("start") <= F.max("stop").over(earlier), 0).otherwise(1)
    spans = found.withColumn("opened", opened).withColumn("span", F.sum("opened").over(upto))
    return spans.groupBy("doc_id", "span").agg(
        F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("other").alias("other_doc_id")
    ).drop("span")
