"""Token ids as wavelet matrices: one compressed file per shard, searchable as it is.

A wavelet matrix keeps a sequence as one bit-plane per bit of the ids, highest first. After
each plane the sequence is dealt out, stably, by that bit: zeros before ones. With the
number of ones before any place (rank) a single id is read, the occurrences of an id are
counted up to any place, and its k-th occurrence is found (select), all without unpacking.

Documents are dealt out by ranges of their id, encoded in order and packed into shards of
bounded size, which Spark's Parquet writer puts into one file each: a task that is lost is
run again, and any store that Spark can write to will do. A shard's place among all ids
follows from a running sum over shards, first within a task's range, then over ranges.

Defined cases: a null text is empty, so its document is the end id alone. A null doc_id
comes first. Rows of the same doc_id stand side by side in order of their texts. An empty
table writes no shard. The literal of an added token in a text is that token's id, as the
library has it by default.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perexpo.llm.common import stored

END_ID = 2
#: A shard ends with the document that reaches this number of ids.
SHARD_IDS = 1 << 20
#: So many different words are held with their ids, and as many of those before them.
_WORDS_KEPT = 3 << 16
#: Texts are cut into stretches chunk by chunk, of so many characters.
_CHUNK_CHARS = 4 << 20
#: Bits between two entries of the stored rank directory.
_STEP = 512

SHARD = (
    "part int, shard int, doc_ids array<bigint>, lengths array<int>, n_tokens bigint, "
    "zeros array<bigint>, planes array<binary>, ranks array<binary>"
)


@dataclass
class WaveletMatrix:
    """planes: the bits of each level in 64-bit words; ones: how many precede each word."""

    size: int
    zeros: list[int]
    planes: list[np.ndarray]
    ones: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes = [], []
        now = ids
        for bit in reversed(range(bits)):
            is_one = (now & now.dtype.type(1 << bit)) != 0
            packed = np.packbits(is_one, bitorder="little").tobytes()
            planes.append(np.frombuffer(packed + bytes(-len(packed) % 8), dtype="<u8"))
            zeros.append(len(now) - np.count_nonzero(is_one))
            dealt = np.empty_like(now)
            np.compress(is_one, now, out=dealt[zeros[-1] :])
            np.compress(~is_one, now, out=dealt[: zeros[-1]])
            now = dealt
        return cls(len(ids), zeros, planes, [_before(p) for p in planes])

    def _rank(self, level: int, place: np.ndarray) -> np.ndarray:
        """Ones of a level before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        plane = np.append(self.planes[level], np.uint64(0))
        below = plane[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.ones[level][word] + np.bitwise_count(below)

    def access(self, place: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        place = np.asarray(place, dtype=np.int64)
        out = np.zeros(len(place), dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (self.planes[level][place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._rank(level, place)
            out = out << 1 | one
            place = np.where(one, zeros + ones, place - ones)
        return out

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """Where the occurrences of an id before a place lie after the last level."""
        if token >> len(self.planes):
            return 0, 0
        ends = np.array([0, upto], dtype=np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = self._rank(level, ends)
            ends = zeros + ones if token >> (len(self.zeros) - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def rank(self, token: int, upto: int) -> int:
        """How often an id occurs before a place."""
        first, last = self._range(token, upto)
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of an id, counted from 0; -1 if there are no more."""
        first, last = self._range(token, self.size)
        if not 0 <= k < last - first:
            return -1
        place = first + k
        for level in reversed(range(len(self.planes))):
            one = token >> (len(self.planes) - 1 - level) & 1
            wanted = place - self.zeros[level] if one else place
            ones = self.ones[level]
            before = ones if one else (np.arange(len(ones), dtype=np.int64) << 6) - ones
            word = int(np.searchsorted(before, wanted, side="right")) - 1
            bits = np.unpackbits(self.planes[level][word : word + 1].view(np.uint8), bitorder="little")
            place = (word << 6) + int(np.flatnonzero(bits == one)[wanted - int(before[word])])
        return place

    def ids(self) -> np.ndarray:
        """All ids, from the last level up: each level's order is undone, then its bit added."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.size, dtype=kind)
        for bit, level in enumerate(reversed(range(len(self.planes)))):
            is_one = np.unpackbits(self.planes[level].view(np.uint8), count=self.size, bitorder="little").astype(bool)
            before = np.empty_like(now)
            before[~is_one] = now[: self.zeros[level]]
            before[is_one] = now[self.zeros[level] :] | kind(1 << bit)
            now = before
        return now.astype(np.uint32)

    def columns(self) -> tuple[list[int], list[bytes], list[bytes]]:
        """zeros, planes and rank directories as they are stored."""
        every = _STEP >> 6
        return (
            self.zeros,
            [p.tobytes() for p in self.planes],
            [o[::every].astype("<u4").tobytes() for o in self.ones],
        )

    @classmethod
    def read(cls, size: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> WaveletMatrix:
        every = _STEP >> 6
        words = [np.frombuffer(p, dtype="<u8") for p in planes]
        ones = []
        for word, rank in zip(words, ranks, strict=True):
            # Within a block the counts of its words are added to the stored rank.
            inside = np.zeros(-(-(len(word) + 1) // every) * every, dtype=np.int64)
            inside[1 : len(word) + 1] = np.bitwise_count(word)
            inside[::every] = np.frombuffer(rank, dtype="<u4")
            ones.append(inside.reshape(-1, every).cumsum(axis=1).ravel()[: len(word) + 1])
        return cls(size, zeros, words, ones)


def _before(plane: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)])


class Encoder:
    """Ids of texts by a public tokenizer, as little-endian bytes of ``dtype``.

    Stretches between spaces always start a pre-token, so each different one of a chunk of texts
    is split once, and each different word encoded once and kept, up to a bound. Texts in which a
    space meets other white space are split whole. The splitting is the byte-level one, by its own
    pattern; where signs beyond the Latin letters come in, the library splits.

    The definition's added tokens are found before anything else, and what lies between two
    of them is a text of its own, as in the library. Added tokens that take more than their
    own characters, or not every place, and other ways of splitting are left to the library.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        read = json.loads(definition)
        added = read.get("added_tokens") or []
        splits = read.get("pre_tokenizer") or {}
        byte_level = splits.get("type") == "ByteLevel" and not splits.get("add_prefix_space") and splits.get("use_regex", True)
        plain = not read.get("normalizer") and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
        self.added = {t["content"]: t["id"] for t in added}
        # Of those that start at one place the longest counts.
        self.marked = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.whole_texts = not (plain and byte_level)
        self.bits = max(self.tokenizer.get_vocab_size() - 1, 1).bit_length()
        self.code = "H" if self.bits <= 16 else "I"
        self.dtype = np.dtype(f"<u{array(self.code).itemsize}")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _new(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, each given to the model in the byte-level alphabet."""
        tokenize = self.tokenizer.model.tokenize
        # All are translated at once, unless a word itself holds what stands between two.
        signs = "\0".join(words).encode().decode("latin-1").translate(_ALPHABET).split(_NULL)
        if len(signs) != len(words):
            signs = [word.encode().decode("latin-1").translate(_ALPHABET) for word in words]
        return [array(self.code, [t.id for t in tokenize(s)]).tobytes() for s in signs]

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of different pre-tokens. When the cache is full, what was not asked for since it was last full goes."""
        older = self.older.get
        found = [older(word) if ids is None else ids for word, ids in zip(words, map(self.words.get, words), strict=True)]
        missing = [at for at, ids in enumerate(found) if ids is None]
        for at, ids in zip(missing, self._new([words[at] for at in missing]), strict=True):
            found[at] = ids
        if len(self.words) >= _WORDS_KEPT:
            self.words, self.older = {}, self.words
        self.words.update(zip(words, found, strict=True))
        return found

    def _split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if _BEYOND_LATIN.search(text):
            return [text[i:j] for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return _PRE_TOKENS.findall(text)

    def _plain(self, texts: list[str]) -> pa.LargeBinaryArray:
        """The ids of texts without added tokens."""
        split = self._split if _BEYOND_LATIN.search("".join(texts)) else _PRE_TOKENS.findall
        words: list[str] = []
        sizes = array("q")
        for text in texts:
            some = split(text)
            sizes.append(len(some))
            words += some
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        del words
        ids = pa.array(self._known(_strings(coded.dictionary)), pa.large_binary()).take(coded.indices)
        return _united(ids, np.frombuffer(sizes, np.int64))

    def _marked(self, text: str) -> bytes:
        """The ids of a text that may hold added tokens."""
        if self.whole_texts:
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        between, marks, at = [], [], 0
        for found in self.marked.finditer(text):
            between.append(text[at : found.start()])
            marks.append(array(self.code, [self.added[found[0]]]).tobytes())
            at = found.end()
        parts = self._plain([*between, text[at:]]).to_pylist()
        return b"".join(chain.from_iterable(zip(parts, [*marks, b""], strict=True)))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other and the end id behind each, and where each text ends."""
        marked = [self.whole_texts or bool(self.marked and self.marked.search(text)) for text in texts]
        whole = [mark or _meets_space(text) for text, mark in zip(texts, marked, strict=True)]
        pieces = pc.split_pattern(pa.array([("" if w else t) for t, w in zip(texts, whole, strict=True)], pa.large_string()), " ")
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        stretches = [" " + piece for piece in _strings(coded.dictionary)]
        # The first piece of a text follows no space, and a text that is not cut is one piece.
        firsts = ["" if m else t if w else t.split(" ", 1)[0] for t, m, w in zip(texts, marked, whole, strict=True)]
        end = np.array([end_id], dtype=self.dtype).tobytes()
        more = [self._marked(t) for t, m in zip(texts, marked, strict=True) if m]
        each = pa.concat_arrays([self._plain(stretches + firsts), pa.array([end, *more], pa.large_binary())])
        order = coded.indices.to_numpy().astype(np.int64)
        first = len(stretches) + np.arange(len(texts))
        first[np.flatnonzero(marked)] = len(stretches) + len(texts) + 1 + np.arange(len(more))
        order[bounds[:-1]] = first
        order = np.insert(order, bounds[1:], len(stretches) + len(texts))
        found = _united(each.take(pa.array(order)), np.diff(bounds) + 1)
        return _flat(found, self.dtype), np.frombuffer(found.buffers()[1], np.int64)[1 : len(texts) + 1] // self.dtype.itemsize


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _flat(column: pa.LargeBinaryArray, dtype: np.dtype) -> np.ndarray:
    """The bytes of all rows as numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(dtype) if data else np.empty(0, dtype)


def _united(column: pa.LargeBinaryArray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """Runs of so many rows each, put together. The column does not start within another one."""
    offsets = np.frombuffer(column.buffers()[1], np.int64) if len(column) else np.zeros(1, np.int64)
    bounds = np.ascontiguousarray(offsets[np.concatenate([[0], np.cumsum(sizes)])])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), column.buffers()[2] or pa.py_buffer(b"")])


#: The first code points after the Latin letters, before which all Unicode versions agree on what is a letter.
_BEYOND = 0x250
_BEYOND_LATIN = re.compile(f"[^\0-{chr(_BEYOND - 1)}]")


def _kinds(kind: str) -> str:
    """The Latin signs of a Unicode category, as they stand in a set of a pattern."""
    return "".join(re.escape(chr(c)) for c in range(_BEYOND) if unicodedata.category(chr(c)).startswith(kind))


def _pre_tokens() -> re.Pattern:
    """The byte-level model's own pattern, its classes spelt out."""
    letters, numbers, spaces = _kinds("L"), _kinds("N"), "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0"
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


_PRE_TOKENS = _pre_tokens()


def _alphabet() -> dict[int, int]:
    """The byte-level model's signs: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


_ALPHABET = _alphabet()
_NULL = chr(_ALPHABET[0])


def _meets_space(text: str) -> bool:
    """Whether a space is followed by white space or by nothing."""
    if text.endswith(" ") or "  " in text:
        return True
    return any(f" {c}" in text for c in _SPACES if c in text)


#: White space other than the space, as code points; more than the tokenizer's own would do no harm.
_SPACES = [
    *map(chr, (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680)),
    *map(chr, range(0x2000, 0x200B)),
    *map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)),
]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts, a null text as an empty one, in chunks that end with the text that reaches _CHUNK_CHARS."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for name, value in zip(batch["doc_id"], batch["text"], strict=True):
            ids.append(name.as_py())
            texts.append(value.as_py() or "")
            size += len(texts[-1])
            if size >= _CHUNK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


@functools.lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    """Kept by the worker from task to task."""
    return Encoder(definition)


def write_shards(
    docs: DataFrame,
    path: str,
    definition: str,
    text: str = "text",
    doc_id: str = "doc_id",
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode the texts and write their ids as shards; ``definition`` is the tokenizer's JSON."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition)
        bits = max(encoder.bits, end_id.bit_length())
        part, shard = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            zeros, planes, ranks = WaveletMatrix.of(ids, bits).columns()
            values = {
                "part": [part],
                "shard": [shard],
                "doc_ids": [list(names)],
                "lengths": [list(lengths)],
                "n_tokens": [len(ids)],
                "zeros": [zeros],
                "planes": [planes],
                "ranks": [ranks],
            }
            for held in (names, lengths, parts):
                held.clear()
            return pa.RecordBatch.from_pydict(values, schema=_ARROW)

        for ids, texts in _chunks(batches):
            flat, ends = encoder.encode(texts, end_id)
            at = before = 0
            for name, end in zip(ids, ends.tolist(), strict=True):
                names.append(name)
                lengths.append(end - before)
                size, before = size + end - before, end
                if size >= shard_ids:
                    parts.append(flat[at:end])
                    yield row()
                    shard, size, at = shard + 1, 0, end
            parts.append(flat[at:])
        if names:
            yield row()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(pack, SHARD)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", 1)
        .parquet(path)
    )


_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("shard", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
        ("n_tokens", pa.int64()),
        ("zeros", pa.list_(pa.int64())),
        ("planes", pa.list_(pa.binary())),
        ("ranks", pa.list_(pa.binary())),
    ]
)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards and ``base``, the number of ids in all shards before each.

    The running sums see one row per shard, and one per range.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    whole = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = whole.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("part", "shard", (F.col("part_base") + F.col("inside")).alias("base"))
    )
    # Written, so that the planner knows how small it is and need not deal out the planes.
    return shards.join(stored(base, "bases"), ["part", "shard"])


def matrix(row: dict) -> WaveletMatrix:
    """The wavelet matrix of a shard row."""
    return WaveletMatrix.read(row["n_tokens"], row["zeros"], row["planes"], row["ranks"])


def read_documents(
    shards: DataFrame,
    then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter,
    schema: str = "doc_id bigint, start bigint, ids array<int>",
) -> DataFrame:
    """(doc_id, start, ids) of every document, in the order of its shard.

    What is to be made of them in the same task, ``then`` makes, as rows of ``schema``.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = matrix(row).ids()
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                for at in range(0, len(lengths), 1024):
                    here = slice(at, at + 1024)
                    first, last = starts[here][0], ends[here][-1]
                    offsets = np.append(starts[here], last) - first
                    lists = pa.ListArray.from_arrays(
                        pa.array(offsets.astype(np.int32)), pa.array(ids[first:last].view(np.int32))
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][here], pa.int64()), pa.array(row["base"] + starts[here]), lists],
                        ["doc_id", "start", "ids"],
                    )

    return shards.mapInArrow(lambda batches: then(unpack(batches)), schema)


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(n, places): how often each shard holds an id, and where in the whole sequence, read from the planes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = matrix(row)
                n = found.count(token)
                places = [row["base"] + found.select(token, k) for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int64()), pa.array([places], pa.list_(pa.int64()))], ["n", "places"]
                )

    return shards.mapInArrow(find, "n bigint, places array<bigint>")
