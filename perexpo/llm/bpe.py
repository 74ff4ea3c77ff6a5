"""Byte-level BPE encoding and decoding.

Text is split into words by the tokenizer's pattern, and each word starts as its bytes: the pair of
neighbouring pieces of the lowest rank is joined, the first one if there are several, until no pair has a
rank. The pairs of a long word wait in a heap, so it takes little more than time in proportion to its length.
A word that is a piece itself is that piece, as in the library. Documents are worked through batch by
batch where they are, each different word of a task once while a bounded cache holds it. Texts are not
shuffled, so documents, however skewed, never meet, and a lost task is simply run again.

Defined cases: a null text is an empty one and has no ids. Repeated rows are encoded each.
Special tokens are ordinary text. An id that the
vocabulary does not hold is an error on decoding.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from perexpo.llm.common import batches_of, give_back, with_columns

Ranks = dict[bytes, int]
#: A batch of documents ends after so many characters; a longer text ends one by itself.
CHUNK_CHARS = 2 << 20
#: So many different words, and as many stretches between spaces, at most are held with their ids.
KEPT = 1 << 17
#: Words of more bytes are merged with a heap.
SHORT = 32
_NO_RANK = 1 << 62
_ROWS = 1024


def read_ranks(path: str) -> Ranks:
    """The rank file of a public tokenizer: base64 of a piece and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def merged(word: bytes, ranks: Ranks, most: int) -> list[int]:
    """The ids of one word; no piece has more than ``most`` bytes."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return _merged_short(word, ranks) if len(word) <= SHORT else _merged_long(word, ranks, most)


def _merged_short(word: bytes, ranks: Ranks) -> list[int]:
    """By a look at all pairs for each join, which is faster than a heap for few."""
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], _NO_RANK) for i in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == _NO_RANK:
            break
        at = pairs.index(best)
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(pieces[at - 1] + pieces[at], _NO_RANK)
        if at < len(pairs):
            pairs[at] = ranks.get(pieces[at] + pieces[at + 1], _NO_RANK)
    return [ranks[piece] for piece in pieces]


def _merged_long(word: bytes, ranks: Ranks, most: int) -> list[int]:
    """Pairs wait in a heap by rank and place. One whose pieces have been joined to others since is passed over."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts at a place; 0 if none does
    before = list(range(-1, n))  # where the piece before it starts
    heap: list[tuple[int, int, int]] = []

    def push(at: int) -> None:
        middle = end[at]
        if middle < n and end[middle] - at <= most:
            rank = ranks.get(word[at : end[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, end[middle]))

    for at in range(n):
        push(at)
    while heap:
        _, at, upto = heapq.heappop(heap)
        middle = end[at]
        if not middle or middle >= n or end[middle] != upto:
            continue
        end[at], end[middle] = upto, 0
        if upto < n:
            before[upto] = at
        push(at)
        if before[at] >= 0:
            push(before[at])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


class _Encoder:
    """Ids of texts as little-endian 32-bit integers.

    A place before a space that is followed by something else than white space always
    starts a word, so what lies between two such places is split on its own, and each
    different stretch only once. Texts with other white space after a space are split whole.
    """

    def __init__(self, pattern: str, ranks: Ranks, most_kept: int = KEPT):
        self.find = regex.compile(pattern).findall
        self.wide = regex.compile(r" \s| $").search
        self.ranks, self.most = ranks, max(map(len, ranks), default=0)
        self.most_kept = most_kept
        self.words: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = merged(word.encode("utf-8", "surrogatepass"), self.ranks, self.most)
        found = struct.pack(f"<{len(ids)}i", *ids)
        if len(word) <= _LONG:
            if len(self.words) >= self.most_kept:
                self.words.clear()
            self.words[word] = found
        return found

    def _ids(self, words: list[str]) -> bytes:
        known = self.words
        return b"".join([known.get(word) or self._word(word) for word in words])

    def _stretch(self, piece: str) -> bytes:
        """A space and what follows it up to the next."""
        letters = piece[:-1] if piece[-1:] in _MARKS else piece
        if letters.isalpha() and max(letters) < _BEYOND_LATIN:
            return self._ids([" " + letters, *piece[len(letters) :]])
        return self._ids(self.find(" " + piece))

    def encode(self, text: str) -> bytes:
        if self.wide(text):
            return self._ids(self.find(text))
        first, *rest = text.split(" ")
        known, parts = self.stretches, [self._ids(self.find(first))]
        for piece in rest:
            found = known.get(piece)
            if found is None:
                found = self._stretch(piece)
                if len(piece) <= _LONG:
                    if len(known) >= self.most_kept:
                        known.clear()
                    known[piece] = found
            parts.append(found)
        return b"".join(parts)


#: A single one of these after letters and before a space is a word of its own.
_MARKS = tuple(".,;:!?")
#: The first code point after the Latin letters, for which all Unicode versions agree on what is a letter.
_BEYOND_LATIN = chr(0x250)


#: Longer words and stretches are not held.
_LONG = 64


def encode(
    docs: DataFrame,
    ranks: Ranks,
    pattern: str,
    text: str = "text",
    name: str = "ids",
    chunk_chars: int = CHUNK_CHARS,
    kept: int = KEPT,
) -> DataFrame:
    """All columns of ``docs`` and the token ids of the text, as an array of integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(pattern, ranks, kept)

        def with_ids(part: pa.RecordBatch, found: list[bytes]) -> pa.RecordBatch:
            offsets = np.cumsum([0, *[len(f) // 4 for f in found]]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(found), dtype="<i4"), pa.int32())
            return with_columns(part, (), **{name: pa.ListArray.from_arrays(pa.array(offsets), ids)})

        for batch in batches_of(batches, _ROWS):
            found: list[bytes] = []
            start = size = 0
            for at, value in enumerate(batch[text]):
                value = value.as_py() or ""
                found.append(encoder.encode(value))
                size += len(value)
                if size >= chunk_chars or at + 1 == batch.num_rows:
                    yield with_ids(batch.slice(start, at + 1 - start), found)
                    found, start, size = [], at + 1, 0
        del encoder
        give_back()

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def pieces_of(ranks: Ranks) -> list[bytes]:
    """The piece of every id from 0 on."""
    pieces = {rank: piece for piece, rank in ranks.items()}
    return [pieces[i] for i in range(len(pieces))]


def joined(column: pa.ListArray, pieces: list[bytes]) -> list[bytes]:
    """The bytes that each list of ids stands for: their pieces, one after the other."""
    offsets = column.offsets.to_pylist()
    flat = column.values.to_numpy(zero_copy_only=False)
    piece = pieces.__getitem__
    return [b"".join(map(piece, flat[i:j].tolist())) for i, j in zip(offsets, offsets[1:], strict=False)]


def decode(encoded: DataFrame, ranks: Ranks, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and the bytes that the ids stand for."""
    pieces = pieces_of(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_columns(batch, (), **{name: pa.array(joined(batch[ids], pieces), pa.binary())})

    return encoded.mapInArrow(work, StructType([*encoded.schema.fields, StructField(name, BinaryType())]))
