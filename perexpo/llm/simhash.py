"""Near-duplicates by 64-bit SimHash, linked by BK-trees.

A document's fingerprint is the bitwise majority of the hashes of its word shingles.
Fingerprints that differ in at most ``RADIUS`` = 3 bits agree in one of four 16-bit bands,
so each is put into the four shards of its band values, and every shard gets a BK-tree: the
children of a node hang on edges labelled with their Hamming distance to it, and a search
follows only the edges within the radius of its own distance. Trees together grow with the
corpus, so a tree goes to the tasks that search its shard and to no others.

Only different fingerprints enter the trees, so copies cost nothing, however many there
are. A shard of more than ``TREE`` fingerprints becomes several trees; every pair of
them is a block of its own, so no task grows with a shard. A block returns a spanning
forest of the links that it found, never all of its pairs.

Defined cases: null and empty texts have fingerprint 0, and are linked like any other.
A text of fewer words than a shingle is one shingle. Repeated rows return as often as
they occur. A null doc_id never names a component unless no other member has one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perexpo.llm.common import batches_of, give_back, stored, with_columns
from perexpo.llm.graph import components

WORDS = 3
RADIUS = 3
TREE = 4096
_BANDS = RADIUS + 1
_SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Majority of the bits of XXH64 over all shingles, as an unsigned number."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])
    width = min(words, len(found))
    n = len(found) - width + 1
    begin, end = starts[:n].tolist(), (ends[width - 1 :] - 1).tolist()
    digest = functools.partial(xxhash.xxh64_intdigest, seed=_SEED)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        hashes = [digest(joined[i:j]) for i, j in zip(begin[at : at + _BLOCK], end[at : at + _BLOCK], strict=True)]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, keep: str | None = None
) -> DataFrame:
    """(doc_id, fp) of every row; fp is a signed BIGINT with the bits of the fingerprint.

    With ``keep`` also the column of this name, a BIGINT, as ``kept``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1024):
            found = np.array([fingerprint(t, words) for t in batch["text"].to_pylist()], dtype=np.uint64)
            yield with_columns(batch, ["text"], fp=pa.array(found.view(np.int64)))
        give_back()

    own = [F.col(f"`{keep}`").alias("kept")] if keep else []
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), *own, F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, kept bigint, fp bigint" if keep else "doc_id bigint, fp bigint")


class BKTree:
    """Nodes are (code, children by distance)."""

    def __init__(self, codes: list[int]):
        self.root = (codes[0], {})
        for code in codes[1:]:
            node = self.root
            while distance := (code ^ node[0]).bit_count():
                if distance not in node[1]:
                    node[1][distance] = (code, {})
                    break
                node = node[1][distance]

    def within(self, code: int, radius: int) -> Iterator[int]:
        stack = [self.root]
        while stack:
            own, children = stack.pop()
            distance = (code ^ own).bit_count()
            if distance <= radius:
                yield own
            for edge in range(distance - radius, distance + radius + 1):
                if edge in children:
                    stack.append(children[edge])


def _forest(tree: list[int], searched: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between the codes of a tree and those searched for."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    found = BKTree(tree)
    for code in searched:
        for other in found.within(code, radius):
            one, two = root(code), root(other)
            if one != two:
                parent[max(one, two)] = min(one, two)
                yield code, other


def links(codes: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b): links that connect all of the different fingerprints ``fp`` that are within the radius.

    The links span the same components as all pairs within the radius do.
    """
    bands = radius + 1
    bits = 64 // bands
    band = [
        F.shiftrightunsigned("fp", i * bits).bitwiseAND(F.lit((1 << bits) - 1)) if i < bands - 1
        else F.shiftrightunsigned("fp", i * bits)
        for i in range(bands)
    ]
    sharded = codes.select("fp", F.posexplode(F.array(*band)).alias("band", "value"))
    large = (
        sharded.groupBy("band", "value")
        .count()
        .where(F.col("count") > tree)
        .select("band", "value", F.ceil(F.col("count") / tree).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = (
        sharded.join(large, ["band", "value"], "left")
        .fillna(1, ["parts"])
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "band",
            "value",
            F.least("part", "other").alias("i"),
            F.greatest("part", "other").alias("j"),
            "part",
            "fp",
        )
    )
    block = ["band", "value", "i", "j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple[int, int]], i: int, j: int) -> list[tuple[int, int]]:
            codes = [c for _, c in rows]
            if i == j:
                return list(_forest(codes, codes, radius))
            first = [c for p, c in rows if p == i]
            second = [c for p, c in rows if p == j]
            return list(_forest(first, second, radius)) if first and second else []

        key, rows, out = None, [], []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for *own, p, code in zip(*columns, strict=True):
                if own != key:
                    if len(rows) > 1:
                        out += found(rows, key[2], key[3])
                    key, rows = own, []
                rows.append((p, code & 0xFFFFFFFFFFFFFFFF))
            yield _pairs(out)
            out = []
        if len(rows) > 1:
            yield _pairs(found(rows, key[2], key[3]))

    return (
        placed.repartition(*block).sortWithinPartitions(*block, "part", "fp").mapInArrow(search, "a bigint, b bigint")
    )


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(rows, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    radius: int = RADIUS,
    tree: int = TREE,
    words: int = WORDS,
    keep: str | None = None,
) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id of its group.

    With ``keep``, a BIGINT column that tells rows of one doc_id apart, also ``kept``, its value, and ``component``,
    a number of the group that no other group has.
    """
    prints = stored(fingerprints(docs, text, doc_id, words, keep), "fingerprints")
    codes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "codes")
    found = components(links(codes, radius, tree))
    grouped = codes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    named = stored(grouped, "groups")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    more = ["kept", "component"] if keep else []
    labels = named.join(smallest, "component").select("fp", "component_id", "component")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id", *more)
