"""Near-duplicate vectors by random-hyperplane sign hashing.

Every vector is hashed in ``TABLES`` tables by the signs of its products with ``BITS``
random directions; vectors with the same label and signs in some table share a bucket, and
all of a bucket are compared by their exact cosine. Two vectors of cosine c agree in one
sign with probability 1 - arccos(c) / pi, so a pair at the threshold of 0.93 is missed by
all tables with probability (1 - 0.88 ** BITS) ** TABLES, about 1e-4.

Equal vectors are compared once: the tables hold different (label, vector) pairs with the
number of their rows. A bucket of more than ``BLOCK`` vectors is dealt out into blocks, and
each pair of blocks is a piece of work of its own, so all pairs are compared and no task
grows with a bucket. Pairs are not returned: a piece of work returns how many links each of
its vectors has and a spanning forest of them. A pair that shares buckets in several tables
counts in the first of these only, which both vectors' signs tell.

Defined cases: rows with a null label, or whose vector is null, empty, zero or holds null
or non-finite components, are linked with nothing. Vectors of different lengths do not link.
Repeated rows of the same vec_id are rows of their own in the counts of others, and share
their own result. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from perexpo.llm.common import batches_of, bounds_of, matrix_of, runs, stored, with_columns
from perexpo.llm.graph import components
from perexpo.llm.vectors import usable

COSINE = 0.93
TABLES = 28
BITS = 10
BLOCK = 1024
_SEED = 11


def _directions(size: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng((_SEED, size)).normal(size=(tables * bits, size))


def _signed(different: DataFrame, tables: int, bits: int) -> DataFrame:
    """All columns and ``signs``: for every table the signs as a 16-bit number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches_of(batches, 1024):
            signs = []
            for value in batch["vector"].to_pylist():
                if len(value) not in known:
                    known[len(value)] = _directions(len(value), tables, bits)
                above = (known[len(value)] @ np.asarray(value, dtype=np.float64) > 0).reshape(tables, bits)
                signs.append((above @ (1 << np.arange(bits))).tolist())
            yield with_columns(batch, (), signs=pa.array(signs, pa.list_(pa.int32())))

    more = StructField("signs", ArrayType(IntegerType()))
    return different.mapInArrow(work, StructType([*different.schema.fields, more]))


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


class _Rows:
    """The columns of some pieces of work as arrays."""

    def __init__(self, rows: pa.Table):
        m = matrix_of(rows["vector"]).astype(np.float64)
        self.vector = m / np.linalg.norm(m, axis=1, keepdims=True)
        self.signs = matrix_of(rows["signs"])
        self.table, self.i, self.j, self.block, self.node, self.copies = (
            rows[k].to_numpy() for k in ("table", "i", "j", "block", "node", "rows")
        )

    def links(self, start: int, end: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one piece that are near enough and share no bucket of an earlier table."""
        own = slice(start, end)
        if self.i[start] == self.j[start]:
            near = np.triu(self.vector[own] @ self.vector[own].T >= least, 1)
            at, to = (x + start for x in np.nonzero(near))
        else:
            one = start + np.flatnonzero(self.block[own] == self.i[start])
            two = start + np.flatnonzero(self.block[own] == self.j[start])
            at, to = np.nonzero(self.vector[one] @ self.vector[two].T >= least)
            at, to = one[at], two[to]
        earlier = self.signs[:, : self.table[start]]
        new = np.ones(len(at), dtype=bool)
        for k in range(0, len(at), 1 << 16):
            some = slice(k, k + (1 << 16))
            new[some] = (earlier[at[some]] != earlier[to[some]]).all(axis=1)
        return at[new], to[new]


def _compare(rows: pa.Table, bounds: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """For each piece its links: numbers per vector, and a forest of (node, other)."""
    if len(bounds) == rows.num_rows + 1:
        return
    known = _Rows(rows)
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - start < 2:
            continue
        at, to = known.links(start, end, least)
        if not len(at):
            continue
        size = end - start
        links = np.bincount(at - start, known.copies[to], size) + np.bincount(to - start, known.copies[at], size)
        counted = np.flatnonzero(links)
        forest = _forest(known.node[at], known.node[to])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([known.node[start + counted], forest[:, 0]])),
                pa.array(np.concatenate([links[counted].astype(np.int64), np.zeros(len(forest), dtype=np.int64)])),
                pa.array([None] * len(counted) + forest[:, 1].tolist(), pa.int64()),
            ],
            schema=_FOUND,
        )


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of some links as many as connect the same nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        one, two = root(x), root(y)
        if one != two:
            parent[max(one, two)] = min(one, two)
            kept.append((x, y))
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def near_duplicates(
    table: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    tables: int = TABLES,
    bits: int = BITS,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    rows = table.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).alias("vector"),
        (usable(F.col(vector)) & F.col(label).isNotNull() & F.col(vec_id).isNotNull()).alias("ok"),
    )
    # Equal vectors under one label are one node, named by its smallest id.
    key = F.xxhash64("label", "vector")
    keyed = rows.where("ok").withColumn("key", key)
    different = stored(
        keyed.groupBy("key", "label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("rows")), "vectors"
    )
    signed = _signed(different.select("node", "label", "vector", "rows"), tables, bits)
    hashed = signed.select("*", F.size("vector").alias("size"), F.posexplode("signs").alias("table", "bucket"))
    bucket = ["size", "label", "table", "bucket"]
    # Few and written, so that the planner knows it can broadcast them.
    large = stored(hashed.groupBy(*bucket).count().where(F.col("count") > block), "large-buckets")
    parts = F.coalesce(F.ceil(F.col("count") / block).cast("int"), F.lit(1))
    placed = (
        hashed.join(large.select(*bucket, "count"), bucket, "left")
        .withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .drop("other", "count")
    )
    piece = [*bucket, "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, piece):
            # Vectors differ in length from piece to piece only.
            lengths = bounds_of(rows, ["size"])
            for start, end in zip(lengths, lengths[1:], strict=False):
                own = bounds[(bounds >= start) & (bounds <= end)] - start
                yield from _compare(rows.slice(start, end - start), own, cosine)

    found = stored(
        placed.repartition(*piece)
        .sortWithinPartitions(*piece)
        .mapInArrow(compare, "node bigint, links bigint, other bigint"),
        "found",
    )
    groups = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    result = stored(
        different.select("key", "label", "vector", "node", "rows")
        .join(groups, "node", "left")
        .join(counts, "node", "left")
        .select(
            "key",
            "label",
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        ),
        "linked",
    )
    linked = keyed.join(result, ["key", "label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)
