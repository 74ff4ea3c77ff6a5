"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits a sample of the vectors in two, again and again, at the median of the
projections on the difference of two random members, until a leaf holds ``LEAF`` of them,
or a ``TREE_LEAVES``-th part of the sample if that is more.
Every vector of the table is then put into its leaf of every tree. A query walks all trees
through one shared priority queue: the most promising branch of any tree comes next, and a
branch is as promising as the smallest margin on its path. The ``LEAVES`` leaves that come
first are searched by exact inner product, in double precision.

The forest is fitted on at most ``SAMPLE`` vectors, so its size is bounded and it goes to
every task; the table that it indexes is not. Equal vectors are indexed once with their
smallest ids, as no query can see more of them. A leaf's vectors and its queries are dealt
out in blocks by measured numbers, and each pair of blocks is a piece of work, so a
crowded leaf grows no task. A piece returns at most ``k + 1`` vectors per query.

Defined cases: rows with a null id, or whose vector is null, empty, zero, of another length
than most of the sample, or holds null or non-finite components, take no part. Of repeated
rows of one id with different vectors each is a candidate, and a query never finds its own id.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from perexpo.llm.common import batches_of, matrix_of, runs, stored
from perexpo.llm.vectors import smallest_ids, usable

TREES = 12
LEAF = 64
#: Leaves of a tree at most, and leaves over all trees that a query looks at. With these the
#: recall was 0.97 on 10,000 vectors of 64 dimensions without structure inside their classes, the
#: hardest kind.
TREE_LEAVES = 64
LEAVES = 80
SAMPLE = 65_536
BLOCK = 2048
_SEED = 5


@dataclass
class Forest:
    """Inner nodes of all trees in one list: plane, offset, and the two children.

    A child is an inner node, or a leaf if negative: leaf n is -1 - n. ``roots`` has one entry
    per tree; leaves are numbered over all trees.
    """

    size: int
    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, leaf: int) -> Forest:
        rng = np.random.default_rng(_SEED)
        planes: list[np.ndarray] = []
        offsets: list[float] = []
        children: list[list[int]] = []
        leaves = 0

        def grow(rows: np.ndarray) -> int:
            nonlocal leaves
            if len(rows) > leaf:
                for _ in range(3):
                    one, two = sample[rng.choice(rows, 2, replace=False)]
                    plane = one - two
                    along = sample[rows] @ plane
                    middle = float(np.median(along))
                    left = along < middle
                    if 0 < left.sum() < len(rows):
                        number = len(planes)
                        planes.append(plane / np.linalg.norm(plane))
                        offsets.append(middle / float(np.linalg.norm(plane)))
                        children.append([0, 0])
                        children[number] = [grow(rows[left]), grow(rows[~left])]
                        return number
            leaves += 1
            return -leaves

        roots = [grow(np.arange(len(sample))) for _ in range(trees)]
        size = sample.shape[1]
        return cls(size, np.array(planes).reshape(-1, size), np.array(offsets), np.array(children).reshape(-1, 2), roots)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        if not len(self.planes):
            return np.tile(-1 - np.array(self.roots), (len(vectors), 1))
        right = vectors @ self.planes.T >= self.offsets
        rows = np.arange(len(vectors))
        out = np.empty((len(vectors), len(self.roots)), dtype=np.int64)
        for tree, root in enumerate(self.roots):
            now = np.full(len(vectors), root)
            while (inner := now >= 0).any():
                at = now[inner]
                now[inner] = self.children[at, right[rows[inner], at].astype(int)]
            out[:, tree] = -1 - now
        return out

    def search(self, vector: np.ndarray, leaves: int) -> list[int]:
        """The leaves to look at, most promising first, by one queue over all trees."""
        margins = (self.planes @ vector - self.offsets).tolist() if len(self.planes) else []
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < leaves:
            lost, node = heapq.heappop(queue)
            while node >= 0:
                margin = margins[node]
                left, right = self.children[node].tolist()
                near, far = (right, left) if margin >= 0 else (left, right)
                heapq.heappush(queue, (max(lost, abs(margin)), far))
                node = near
            found.append(-1 - node)
        return found


def fit(
    different: DataFrame, trees: int = TREES, leaf: int = LEAF, tree_leaves: int = TREE_LEAVES, sample: int = SAMPLE
) -> Forest | None:
    """A forest over at most ``sample`` of the vectors, those with the smallest hashes."""
    rows = different.select("vector").orderBy(F.xxhash64("vector")).limit(sample).collect()
    if not rows:
        return None
    size = Counter(len(r.vector) for r in rows).most_common(1)[0][0]
    vectors = np.array([r.vector for r in rows if len(r.vector) == size], dtype=np.float64)
    return Forest.fit(vectors, trees, max(leaf, -(-len(vectors) // tree_leaves)))


def _assigned(vectors: DataFrame, forest: Forest, leaves: int | None) -> DataFrame:
    """(node, vector, leaf): in every tree, or the ``leaves`` that a query looks at."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            m = matrix_of(pa.chunked_array([batch["vector"]])).astype(np.float64)
            found = forest.leaves(m).tolist() if leaves is None else [forest.search(v, leaves) for v in m]
            yield pa.RecordBatch.from_arrays(
                [batch["node"], batch["vector"], pa.array(found, pa.list_(pa.int64()))], ["node", "vector", "leaves"]
            )

    known = vectors.where(F.size("vector") == forest.size).select("node", "vector")
    kind = known.schema["vector"].dataType.simpleString()
    assigned = known.mapInArrow(work, f"node bigint, vector {kind}, leaves array<bigint>")
    return assigned.select("node", "vector", F.explode("leaves").alias("leaf"))


def search(
    table: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    trees: int = TREES,
    leaf: int = LEAF,
    tree_leaves: int = TREE_LEAVES,
    leaves: int = LEAVES,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query its ``k`` nearest other rows that the forest finds.

    ``is_query`` is a condition on the columns ``vec_id``. Nearest first by inner product, ties to the smaller id.
    """
    # Single precision stays what it is; any other number is taken in double precision.
    single = isinstance(table.schema[vector].dataType.elementType, FloatType)
    own = "array<float>" if single else "array<double>"
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast(own).alias("vector"))
    rows = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    grouped = smallest_ids(rows, ["vector"], k + 1).withColumn("node", F.get("ids", F.lit(0)))
    asked = rows.where(is_query).groupBy("vector").agg(F.lit(True).alias("asked"))
    different = stored(grouped.join(asked, "vector", "left").fillna(False, ["asked"]), "different")
    forest = fit(different, trees, leaf, tree_leaves, sample)
    spark = table.sparkSession
    if forest is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    indexed = _assigned(different, forest, None)
    queries = _assigned(different.where("asked"), forest, leaves)

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    # At most one row per leaf of the forest.
    sizes = stored(parts(queries, "rows_of_blocks").join(parts(indexed, "columns_of_blocks"), "leaf"), "leaf-sizes")

    def dealt(side: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        placed = side.join(F.broadcast(sizes), "leaf")
        block_of = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        across = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        named = placed.select("leaf", "node", "vector", F.lit(asks).alias("asks"), block_of.alias("own"), across.alias("other"))
        i, j = ("own", "other") if asks else ("other", "own")
        return named.select("leaf", F.col(i).alias("i"), F.col(j).alias("j"), "asks", "node", "vector")

    both = dealt(queries, "rows_of_blocks", "columns_of_blocks", True).unionByName(
        dealt(indexed, "columns_of_blocks", "rows_of_blocks", False)
    )
    piece = ["leaf", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, piece):
            m = matrix_of(rows["vector"]).astype(np.float64)
            asks = rows["asks"].to_numpy()
            node = rows["node"].to_numpy()
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.arange(start, end)
                who, what = own[asks[own]], own[~asks[own]]
                for some in (who[x : x + 512] for x in range(0, len(who) if len(what) else 0, 512)):
                    yield _best(node[some], node[what], m[some] @ m[what].T, k + 1)

    found = both.repartition(*piece).sortWithinPartitions(*piece).mapInArrow(
        compare, "query bigint, node bigint, score double"
    )
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    top = (
        found.repartition("query")
        .dropDuplicates(["query", "node"])
        .withColumn("_place", F.row_number().over(nearest))
        .where(F.col("_place") <= k + 1)
    )
    expanded = (
        top.join(different.select("node", "ids"), "node")
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id"))).alias("found"))
        .withColumn("found", F.slice("found", 1, k + 1))
    )
    results = stored(
        different.where("asked").select("vector", F.col("node").alias("query")).join(expanded, "query").select("vector", "found"),
        "results",
    )
    listed = rows.where(is_query).join(results, "vector").select(
        F.col("vec_id").alias("query_id"), F.filter("found", lambda f: f["vec_id"] != F.col("vec_id")).alias("found")
    )
    return listed.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.away")).alias("score")
    )


def _best(queries: np.ndarray, nodes: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` best of each row of scores; of those that tie the smaller nodes."""
    order = np.argsort(nodes, kind="stable")
    nodes, scores = nodes[order], scores[:, order]
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(queries, best.shape[1])),
            pa.array(nodes[best].ravel()),
            pa.array(np.take_along_axis(scores, best, axis=1).ravel()),
        ],
        ["query", "node", "score"],
    )
