"""Merkle manifest of a dataset: one root for all rows, and for every row a proof against it.

Every row is a leaf. The leaves of a group (a source) form a tree of ``arity`` children a
node, and the groups' roots form a tree of the same kind above them.

Trees grow by sibling-shift self-joins. At every level the node at slot 0 of a run computes
the places of its siblings (the XOR of its own place for a binary tree, slot offsets
otherwise), an equi-join on (tree, place) brings their digests, and the slot-0 row emits the
parent. Both sides of a join hold every (tree, place) once, so a source with a third of all
rows is spread over all tasks like any other. A tree of n rows has log(n) levels, each
written to the shared folder and ``arity`` times smaller than the one below.

A parent keeps the digests of its children in order. Proofs go down the same levels: a
node's proof is its siblings, then its parent's proof.

The places of leaves come from dealing rows out by ranges of (tree, order, leaf) and adding up
the numbers of rows of the ranges before, so no task sees a whole tree.

Defined cases: groups go by their UTF-8 bytes, null first. Rows of equal order (repeated or
null ids, which come first) go by their leaf digest; equal leaves may swap places, which
changes no digest. A null value is ``-``, an empty text ``0:``. A tree of one leaf is
that leaf; with one group its root is the root. An empty table gives an empty result. Columns of
other names are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perexpo.llm.common import stored

ARITY = 16
#: The columns of a document that its leaf covers, in order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of all values together; digests go in as hex text."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def netstring(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*[netstring(v) for v in values])


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it was."""
    return F.translate(text, _UPPER, _LOWER)


def _placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` with their place in their tree, from 0, and the size ``n`` of the tree."""
    # Both parts of the number are fixed once written: the range of a row, and its row there.
    ranged = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    # A tree has one row here for each range that it touches.
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("tree").alias("_tree"),
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(tree).alias("n"),
    )
    same = (F.col("tree") == F.col("_tree")) & (part == F.col("_part"))
    return (
        ranged.join(starts, same)
        .withColumn("place", F.col("_at") + F.col("_shift"))
        .drop("_tree", "_part", "_shift", "_at")
    )


def siblings(place: Column, arity: int) -> Column:
    """Places of the other nodes of the run that ``place`` is in; the last ones may lie beyond the tree."""
    if arity == 2:
        return F.array(place.bitwiseXOR(F.lit(1).cast("bigint")))
    first = place - place % arity
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda k: first + k), lambda p: p != place)


def _up(arity: int) -> Column:
    """Place of the parent."""
    return ((F.col("place") - F.col("place") % arity) / arity).cast("bigint")


def _parents(nodes: DataFrame, arity: int) -> DataFrame:
    """The level above: (tree, place, n, digest, children); trees of one node stay behind."""
    live = nodes.where("n > 1").select("tree", "place", "n", "digest")
    heads = live.where(F.col("place") % arity == 0).withColumn("up", _up(arity))
    shifted = heads.select("tree", "up", F.explode(siblings(F.col("place"), arity)).alias("place"))
    runs = (
        heads.select("tree", "up", "place", "n", "digest")
        .unionByName(shifted.join(live, ["tree", "place"]).select("tree", "up", "place", "n", "digest"))
        .groupBy("tree", "up", "n")
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("run"))
        .withColumn("children", F.transform("run", lambda c: c["digest"]))
    )
    return runs.select(
        "tree",
        F.col("up").alias("place"),
        F.ceil(F.col("n") / arity).cast("bigint").alias("n"),
        F.sha2(F.array_join("children", "").cast("binary"), 256).alias("digest"),
        "children",
    )


def _grown(nodes: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """All levels above the leaves, until every tree is down to one node."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while largest > 1:
        nodes = stored(_parents(nodes, arity), name)
        levels.append(nodes)
        largest = -(-largest // arity)
    return levels


#: One step of a proof: the siblings to the left and to the right.
_STEP = "array<struct<left: string, right: string>>"


def _step(children: Column, slot: Column) -> Column:
    return F.struct(
        F.array_join(F.slice(children, 1, slot), "").alias("left"),
        F.array_join(F.slice(children, slot + 2, F.size(children)), "").alias("right"),
    )


def _led_down(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame | None, arity: int) -> DataFrame:
    """``nodes`` with ``path``, the steps of their proofs, and the columns that ``tops`` gives their tree.

    ``tops`` has a row for each tree: tree, path and columns of its own. Without it the trees
    stand alone. Every level joins the runs above it by (tree, place), never by the tree alone.
    """
    more = [] if tops is None else [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for level in [*reversed(levels), nodes]:
        alone = level.where("n = 1")
        known = alone.withColumn("path", F.array().cast(_STEP)) if tops is None else alone.join(tops, "tree")
        if above is not None:
            up = above.select(
                "tree", F.col("place").alias("up"), F.col("children").alias("run"), F.col("path").alias("onward"), *more
            )
            below = level.where("n > 1").withColumn("up", _up(arity)).join(up, ["tree", "up"])
            own = _step(F.col("run"), (F.col("place") % arity).cast("int"))
            below = below.withColumn("path", F.concat(F.array(own), "onward"))
            known = known.unionByName(below.drop("up", "run", "onward"))
        above = known if level is nodes else stored(known, "proofs")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def manifest(leaves: DataFrame, group: str, order: Sequence[str], arity: int = ARITY) -> DataFrame:
    """``leaves`` with ``subroot`` (of their group), ``root`` (of all) and ``path`` (their proof).

    ``leaves`` has a column ``leaf``; rows of a group ascend by ``order``, then leaf. All columns
    come back, except that columns named as the three are replaced.
    """
    keys = [f"_{i}" for i in range(len(order))]
    rows = leaves.select(
        F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-")).alias("tree"),
        *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)],
        F.col("leaf").alias("digest"),
    )
    placed = stored(_placed(rows, [*keys, "digest"]).select("row", "tree", "place", "n", "digest"), "places")
    levels = _grown(placed, arity, "nodes")
    roots = [level.where("n = 1").select("tree", "digest") for level in [placed, *levels]]
    # The groups' roots are the leaves of one more tree.
    single = functools.reduce(DataFrame.unionByName, roots).select(
        F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"
    )
    crown = stored(_placed(single, ["group"]), "crown")
    above = _grown(crown, arity, "crown")
    last = functools.reduce(DataFrame.unionByName, [x.where("n = 1").select("digest") for x in [crown, *above]])
    tops = _led_down(crown, above, None, arity).select(
        F.col("group").alias("tree"),
        F.col("digest").alias("subroot"),
        last.agg(F.max("digest")).scalar().alias("root"),
        "path",
    )
    found = _led_down(placed, levels, stored(tops, "tops"), arity)
    kept = [F.col(f"row.`{c}`") for c in leaves.columns if c not in ("subroot", "root", "path")]
    return found.select(*kept, "subroot", "root", "path")


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf): digests of whole documents, without their texts.

    With ``tampered`` also ``other_leaf``: the digest after the text of the rows for which it holds
    was put in lower case, and null for the rest.
    """
    values = [F.col(c) for c in COVERED]
    out = [F.col("doc_id"), F.col("source"), leaf_of(values).alias("leaf")]
    if tampered is not None:
        changed = leaf_of([folded(v) if c == "text" else v for c, v in zip(COVERED, values, strict=True)])
        out.append(F.when(tampered, changed).alias("other_leaf"))
    return docs.select(*out)
