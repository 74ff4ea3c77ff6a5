"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perexpo.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every linked node with the smallest node that it can reach.

    Alternates two steps until nothing changes, a number of times that grows with the
    logarithm of the nodes: every node passes its smallest neighbour first to its larger
    neighbours, then to its smaller ones. Minima combine before the shuffle and neighbours
    are never collected, so one node that is linked with a third of all others is only a
    skewed join key, which adaptive execution splits. Each round is written to the shared
    folder, which cuts the lineage.

    Null ends and links of a node with itself are ignored; without links the result is empty.
    """
    one, two = F.col(a), F.col(b)
    now = links.where(one.isNotNull() & two.isNotNull() & (one != two))
    now = stored(now.select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("link")
        )
        now = stored(small.select("link.u", "link.v").where("u <> v").distinct(), "links")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.groupBy(F.col("v").alias("node")).agg(F.first("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    """Number and checksum of the links."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
