"""Exact quantiles of several columns at once, in a number of reads that is always the same.

Every value becomes a 64-bit whole number in the same order. A round counts, for all columns
and quantiles together, how many values share the bits known so far of a wanted value and go on
with each of the 65,536 next 16 bits; running sums tell with which bits the wanted value goes
on. After four rounds all bits are known. Counts combine before their shuffle and no value is
sorted or moved, so neither a column with a value that holds a third of all rows nor one
without two equal values is a special case. The driver reads one row per wanted value and round.

Values are compared as doubles: whole numbers beyond 2^53 are rounded. NaN is the largest
value, the two zeros are one, and NULL is left out.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perexpo.sources.tables import materialize

_STEP = 16
ROUNDS = 64 // _STEP
_NAN, _INF = 2**63 - 1, 0x7FF << 52


def order_key(value: Column) -> Column:
    """A double as a BIGINT in the same order: its sign and the bits of its size."""
    size = F.abs(value.cast("double"))
    guess = F.floor(F.log2(size)).cast("int")
    # The logarithm is rounded, so the power of two can be one too high or too low.
    power = guess + F.when(size < F.pow(F.lit(2.0), guess), -1).when(size >= F.pow(F.lit(2.0), guess + 1), 1).otherwise(0)
    whole = (size / F.pow(F.lit(2.0), power) - 1) * F.lit(2.0**52)
    normal = F.shiftleft((power + 1023).cast("bigint"), 52) + whole.cast("bigint")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    bits = (
        F.when(size == 0, F.lit(0).cast("bigint"))
        .when(size == float("inf"), F.lit(_INF))
        .when(size < F.lit(2.0**-1022), tiny)
        .otherwise(normal)
    )
    return F.when(F.isnan(value.cast("double")), F.lit(_NAN)).when(value < 0, -bits).otherwise(F.when(value.isNotNull(), bits))


def value_of(key: int) -> float:
    """The double of an order key."""
    if key == _NAN:
        return math.nan
    size = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -size if key < 0 else size


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column_name, prob, value, n) for every column and probability, interpolated between neighbours.

    Reads ``df`` ``ROUNDS`` times, whatever the numbers of columns and probabilities. A column
    without values has a NULL value.
    """
    if not all(0 <= p <= 1 for p in probs):
        raise ValueError("probabilities lie between 0 and 1")
    spark = df.sparkSession
    slots = F.array(*[F.struct(F.lit(i).alias("c"), order_key(F.col(f"`{c}`")).alias("key")) for i, c in enumerate(cols)])
    keys = df.select(F.explode(F.filter(slots, lambda s: s["key"].isNotNull())).alias("s")).select("s.*")
    totals: dict[int, int] = {}
    # Wanted values: (column, rank) to (bits known, rank among the values that share them).
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for round_ in range(ROUNDS):
        shift = 64 - _STEP * (round_ + 1)
        part = F.shiftright("key", shift)
        if round_:
            known = F.shiftright("key", shift + _STEP)
            wanted = sorted({(c, prefix) for (c, _), (prefix, _) in found.items()})
            if not wanted:
                break
            own = F.create_map(*[x for c in sorted({c for c, _ in wanted}) for x in (F.lit(c), F.array(*[F.lit(b).cast("bigint") for k, b in wanted if k == c]))])
            rows = keys.where(F.coalesce(F.array_contains(F.try_element_at(own, F.col("c")), known), F.lit(False)))
        else:
            known, rows = F.lit(0).cast("bigint"), keys
        counts = materialize(rows.groupBy("c", known.alias("known"), part.alias("part")).agg(F.count("*").alias("n")), "prefixes")
        if not round_:
            totals = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.sum("n").alias("n")).collect()}
            for c, n in totals.items():
                for p in probs:
                    for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                        found[c, rank] = (0, rank)
            if not found:
                break
        # No window holds more rows than there are steps of bits.
        upto = F.sum("n").over(Window.partitionBy("c", "known").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        targets = F.array(
            *[
                F.struct(F.lit(c).alias("c"), F.lit(rank).cast("bigint").alias("rank"), F.lit(b).cast("bigint").alias("known"), F.lit(left).cast("bigint").alias("left"))
                for (c, rank), (b, left) in found.items()
            ]
        )
        before = F.col("upto") - F.col("n")
        hits = counts.withColumn("upto", upto).withColumn(
            "hit",
            F.explode(
                F.filter(
                    targets,
                    lambda t: (t["c"] == F.col("c")) & (t["known"] == F.col("known")) & (t["left"] >= before) & (t["left"] < F.col("upto")),
                )
            ),
        )
        picked = hits.select("hit.c", "hit.rank", "part", (F.col("hit.left") - before).alias("left")).collect()
        found = {(r["c"], r["rank"]): (r["part"], r["left"]) for r in picked}
    out = []
    for c, name in enumerate(cols):
        n = totals.get(c, 0)
        for p in probs:
            value = None
            if n:
                at = p * (n - 1)
                low, high = (value_of(found[c, f(at)][0]) for f in (math.floor, math.ceil))
                value = low if low == high or at == math.floor(at) else low + (high - low) * (at - math.floor(at))
            out.append((name, float(p), value, n))
    return spark.createDataFrame(out, "column_name string, prob double, value double, n bigint")
