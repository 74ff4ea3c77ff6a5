"""Profile of a whole table in one aggregate, and profiles of batches that can be united later.

A profile has one row per column: rows, missing values, smallest and largest value, what text
columns really hold, and a sketch of the distinct values. All of it merges: counts add up,
bounds take the smaller or larger one, and sketches unite, so a new batch is profiled alone and a
table is never read again for what earlier batches held. Exact distinct counts do not merge
and are made on request only.

Bounds are kept by kind: whole numbers as they are, other numbers as doubles, and texts, dates and
times as text, whose order is theirs (years of four digits). NaN is the largest number. Columns of
arrays, maps and structs have rows and missing values only.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    FractionalType,
    IntegralType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from perexpo.functions.cleaning import stored_type

#: Binary logarithm of the number of cells of a sketch: 4,096 cells err by 1.6 % on average.
SKETCH_BITS = 12
WHOLE, NUMBER, TEXT, OTHER = "whole", "number", "text", "other"
_TYPES = ("integer", "real", "text")


def _kind(kind: DataType) -> str:
    if isinstance(kind, (IntegralType, BooleanType)):
        return WHOLE
    if isinstance(kind, FractionalType):
        return NUMBER
    if isinstance(kind, (StringType, DateType, TimestampType, TimestampNTZType)):
        return TEXT
    return OTHER


def _value(name: str, kind: DataType) -> Column:
    """What is measured of a column: its values in the type of their bounds."""
    c, shape = F.col(f"`{name}`"), _kind(kind)
    if shape == WHOLE:
        return c.cast("int").cast("bigint") if isinstance(kind, BooleanType) else c.cast("bigint")
    if shape == NUMBER:
        return c.cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string") if shape == TEXT else c


def _measures(name: str, kind: DataType, at: int, bits: int) -> Column:
    """All numbers of one column as one struct of aggregates, from its value and stored type ``at`` its place."""
    shape, value, stored = _kind(kind), F.col(f"v{at}"), F.col(f"t{at}")

    def bound(pick, own: str, as_type: str) -> Column:
        return pick(value) if shape == own else F.lit(None).cast(as_type)

    sketched = shape != OTHER
    return F.struct(
        F.lit(name).alias("column_name"),
        F.lit(kind.simpleString()).alias("column_type"),
        F.count("*").alias("row_count"),
        F.count_if(F.col(f"n{at}")).alias("nulls"),
        *[
            bound(pick, own, as_type).alias(f"{end}_{own}")
            for own, as_type in ((WHOLE, "bigint"), (NUMBER, "double"), (TEXT, "string"))
            for end, pick in (("min", F.min), ("max", F.max))
        ],
        *[
            (F.count_if(stored == t) if isinstance(kind, StringType) else F.lit(None).cast("bigint")).alias(f"{t}_values")
            for t in _TYPES
        ],
        (F.hll_sketch_agg(value if shape != NUMBER else value.cast("string"), bits) if sketched else F.lit(None).cast("binary")).alias("sketch"),
    )


def _counted_out(df: DataFrame, exact: Sequence[str], batch: Sequence[str]) -> DataFrame:
    """(batch, column_name, exact_distinct) of some columns, each by an aggregate of its own.

    Together they would make a row for every value of every column of a row, and sort them.
    """
    found = []
    for name in exact:
        values = df.select(*batch, F.col(f"`{name}`").alias("_v")).groupBy(*batch, "_v").agg(F.lit(1).alias("_one"))
        counted = F.count("_v").alias("_distinct")
        one = values.groupBy(*batch).agg(counted) if batch else values.agg(counted)
        found.append(one.select(*batch, F.lit(name).alias("_name"), "_distinct"))
    return functools.reduce(DataFrame.unionByName, found)


def profile_table(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    exact: Sequence[str] = (),
    batch: Sequence[str] = (),
    bits: int = SKETCH_BITS,
) -> DataFrame:
    """One row per column, from one aggregate over ``df``; with ``batch`` one per batch and column.

    ``exact`` names columns whose distinct values are counted out too, each by a read of that column and
    a shuffle of its different values. An empty table has rows of zeros, or none with ``batch``.
    """
    cols = [c for c in df.columns if c not in batch] if cols is None else cols
    unknown = set(exact) - set(cols)
    if unknown:
        raise ValueError(f"not among the columns: {sorted(unknown)}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    # Worked out once a row, although several aggregates take them.
    values = [
        c
        for i, name in enumerate(cols)
        for c in (
            _value(name, kinds[name]).alias(f"v{i}"),
            F.col(f"`{name}`").isNull().alias(f"n{i}"),
            *([stored_type(name).alias(f"t{i}")] if isinstance(kinds[name], StringType) else []),
        )
    ]
    keys = [f"_batch_{i}" for i in range(len(batch))]
    ready = df.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(batch, keys, strict=True)], *values)
    one = [_measures(name, kinds[name], i, bits).alias(f"p{i}") for i, name in enumerate(cols)]
    wide = ready.groupBy(*keys).agg(*one) if batch else ready.agg(*one)
    rows = F.explode(F.array(*[f"p{i}" for i in range(len(cols))])).alias("p")
    found = wide.select(*[F.col(k).alias(b) for b, k in zip(batch, keys, strict=True)], rows).select(*batch, "p.*")
    if not exact:
        return found.withColumn("exact_distinct", F.lit(None).cast("bigint"))
    counted = _counted_out(df, list(dict.fromkeys(exact)), batch).withColumnsRenamed({b: k for b, k in zip(batch, keys, strict=True)})
    same = [F.col("column_name") == F.col("_name"), *[F.col(f"`{b}`").eqNullSafe(F.col(k)) for b, k in zip(batch, keys, strict=True)]]
    joined = found.join(counted, functools.reduce(Column.__and__, same), "left")
    return joined.select(*found.columns, F.col("_distinct").alias("exact_distinct"))


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of batches as one; exact distinct counts are lost, because they do not add up."""
    bounds = [c for c in profiles.columns if c.startswith(("min_", "max_"))]
    sums = ["row_count", "nulls", *[f"{t}_values" for t in _TYPES]]
    return profiles.groupBy("column_name", "column_type").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in sums],
        *[(F.min if c.startswith("min_") else F.max)(c).alias(c) for c in bounds],
        F.when(F.count("sketch") > 0, F.hll_union_agg("sketch", True)).alias("sketch"),
        F.lit(None).cast("bigint").alias("exact_distinct"),
    )


def report(profiles: DataFrame) -> DataFrame:
    """A profile for readers: bounds as text, and the estimate instead of the sketch."""

    def shown(end: str) -> Column:
        return F.coalesce(*[F.col(f"{end}_{own}").cast("string") for own in (WHOLE, NUMBER, TEXT)])

    return profiles.select(
        *[c for c in profiles.columns if not c.startswith(("min_", "max_")) and c not in ("sketch", "exact_distinct")],
        shown("min").alias("min_value"),
        shown("max").alias("max_value"),
        F.hll_sketch_estimate("sketch").alias("distinct_estimate"),
        "exact_distinct",
    )
