"""Hour of day from text, and the part of the day an hour belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perexpo.functions.cleaning import as_col, prefix_int

TEXT_TIMESTAMP = "MM/dd/yyyy hh:mm:ss a"

# Fixed values: (label, first hour, last hour); the last one wraps midnight.
DAY_PERIODS = (
    ("Morning", 6, 11),
    ("Afternoon", 12, 16),
    ("Evening", 17, 21),
    ("Late Night", 22, 5),
)


def hour24(c: Column | str, strict: bool = False) -> Column:
    """Hour of ``HH:mm:ss`` text. Garbage is hour 0 unless strict, then NULL."""
    return prefix_int(F.substring(as_col(c), 1, 2), strict).cast("int")


def hour12(c: Column | str) -> Column:
    """Hour 0-23 of ``MM/dd/yyyy hh:mm:ss AM`` text, NULL for any other shape.

    Two fixed-offset substrings instead of a timestamp parse: this runs once per row of
    the largest table.
    """
    c = as_col(c)
    clock = prefix_int(F.substring(c, 12, 2), strict=True)
    half = F.substring(c, 21, 2)
    start = F.when(half == "AM", 0).when(half == "PM", 12)
    return F.when(clock.between(1, 12), clock % 12 + start).cast("int")


def parse_timestamp(c: Column | str, fmt: str = TEXT_TIMESTAMP) -> Column:
    return F.try_to_timestamp(as_col(c), F.lit(fmt))


def period(hour: Column | str, spec: Sequence[tuple[str, int, int]] = DAY_PERIODS) -> Column:
    """Label of the part of the day; NULL when no part holds the hour."""
    hour = as_col(hour)
    out = None
    for name, first, last in spec:
        if first <= last:
            cond = hour.between(first, last)
        else:
            cond = (hour >= first) | hour.between(0, last)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def with_period(df: DataFrame, hour: Column, spec: Sequence[tuple[str, int, int]] = DAY_PERIODS) -> DataFrame:
    """Add ``period``. The hour gets a projection of its own, so that it is computed once
    per row and not once per comparison."""
    return df.withColumn("_hour", hour).withColumn("period", period("_hour", spec)).drop("_hour")
