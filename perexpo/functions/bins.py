"""Binning of measures into ordered, labelled ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from perexpo.functions.cleaning import as_col


@dataclass(frozen=True)
class Bins:
    """``closed='right'`` puts a value equal to an edge in the lower bin."""

    edges: Sequence[float]
    labels: Sequence[str]
    closed: str

    def __post_init__(self) -> None:
        if len(self.labels) != len(self.edges) + 1:
            raise ValueError("one label more than edges is needed")
        if self.closed not in ("left", "right"):
            raise ValueError("closed is 'left' or 'right'")


# Edges and labels of the standard reports.
DISTANCE_BINS = Bins(
    (0.05, 0.10, 0.25, 0.50),
    ("0-0.05 miles", "0.05-0.10 miles", "0.10-0.25 miles", "0.25-0.50 miles", "Over 0.50 miles"),
    "right",
)
DISTANCE_BINS_SHORT = Bins(
    DISTANCE_BINS.edges,
    ("0-0.05", "0.05-0.10", "0.10-0.25", "0.25-0.50", "Over 0.50"),
    "right",
)
EXPOSURE_BINS = Bins(
    (100_000, 500_000, 1_000_000, 5_000_000),
    ("Under 100k", "100k-500k", "500k-1M", "1M-5M", "5M+"),
    "left",
)
INCOME_BINS = Bins(
    (50_000, 75_000, 100_000, 150_000),
    ("Under $50k", "$50k-$75k", "$75k-$100k", "$100k-$150k", "$150k+"),
    "left",
)
MISSING = "Missing"


def _choose(value: Column, bins: Bins, results: Sequence[Column]) -> Column:
    out = F.when(value.isNull(), None)
    for edge, result in zip(bins.edges, results):
        out = out.when(value <= edge if bins.closed == "right" else value < edge, result)
    return out.otherwise(results[-1])


def bin_by(c: Column | str, bins: Bins, null_label: str | None = None) -> Column:
    """Label of the bin; NULL input gives ``null_label``."""
    labels = _choose(as_col(c), bins, [F.lit(x) for x in bins.labels])
    return labels if null_label is None else F.coalesce(labels, F.lit(null_label))


def bin_ordinal(c: Column | str, bins: Bins) -> Column:
    """Position of the bin, for ordering a report by range instead of by label."""
    return _choose(as_col(c), bins, [F.lit(i) for i in range(len(bins.labels))])


def flag(cond: Column, yes: str, no: str) -> Column:
    """Two-way label; an unknown condition counts as ``no``."""
    return F.when(cond, yes).otherwise(no)
