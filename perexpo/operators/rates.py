"""Incidents per unit of exposure by site, by part of the day, and by both.

Incidents, exposure and attributes are aggregated separately and only then joined, on the
exposure side, so nothing is counted twice and places without incidents stay with rate 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perexpo.functions.bins import EXPOSURE_BINS, INCOME_BINS, MISSING, Bins, bin_by, flag
from perexpo.functions.daytime import hour12, hour24, with_period
from perexpo.operators.matching import attach_site, cluster_keys

# Smallest exposure for a stable rate, per site and per site and period.
MIN_SITE_EXPOSURE = 500_000
MIN_SITE_PERIOD_EXPOSURE = 100_000


def rate_per(count: Column | str, exposure: Column | str, scale: float = 1e5) -> Column:
    """Incidents per ``scale`` units of exposure; NULL when there is none."""
    c = F.col(count) if isinstance(count, str) else count
    e = F.col(exposure) if isinstance(exposure, str) else exposure
    return F.try_divide(c * F.lit(scale), e.cast("double"))


def _sum(c: str) -> Column:
    return F.sum(c).cast("bigint").alias(c)


# ---- one pass over each fact table -------------------------------------------------


def exposure_rollup(exposure: DataFrame) -> DataFrame:
    """Exposure per site and part of the day: all that later steps need of the facts."""
    return (
        with_period(exposure, hour12("ts"))
        .groupBy("site_id", "site_name", "lat", "lon", "period")
        .agg(_sum("exposure"))
    )


def incident_rollup(incidents: DataFrame) -> DataFrame:
    """Incidents per cluster and part of the day."""
    timed = with_period(incidents, hour24("tm"))
    return (
        cluster_keys(timed.select("name", "lat", "lon", "period"))
        .groupBy("name", "lat_e5", "lon_e5", "period")
        .agg(F.count("*").alias("incidents"))
    )


# ---- by site -----------------------------------------------------------------------


def exposure_totals(exposure: DataFrame) -> DataFrame:
    """Exposure per site. Works on facts and on the rollup."""
    return exposure.groupBy("site_id", "site_name").agg(_sum("exposure"))


def exposure_ranking(exposure: DataFrame) -> DataFrame:
    """Exposure per site, largest first."""
    return exposure_totals(exposure).orderBy(F.desc("exposure"), "site_id")


def incident_totals(crosswalk: DataFrame) -> DataFrame:
    return (
        crosswalk.where(F.col("site_id").isNotNull()).groupBy("site_id").agg(_sum("incidents"))
    )


def pick_one(df: DataFrame, key: str, col: str, fn=F.max) -> DataFrame:
    """One representative value per key."""
    return df.groupBy(key).agg(fn(col).alias(col))


def site_metrics(crosswalk: DataFrame, exposure: DataFrame, site_attr: DataFrame) -> DataFrame:
    """Incidents, exposure, attribute and rate of every site that has exposure."""
    count = F.coalesce(F.col("incidents"), F.lit(0).cast("bigint"))
    return (
        exposure_totals(exposure).join(incident_totals(crosswalk), "site_id", "left")
        .join(pick_one(site_attr, "site_id", "attr"), "site_id", "left")
        .select(
            "site_id",
            "site_name",
            count.alias("incidents"),
            "exposure",
            "attr",
            rate_per(count, "exposure").alias("rate"),
        )
    )


def top_k(
    df: DataFrame,
    by: str,
    k: int,
    min_col: str | None = None,
    min_value: float | None = None,
    ascending: bool = False,
    tie: str | Sequence[str] = "site_id",
) -> DataFrame:
    """First ``k`` rows by a measure; the minimum applies before the cut.

    Sort and limit together: every task keeps only its own ``k`` best rows.
    """
    if min_col is not None:
        df = df.where(F.col(min_col) >= min_value)
    tie = [tie] if isinstance(tie, str) else list(tie)
    order = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(order, *tie).limit(k)


def exposure_distribution(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.min("exposure").alias("min_exposure"),
        F.avg("exposure").alias("avg_exposure"),
        F.max("exposure").alias("max_exposure"),
    )


def sites_per_bin(metrics: DataFrame, bins: Bins = EXPOSURE_BINS) -> DataFrame:
    """Number of sites per exposure range, in range order."""
    return (
        metrics.groupBy(bin_by("exposure", bins).alias("exposure_range"))
        .agg(F.count("*").alias("sites"), F.min("exposure").alias("min_exposure"))
        .orderBy("min_exposure")
    )


def volume_set(metrics: DataFrame) -> DataFrame:
    """All sites: exposure against number of incidents."""
    return metrics.select("site_id", "site_name", "exposure", "incidents")


def rate_set(metrics: DataFrame, min_exposure: int = MIN_SITE_EXPOSURE) -> DataFrame:
    """Sites with enough exposure: exposure against rate."""
    return metrics.where(F.col("exposure") >= min_exposure).select(
        "site_id", "site_name", "exposure", "rate"
    )


def attribute_set(metrics: DataFrame, min_exposure: int = MIN_SITE_EXPOSURE) -> DataFrame:
    """Sites with enough exposure and a known attribute: attribute against rate."""
    return metrics.where(F.col("attr").isNotNull() & (F.col("exposure") >= min_exposure)).select(
        "site_id", "site_name", "attr", "exposure", "rate"
    )


def rate_by_bin(attr_set: DataFrame, bins: Bins = INCOME_BINS) -> DataFrame:
    """Unweighted mean rate per attribute range, in range order."""
    return (
        attr_set.groupBy(bin_by("attr", bins).alias("attr_group"))
        .agg(F.count("*").alias("sites"), F.avg("rate").alias("avg_rate"), F.min("attr").alias("min_attr"))
        .orderBy("min_attr")
    )


# ---- by part of the day ------------------------------------------------------------


def period_metrics(incidents: DataFrame, exposure: DataFrame) -> DataFrame:
    """Rate per part of the day over all incidents, matched to a site or not.

    Takes facts with ``tm`` and ``ts`` text; only periods with incidents and exposure come
    back. Both tables go through one aggregate, which combines them to a handful of rows
    before its shuffle. A join would do the same but make the planner push its "key is
    not null" test, with the whole parsing of the hour, down to every row once more; the
    test below also looks at the sums, so it can only run after them.
    """
    nothing = F.lit(None).cast("bigint")
    one = F.lit(1).cast("bigint")
    counted = with_period(incidents, hour24("tm")).select(
        "period", one.alias("incidents"), nothing.alias("exposure"), nothing.alias("measured")
    )
    measured = with_period(exposure, hour12("ts")).select(
        "period", nothing.alias("incidents"), "exposure", one.alias("measured")
    )
    sums = counted.unionByName(measured).groupBy("period").agg(
        _sum("incidents"), _sum("exposure"), _sum("measured")
    )
    both = (F.col("incidents") > 0) & (F.col("measured") > 0)
    return sums.where(F.when(both, F.col("period")).isNotNull()).select(
        "period", "incidents", "exposure", rate_per("incidents", "exposure").alias("rate")
    )


def period_metrics_from_rollups(incidents: DataFrame, exposure: DataFrame) -> DataFrame:
    """The same from the rollups, without touching the facts again."""
    counts = incidents.groupBy("period").agg(_sum("incidents"))
    totals = exposure.groupBy("period").agg(_sum("exposure"))
    return counts.join(totals, "period").select(
        "period", "incidents", "exposure", rate_per("incidents", "exposure").alias("rate")
    )


def site_period_metrics(
    incidents: DataFrame, crosswalk: DataFrame, exposure: DataFrame, site_attr: DataFrame
) -> DataFrame:
    """Rate per site and part of the day, over incidents matched to a site.

    ``incidents`` and ``exposure`` are the rollups. Incidents are grouped by site id
    alone, so two spellings of a site name cannot double its rows.
    """
    counts = attach_site(incidents, crosswalk, ["period"]).groupBy("site_id", "period").agg(_sum("incidents"))
    totals = exposure.groupBy("site_id", "site_name", "period").agg(_sum("exposure"))
    count = F.coalesce(F.col("incidents"), F.lit(0).cast("bigint"))
    return (
        totals.join(counts, ["site_id", "period"], "left")
        .join(pick_one(site_attr, "site_id", "attr"), "site_id", "left")
        .select(
            "site_id",
            "site_name",
            "period",
            count.alias("incidents"),
            "exposure",
            "attr",
            rate_per(count, "exposure").alias("rate"),
        )
    )


# ---- tables to serve ---------------------------------------------------------------


def publish_sites(metrics: DataFrame, bins: Bins = INCOME_BINS) -> DataFrame:
    """Site table with the attribute range; sites without attribute get their own group."""
    return metrics.withColumn("attr_group", bin_by("attr", bins, MISSING))


def publish_site_periods(site_periods: DataFrame, min_exposure: int = MIN_SITE_PERIOD_EXPOSURE) -> DataFrame:
    """Site and period table with the mark that says whether the rate is stable enough."""
    return site_periods.withColumn(
        "threshold", flag(F.col("exposure") >= min_exposure, "Include", "Low Ridership")
    )


# ---- comparisons -------------------------------------------------------------------


def rate_ratio(periods: DataFrame, base: str, key: str = "period") -> DataFrame:
    """Each rate as a multiple of the rate of one group."""
    reference = periods.where(F.col(key) == base).agg(F.max("rate").alias("rate"))
    return periods.select(
        "*", F.try_divide(F.col("rate"), reference.scalar()).alias(f"times_{base.lower().replace(' ', '_')}")
    )


def quadrant(metrics: DataFrame, volume_cut: float | None = None, rate_cut: float | None = None) -> DataFrame:
    """Priority class by number of incidents and by rate, high meaning at or above the cut.

    A cut that is not given is the exact median, whatever the number of rows.
    """
    if volume_cut is None:
        volume_cut = exact_quantile(metrics, "incidents")
    if rate_cut is None:
        rate_cut = exact_quantile(metrics, "rate")
    side = F.concat(
        flag(F.col("incidents") >= F.lit(volume_cut), "High volume", "Low volume"),
        F.lit(" / "),
        flag(F.col("rate") >= F.lit(rate_cut), "high rate", "low rate"),
    )
    return metrics.withColumn("quadrant", side)


def exact_quantile(df: DataFrame, col: str, q: float = 0.5, most: int = 10_000):
    """The smallest value with at least ``q`` of the known values at or below it; None without values.

    Each round takes two sketched quantiles around the wanted rank, counts exactly what lies
    below the lower one, and goes on between them, until at most ``most`` different values are
    left, which the driver reads with their counts. No task holds or sorts all values. ``df``
    is read once a round; give it written if it is expensive.
    """
    value = F.col(col)
    inside = df.where(value.isNotNull() & ~F.isnan(value.cast("double"))).select(value.alias("v"))
    n, low, high = inside.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank, width = max(math.ceil(n * q), 1), 1 / math.sqrt(most)
    while True:
        inside = inside.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        counted = inside.groupBy("v").agg(F.count("*").alias("n")).limit(most + 1).collect()
        if len(counted) <= most:
            for row in sorted(counted):
                rank -= row.n
                if rank <= 0:
                    return row.v
        at = rank / n
        around = F.percentile_approx("v", [max(at - width, 0.0), min(at + width, 1.0)], most)
        low, high = inside.agg(around).first()[0]
        below, upto = inside.agg(F.count_if(F.col("v") < F.lit(low)), F.count_if(F.col("v") <= F.lit(high))).first()
        if below >= rank or upto < rank:
            raise ArithmeticError("the sketch is less accurate than it promises")
        rank, n = rank - below, upto - below


def recurring(views: Sequence[DataFrame], min_views: int, key: str = "site_id") -> DataFrame:
    """Keys that appear in at least ``min_views`` of the given result lists."""
    every = views[0].select(key).distinct()
    for view in views[1:]:
        every = every.unionByName(view.select(key).distinct())
    return every.groupBy(key).agg(F.count("*").alias("views")).where(F.col("views") >= min_views)
