"""The six result views of the dashboard, over the tables to serve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perexpo.functions.bins import MISSING
from perexpo.functions.cleaning import label
from perexpo.operators.rates import MIN_SITE_EXPOSURE, top_k
from perexpo.operators.statistics import ols


def _known_and_stable(sites: DataFrame, min_exposure: int) -> DataFrame:
    return sites.where((F.col("attr_group") != MISSING) & (F.col("exposure") >= min_exposure))


def view_rate_by_bin(sites: DataFrame, min_exposure: int = MIN_SITE_EXPOSURE) -> DataFrame:
    """Mean rate per attribute range, highest first."""
    return (
        _known_and_stable(sites, min_exposure)
        .groupBy("attr_group")
        .agg(F.avg("rate").alias("avg_rate"))
        .orderBy(F.desc("avg_rate"), "attr_group")
    )


def view_period_rate(periods: DataFrame) -> DataFrame:
    """Rate per part of the day, highest first."""
    return periods.groupBy("period").agg(F.sum("rate").alias("rate")).orderBy(F.desc("rate"), "period")


def view_top_site_periods(site_periods: DataFrame, k: int = 15) -> DataFrame:
    """Highest rates by site and part of the day, among those stable enough to show."""
    shown = site_periods.where(F.col("threshold") == "Include")
    by_label = shown.groupBy(label("site_name", "period").alias("label"), "period").agg(
        F.avg("rate").alias("avg_rate"), F.max("rate").alias("max_rate")
    )
    return top_k(by_label, "max_rate", k, tie="label")


def view_rate_vs_attr(sites: DataFrame, min_exposure: int = MIN_SITE_EXPOSURE) -> DataFrame:
    """Scatter of attribute and rate, one point per site."""
    return _known_and_stable(sites, min_exposure).select("site_id", "site_name", "attr", "rate")


def view_rate_vs_attr_trend(sites: DataFrame, min_exposure: int = MIN_SITE_EXPOSURE) -> DataFrame:
    return ols(_known_and_stable(sites, min_exposure), "attr", "rate")


def view_volume_vs_exposure(sites: DataFrame) -> DataFrame:
    """Scatter of exposure and number of incidents, one point per site."""
    return sites.select("site_id", "site_name", "exposure", "incidents")


def view_volume_vs_exposure_trend(sites: DataFrame) -> DataFrame:
    return ols(sites, "exposure", "incidents")


def view_top_sites(sites: DataFrame, k: int = 10, min_exposure: int = MIN_SITE_EXPOSURE) -> DataFrame:
    """Highest rates among sites with enough exposure."""
    by_site = (
        sites.where(F.col("exposure") >= min_exposure)
        .groupBy("site_name")
        .agg(F.sum("rate").alias("rate"))
    )
    return top_k(by_site, "rate", k, tie="site_name")
