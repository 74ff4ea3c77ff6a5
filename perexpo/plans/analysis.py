"""The whole analysis as one plan: facts in, tables to serve out.

Each fact table is read once, into a rollup that holds everything later steps need. The
rollups, the candidates and the crosswalk are written, because several steps read them;
the rest stays lazy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perexpo.operators import matching, rates, zones
from perexpo.sources.tables import materialize, save, write_csv


@dataclass(frozen=True)
class Analysis:
    clusters: DataFrame
    candidates: DataFrame
    reviews: DataFrame
    crosswalk: DataFrame
    site_attr: DataFrame
    sites: DataFrame
    site_periods: DataFrame
    periods: DataFrame


def site_attributes(sites: DataFrame, zone_table: DataFrame, raw_attributes: DataFrame) -> DataFrame:
    """Zone and attribute of every site."""
    return zones.site_attributes(
        zones.pip_join(sites, zone_table), zones.clean_attributes(raw_attributes)
    )


def analyse(
    incidents: DataFrame,
    exposure: DataFrame,
    site_attr: DataFrame,
    decide,
    review_min: int = matching.REVIEW_MIN_COUNT,
    min_site_period: int = rates.MIN_SITE_PERIOD_EXPOSURE,
) -> Analysis:
    """Run all stages. ``decide(candidates)`` gives (decisions, accepted low-volume rows)."""
    incident_roll = materialize(rates.incident_rollup(incidents), "incident-rollup")
    exposure_roll = materialize(rates.exposure_rollup(exposure), "exposure-rollup")
    site_attr = materialize(site_attr, "site-attributes")

    clusters = matching.clusters_of(incident_roll)
    sites = matching.site_dim(exposure_roll)
    cand = materialize(matching.candidates(clusters, sites), "candidates")
    decisions, low_batch = decide(cand)
    reviews = matching.append_decisions(
        matching.apply_decisions(matching.review_queue(cand, review_min), decisions), low_batch
    )
    crosswalk = materialize(
        matching.build_crosswalk(cand, reviews, matching.site_lookup(sites), review_min), "crosswalk"
    )
    site_table = rates.publish_sites(rates.site_metrics(crosswalk, exposure_roll, site_attr))
    site_periods = rates.publish_site_periods(
        rates.site_period_metrics(incident_roll, crosswalk, exposure_roll, site_attr), min_site_period
    )
    periods = rates.period_metrics_from_rollups(incident_roll, exposure_roll)
    return Analysis(clusters, cand, reviews, crosswalk, site_attr, site_table, site_periods, periods)


#: The tables to serve, by name.
SERVED = ("sites", "site_periods", "periods", "volume_set", "rate_set", "attribute_set")


def publish(
    result: Analysis, path: str, min_exposure: int = rates.MIN_SITE_EXPOSURE, csv: bool = True
) -> dict[str, DataFrame]:
    """Write the tables to serve and the analysis sets, as Parquet and CSV below ``path``.

    Returns each as read back. The site table is written first, and the sets that depend on
    it start from its files.
    """
    sites = save(result.sites, f"{path}/sites")
    frames = {
        "site_periods": result.site_periods,
        "periods": result.periods,
        "volume_set": rates.volume_set(sites),
        "rate_set": rates.rate_set(sites, min_exposure),
        "attribute_set": rates.attribute_set(sites, min_exposure),
    }
    served = {"sites": sites} | {name: save(df, f"{path}/{name}") for name, df in frames.items()}
    if csv:
        for name, df in served.items():
            write_csv(df, f"{path}/csv/{name}")
    return served


def contents(served: dict[str, DataFrame]) -> DataFrame:
    """Rows, exposure and mean rate of every published table."""
    parts = [
        df.agg(
            F.count("*").alias("row_count"),
            F.sum("exposure").cast("bigint").alias("exposure"),
            (F.round(F.avg("rate"), 6) if "rate" in df.columns else F.lit(None).cast("double")).alias("avg_rate"),
        ).select(F.lit(name).alias("table_name"), "*")
        for name, df in served.items()
    ]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return everything
