"""Rollups that grow batch by batch, and serving tables of which only what changed is rewritten.

A batch of facts (a day, say) is aggregated once and its rollup stored under the batch's
id. Sums of rollups are rollups of the sums, so everything that is served comes from the stored
batches; facts of earlier batches are not read again. A batch that is replayed replaces
its own rollup. Served rows lie in buckets by site; after a batch only the buckets of sites that
occur in it are written anew, and within these every row comes from the state, so the table
equals one made from all facts at once.

The caller gives the crosswalk from clusters to sites, made from ``clusters`` of the state. If a new
crosswalk moves old clusters to other sites, those sites have to be named as touched too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perexpo.operators import rates
from perexpo.operators.matching import attach_site
from perexpo.sources import tables

INCIDENT_STATE = "name STRING, lat_e5 BIGINT, lon_e5 BIGINT, period STRING, incidents BIGINT"
EXPOSURE_STATE = "site_id BIGINT, site_name STRING, lat DOUBLE, lon DOUBLE, period STRING, exposure BIGINT"
SERVED = (
    "site_id BIGINT, site_name STRING, period STRING, incidents BIGINT, exposure BIGINT, attr DOUBLE, rate DOUBLE, bucket INT"
)
#: Parts of a served table. A bucket is the least that is written anew.
BUCKETS = 64


def add_batch(incidents: DataFrame, exposure: DataFrame, path: str, batch_id: str) -> None:
    """Store the rollups of one batch of facts, in place of what the batch held before."""
    tables.append_batch(rates.incident_rollup(incidents), f"{path}/incidents", batch_id)
    tables.append_batch(rates.exposure_rollup(exposure), f"{path}/exposure", batch_id)


def _batches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        tables.read_batches(spark, f"{path}/incidents", INCIDENT_STATE),
        tables.read_batches(spark, f"{path}/exposure", EXPOSURE_STATE),
    )


def state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rollups of all batches together: (incidents, exposure), in the form of one rollup."""
    incidents, exposure = _batches(spark, path)

    def united(df: DataFrame, measure: str) -> DataFrame:
        keys = [c for c in df.columns if c not in ("batch_id", measure)]
        return df.groupBy(*keys).agg(F.sum(measure).cast("bigint").alias(measure))

    return united(incidents, "incidents"), united(exposure, "exposure")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("site_id"), F.lit(BUCKETS)).cast("int")


def touched_sites(spark: SparkSession, path: str, batch_id: str, crosswalk: DataFrame) -> DataFrame:
    """Sites with exposure or matched incidents in a batch."""
    incidents, exposure = _batches(spark, path)
    matched = attach_site(incidents.where(F.col("batch_id") == batch_id), crosswalk, ["period"]).select("site_id")
    return exposure.where(F.col("batch_id") == batch_id).select("site_id").unionByName(matched).distinct()


def replace_batch(
    incidents: DataFrame, exposure: DataFrame, path: str, batch_id: str, crosswalk: DataFrame
) -> DataFrame:
    """Store a batch that may have been there before, and return the sites of its old and new facts."""
    spark = incidents.sparkSession
    before = tables.materialize(touched_sites(spark, path, batch_id, crosswalk), "touched")
    add_batch(incidents, exposure, path, batch_id)
    return before.unionByName(touched_sites(spark, path, batch_id, crosswalk)).distinct()


def publish_site_periods(
    spark: SparkSession,
    path: str,
    served: str,
    crosswalk: DataFrame,
    site_attr: DataFrame,
    touched: DataFrame | None = None,
) -> DataFrame:
    """Rates by site and part of the day, written to ``served``; with ``touched`` only their buckets.

    Returns the served table.
    """
    incidents, exposure = state(spark, path)
    wanted: list[int] = []
    if touched is not None:
        # At most as many numbers as there are buckets.
        buckets = touched.where(F.col("site_id").isNotNull()).select(_bucket().alias("bucket")).distinct()
        wanted = [r["bucket"] for r in buckets.collect()]
        within = _bucket().isin(wanted)
        exposure, crosswalk = exposure.where(within), crosswalk.where(within)
    rows = rates.site_period_metrics(incidents, crosswalk, exposure, site_attr).withColumn("bucket", _bucket())
    if touched is None:
        tables.save_partitioned(rows, served, ["bucket"])
    elif wanted:
        rows = tables.materialize(rows, "changed")
        tables.replace_partitions(rows, served, ["bucket"])
        kept = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        for bucket in set(wanted) - kept:
            tables.drop_partition(spark, served, f"bucket={bucket}")
    return tables.read_partitioned(spark, served, SERVED).drop("bucket")


def publish_periods(spark: SparkSession, path: str) -> DataFrame:
    """Rates by part of the day, from the state: a handful of rows."""
    return rates.period_metrics_from_rollups(*state(spark, path))
