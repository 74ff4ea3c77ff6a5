"""Registered queries: every operator over the driver tables.

Thresholds are parameters of the operators; where the driver tables are smaller than the
data the defaults were made for, the values below are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perexpo.functions import bins, cleaning, daytime, geometry, names
from perexpo.operators import incremental, matching, profiling, quantiles, rates, statistics, table_profile, views, zones
from perexpo.operators.nearest import best_per_key, nearest
from perexpo.plans import analysis, inputs
from perexpo.sources import polygons, tables

Query = Callable[[SparkSession, str], DataFrame]

REVIEW_MIN = 4
CORRECT_MIN = 5
MIN_SITE = 100_000
MIN_SITE_PERIOD = 30_000
EXPECTED_HOURS = 30
SITE_BINS = bins.Bins(
    (50_000, 100_000, 150_000, 200_000),
    ("Under 50k", "50k-100k", "100k-150k", "150k-200k", "200k+"),
    "left",
)
LOW_VOLUME_REASON = "Clear name match within 0.05 miles"

QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on the order of addition; compare them to six places."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- shared stages -----------------------------------------------------------------


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    clusters = matching.coord_clusters(inputs.incidents(spark, d))
    sites = matching.site_dim(inputs.exposure_raw(spark, d))
    return matching.candidates(clusters, sites)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for queries that read them several times: written once."""
    return tables.materialize(_nearest(spark, d), "candidates")


def decisions(cand: DataFrame) -> DataFrame:
    """Two review rounds over all named clusters; the second corrects the first.

    Round one accepts near candidates and flags the others. Round two assigns frequent
    far clusters to the site whose number is in the recorded name.
    """
    number = F.regexp_extract("name", r"(\d+)", 1).try_cast("bigint")
    near = F.col("distance_miles") <= 0.25
    named = cand.where(F.col("name").isNotNull())

    def round_of(df: DataFrame, seq: int, status: Column, site_id: Column, site: Column, reason: Column) -> DataFrame:
        return df.select(
            F.lit(seq).cast("bigint").alias("seq"),
            *matching.CLUSTER_KEY,
            status.alias("status"),
            site_id.cast("bigint").alias("override_site_id"),
            site.cast("string").alias("override_site_name"),
            reason.alias("reason"),
        )

    nothing = F.lit(None)
    first = round_of(
        named,
        1,
        F.when(near, "ACCEPT").otherwise("INVESTIGATE"),
        nothing,
        nothing,
        F.when(near, "Same place, other spelling").otherwise("Name conflicts with candidate"),
    )
    second = round_of(
        named.where(~near & (F.col("incidents") >= CORRECT_MIN)),
        2,
        F.lit("ACCEPT"),
        number,
        inputs.site_name(number),
        F.lit("Corrected using recorded name"),
    )
    return first.unionByName(second)


def low_batch(cand: DataFrame) -> DataFrame:
    rare = matching.low_volume(cand, REVIEW_MIN).where(F.col("distance_miles") <= 0.05)
    return matching.accept(rare, LOW_VOLUME_REASON)


def _queue(cand: DataFrame) -> DataFrame:
    return matching.review_queue(cand, REVIEW_MIN)


def _reviews(cand: DataFrame) -> DataFrame:
    applied = matching.apply_decisions(_queue(cand), decisions(cand))
    return matching.append_decisions(applied, low_batch(cand))


@dataclass(frozen=True)
class _Stages:
    """What queries on sites and periods start from: each fact table was read once for it."""

    incidents: DataFrame
    exposure: DataFrame
    cand: DataFrame
    crosswalk: DataFrame


def _stages(spark: SparkSession, d: str) -> _Stages:
    incidents, exposure = _rollups(spark, d)
    sites = matching.site_dim(exposure)
    cand = tables.materialize(matching.candidates(matching.clusters_of(incidents), sites), "candidates")
    crosswalk = matching.build_crosswalk(cand, _reviews(cand), matching.site_lookup(sites), REVIEW_MIN)
    return _Stages(incidents, exposure, cand, crosswalk)


def _crosswalk(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d).crosswalk


def _site_attr(spark: SparkSession, d: str) -> DataFrame:
    return analysis.site_attributes(
        inputs.sites(spark, d), inputs.zones(spark, d), inputs.zone_attributes_raw(spark, d)
    )


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    crosswalk = tables.materialize(_crosswalk(spark, d), "crosswalk")
    return zones.enrich(crosswalk, _site_attr(spark, d))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    stages = _stages(spark, d)
    return rates.site_metrics(stages.crosswalk, stages.exposure, _site_attr(spark, d))


def _written_metrics(spark: SparkSession, d: str) -> DataFrame:
    """One row per site, for queries that read it several times: written once."""
    return tables.materialize(_metrics(spark, d), "site-metrics")


def _rollups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both fact tables reduced to site, cluster and period; written, so that what later
    joins demand of the period is not checked by parsing the text of every fact again."""
    return (
        tables.materialize(rates.incident_rollup(inputs.incidents(spark, d)), "incident-rollup"),
        tables.materialize(rates.exposure_rollup(inputs.exposure(spark, d)), "exposure-rollup"),
    )


def _site_periods(spark: SparkSession, d: str) -> DataFrame:
    stages = _stages(spark, d)
    return rates.site_period_metrics(stages.incidents, stages.crosswalk, stages.exposure, _site_attr(spark, d))


def _periods(spark: SparkSession, d: str) -> DataFrame:
    return rates.period_metrics(inputs.incidents(spark, d), inputs.exposure(spark, d))


def _rates(spark: SparkSession, d: str) -> DataFrame:
    return rates.rate_set(_metrics(spark, d), MIN_SITE)


def _attrs(spark: SparkSession, d: str) -> DataFrame:
    return rates.attribute_set(_metrics(spark, d), MIN_SITE)


def _published(spark: SparkSession, d: str) -> DataFrame:
    return rates.publish_sites(_metrics(spark, d))


# ---- sources and sinks -------------------------------------------------------------


@register
def csv_roundtrip(spark, d):
    path = tables.scratch_path(spark, "sites-csv")
    tables.write_csv(inputs.sites(spark, d), path)
    return tables.read_csv(spark, path, tables.SITE_SCHEMA)


@register
def raw_source(spark, d):
    raw = tables.read_raw(spark, f"{d}/lineitem.parquet")
    return raw.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@register
def zone_edges(spark, d):
    return zones.zone_edges(inputs.zones(spark, d))


@register
def save_table(spark, d):
    path = tables.scratch_path(spark, "saved")
    first = tables.save(inputs.exposure(spark, d), path)
    return rounded(
        tables.save(rates.exposure_totals(first), path + "-totals").agg(
            F.count("*").alias("sites"), F.sum("exposure").cast("bigint").alias("exposure")
        )
    )


@register
def session_view(spark, d):
    tables.publish_view(inputs.sites(spark, d), "perexpo_sites")
    return spark.sql("SELECT site_id % 5 AS part, count(*) AS sites FROM perexpo_sites GROUP BY site_id % 5")


@register
def append_batches(spark, d):
    path = tables.scratch_path(spark, "batches")
    cand = _candidates(spark, d)
    review = tables.save(matching.apply_decisions(_queue(cand), decisions(cand)), path)
    tables.append(low_batch(cand), path)
    both = spark.read.schema(review.schema).parquet(path)
    return both.groupBy("reason").agg(
        F.count("*").alias("clusters"), F.sum("incidents").cast("bigint").alias("incidents")
    )


@register
def replayed_batches(spark, d):
    """Batches of lines under an id each; one is sent again, one again with fewer rows."""
    path = tables.scratch_path(spark, "line-batches")
    lines = inputs.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    for number in (1, 2, 3, 2):
        tables.append_batch(lines.where(F.col("l_linenumber") == number), path, f"line-{number}")
    tables.append_batch(lines.where((F.col("l_linenumber") == 3) & (F.col("l_quantity") > 25)), path, "line-3")
    both = tables.read_batches(spark, path, lines.schema)
    return both.groupBy("batch_id").agg(F.count("*").alias("row_count"), F.sum("l_quantity").alias("quantity"))


@register
def replaced_partitions(spark, d):
    """A table by status, of which one partition is replaced and one is read."""
    path = tables.scratch_path(spark, "by-status")
    lines = inputs.table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    tables.save_partitioned(lines, path, ["l_returnflag"])
    doubled = lines.where(F.col("l_returnflag") == "A").withColumn("l_quantity", F.col("l_quantity") * 2)
    for _ in range(2):
        tables.replace_partitions(doubled, path, ["l_returnflag"])
    found = tables.read_partitioned(spark, path, lines.schema).where(F.col("l_returnflag").isin("A", "N"))
    return found.groupBy("l_returnflag").agg(F.count("*").alias("row_count"), F.sum("l_quantity").alias("quantity"))


def _days(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame]]:
    """The facts in three batches by day of the month."""
    facts = inputs.incidents(spark, d), inputs.exposure_raw(spark, d).withColumn("exposure", cleaning.clean_int("exposure"))
    day = [F.substring(c, 4, 2).cast("int") % 3 for c in ("dt", "ts")]
    return [tuple(f.where(k == i) for f, k in zip(facts, day, strict=True)) for i in range(3)]


def _grown_state(spark: SparkSession, d: str) -> tuple[str, DataFrame, DataFrame]:
    """State folder, crosswalk and served table after three batches, the last of which changed after it was published."""
    path = tables.scratch_path(spark, "state")
    crosswalk, attrs = tables.materialize(_crosswalk(spark, d), "crosswalk"), tables.materialize(_site_attr(spark, d), "site-attributes")
    first, second, third = _days(spark, d)
    incremental.add_batch(*first, path, "day-0")
    incremental.publish_site_periods(spark, path, f"{path}/served", crosswalk, attrs)
    half = [f.where(F.col(c).substr(5, 1) < "5") for f, c in zip(third, ("dt", "ts"), strict=True)]
    for batch, name in ((second, "day-1"), (half, "day-2"), (third, "day-2"), (third, "day-2")):
        touched = incremental.replace_batch(*batch, path, name, crosswalk)
        served = incremental.publish_site_periods(spark, path, f"{path}/served", crosswalk, attrs, touched)
    return path, crosswalk, served


@register
def incremental_site_periods(spark, d):
    """Rates by site and period from stored rollups of batches, equal to those of all facts."""
    return _grown_state(spark, d)[2]


@register
def incremental_periods(spark, d):
    return incremental.publish_periods(spark, _grown_state(spark, d)[0])


@register
def decision_table(spark, d):
    path = tables.scratch_path(spark, "decisions-csv")
    tables.write_csv(decisions(_candidates(spark, d)), path)
    return tables.load_decisions(spark, path)


@register
def preview_repair(spark, d):
    raw = inputs.exposure_raw(spark, d).where(cleaning.stored_type("exposure") == "text")
    return (
        raw.select("site_id", "ts", "exposure", cleaning.clean_int("exposure").alias("cleaned"))
        .orderBy(F.desc("cleaned"), "site_id", "ts")
        .limit(20)
    )


# ---- profiling ---------------------------------------------------------------------


@register
def profile_rows(spark, d):
    return profiling.row_count(inputs.table(spark, d, "lineitem"))


@register
def profile_domain(spark, d):
    return profiling.domain(inputs.table(spark, d, "lineitem"), "l_returnflag")


@register
def profile_range(spark, d):
    return profiling.value_range(inputs.exposure_raw(spark, d), "ts", daytime.TEXT_TIMESTAMP).select(
        "min_value",
        "max_value",
        F.date_format("min_ts", "yyyy-MM-dd HH:mm:ss").alias("min_ts"),
        F.date_format("max_ts", "yyyy-MM-dd HH:mm:ss").alias("max_ts"),
    )


@register
def profile_nulls(spark, d):
    return profiling.null_counts(inputs.incidents(spark, d))


@register
def profile_nulls_lineitem(spark, d):
    return profiling.null_counts(inputs.table(spark, d, "lineitem"))


@register
def profile_missing_name(spark, d):
    return profiling.missing(inputs.incidents(spark, d), "name")


@register
def profile_distinct(spark, d):
    return profiling.distinct_count(inputs.incidents(spark, d), "name")


@register
def profile_distinct_parts(spark, d):
    return profiling.distinct_count(inputs.table(spark, d, "lineitem"), "l_partkey")


@register
def profile_types(spark, d):
    return profiling.type_profile(inputs.exposure_raw(spark, d), "exposure")


@register
def profile_types_clean(spark, d):
    return profiling.type_profile(inputs.exposure(spark, d), "exposure")


LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")


@register
def profile_table(spark, d):
    """Every column of a table in one aggregate; the sketches are held against exact counts."""
    lines = inputs.table(spark, d, "lineitem").select(*LINE_COLUMNS)
    found = table_profile.report(table_profile.profile_table(lines, exact=LINE_COLUMNS))
    off = F.abs(F.col("distinct_estimate") - F.col("exact_distinct")) / F.col("exact_distinct")
    numeric = F.col("column_type").isin("double", "bigint", "int")
    return found.select(
        "column_name",
        "row_count",
        "nulls",
        F.when(numeric, F.col("min_value").cast("double")).alias("min_number"),
        F.when(numeric, F.col("max_value").cast("double")).alias("max_number"),
        F.when(~numeric, F.col("min_value")).alias("min_text"),
        F.when(~numeric, F.col("max_value")).alias("max_text"),
        "exact_distinct",
        (off <= 0.06).alias("estimate_close"),
    )


@register
def profile_batches(spark, d):
    """Profiles of batches, stored one by one and united without another look at the rows."""
    facts = inputs.exposure_raw(spark, d).withColumn("batch", F.col("site_id") % 7)
    path = tables.scratch_path(spark, "profiles")
    stored = tables.save(table_profile.profile_table(facts, batch=["batch"]), path)
    merged = table_profile.report(table_profile.merge_profiles(stored))
    whole = table_profile.report(table_profile.profile_table(facts, exact=["site_id", "exposure"]))
    exact = whole.where(F.col("exact_distinct").isNotNull()).select("column_name", F.col("exact_distinct").alias("counted"))
    close = F.abs(F.col("distinct_estimate") - F.col("counted")) <= 0.06 * F.col("counted")
    return merged.join(exact, "column_name", "left").select(
        "column_name", "row_count", "nulls", "integer_values", "real_values", "text_values", "counted", close.alias("estimate_close")
    )


@register
def profile_fd(spark, d):
    return profiling.fd_violations(inputs.table(spark, d, "lineitem"), "l_orderkey", ["l_suppkey", "l_returnflag"])


@register
def profile_fd_counts(spark, d):
    return profiling.dependency_counts(inputs.exposure_raw(spark, d), "site_id", ["site_name", "lat", "lon"])


@register
def profile_duplicates(spark, d):
    return profiling.duplicates(inputs.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register
def profile_coverage(spark, d):
    return profiling.coverage(inputs.exposure_raw(spark, d), "site_id", "ts", EXPECTED_HOURS)


@register
def profile_coverage_range(spark, d):
    return profiling.coverage_range(inputs.exposure_raw(spark, d), "site_id", "ts")


@register
def reconcile_clean(spark, d):
    exposure = inputs.exposure(spark, d)
    return profiling.reconcile(exposure, rates.exposure_rollup(exposure), "exposure", "exposure")


@register
def reconcile_crosswalk(spark, d):
    stages = _stages(spark, d)
    return profiling.reconcile(stages.cand, stages.crosswalk, "incidents", "incidents")


@register
def reconcile_site_period(spark, d):
    stages = _stages(spark, d)
    served = rates.site_period_metrics(stages.incidents, stages.crosswalk, stages.exposure, _site_attr(spark, d))
    return profiling.reconcile(inputs.exposure(spark, d), served, "exposure", "exposure").select(
        "rows_after", "measure_before", "measure_after", "measure_equal"
    )


@register
def reconcile_contents(spark, d):
    """Totals and contents of stages, gathered while they are written; two swapped values are seen."""
    lines = inputs.table(spark, d, "lineitem")
    slots = F.array(
        F.struct(F.lit(1).alias("slot"), F.round("l_quantity").cast("bigint").alias("value")),
        F.struct(F.lit(2).alias("slot"), F.round(F.col("l_discount") * 100).cast("bigint").alias("value")),
    )
    rows = lines.select("l_orderkey", "l_linenumber", F.explode(slots).alias("s")).select("l_orderkey", "l_linenumber", "s.*")
    path = tables.scratch_path(spark, "reconciled")
    stage, before = profiling.observed_write(rows, path, "value", "before")
    turned = F.when(F.col("l_orderkey") % 10 == 7, 3 - F.col("slot")).otherwise(F.col("slot"))
    _, copied = profiling.observed_write(stage, path + "-copy", "value", "copied")
    _, swapped = profiling.observed_write(stage.withColumn("slot", turned), path + "-swap", "value", "swapped")
    return profiling.compare_totals(spark, before, copied, "copied").unionByName(
        profiling.compare_totals(spark, before, swapped, "swapped")
    )


@register
def batch_summary(spark, d):
    return profiling.summary(_reviews(_candidates(spark, d)), "reason", "incidents")


@register
def missing_attribute_sites(spark, d):
    return profiling.missing_attribute(_site_attr(spark, d), "attr", ["site_id", "site_name", "zone_id"])


@register
def missing_attribute_values(spark, d):
    raw = zones.clean_attributes(inputs.zone_attributes_raw(spark, d)).select("zone_id", "name", "value")
    return profiling.missing_raw_values(_site_attr(spark, d), "attr", raw, "zone_id")


# ---- cleaning ----------------------------------------------------------------------


@register
def clean_int(spark, d):
    return inputs.exposure_raw(spark, d).select(
        "site_id", "ts", "exposure", cleaning.clean_int("exposure").alias("cleaned")
    )


@register
def prefix_int(spark, d):
    o = inputs.table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        cleaning.prefix_int("o_orderpriority").alias("priority"),
        cleaning.prefix_int("o_orderstatus").alias("status_number"),
    )


@register
def drop_description_row(spark, d):
    raw = inputs.zone_attributes_raw(spark, d)
    return zones.drop_rows(raw, F.col("geo_id") == zones.DESCRIPTION_ROW)


@register
def attr_clean(spark, d):
    return zones.clean_attributes(inputs.zone_attributes_raw(spark, d))


# ---- names -------------------------------------------------------------------------


def _site_names(spark: SparkSession, d: str) -> DataFrame:
    return matching.site_dim(inputs.exposure_raw(spark, d)).select("site_id", "site_name")


@register
def base_name(spark, d):
    return _site_names(spark, d).select("site_id", names.base_name("site_name").alias("base_name"))


@register
def expand_street(spark, d):
    base = names.base_name("site_name")
    return _site_names(spark, d).select("site_id", names.expand_street(base).alias("street_name"))


@register
def expand_avenue(spark, d):
    return names.with_site_key(_site_names(spark, d), "site_name", "site_key").select("site_id", "site_key")


@register
def expand_abbrev(spark, d):
    found = inputs.incidents(spark, d).select("name").distinct()
    return found.select("name", names.expand_abbrev("name").alias("name_key"))


@register
def name_match_naive(spark, d):
    base = _site_names(spark, d).withColumn("base_name", names.base_name("site_name"))
    return matching.match_coverage(inputs.incidents(spark, d), F.col("name"), base, "base_name")


@register
def name_match_normalised(spark, d):
    keyed = names.with_site_key(_site_names(spark, d), "site_name", "site_key")
    return matching.match_coverage(
        inputs.incidents(spark, d), names.expand_abbrev("name"), keyed, "site_key"
    )


@register
def name_match_summary(spark, d):
    return matching.name_match_summary(_nearest(spark, d))


@register
def admin_places(spark, d):
    found = inputs.incidents(spark, d)
    return profiling.summary(
        found.where(names.is_admin("name")).withColumn("incidents", F.lit(1)), "name", "incidents"
    )


# ---- time --------------------------------------------------------------------------


@register
def hour24(spark, d):
    return (
        inputs.incidents(spark, d)
        .groupBy(daytime.hour24("tm").alias("hour"))
        .agg(F.count("*").alias("incidents"))
    )


@register
def hour12(spark, d):
    return (
        inputs.exposure(spark, d)
        .groupBy(daytime.hour12("ts").alias("hour"))
        .agg(F.sum("exposure").cast("bigint").alias("exposure"))
    )


@register
def period_of_hour(spark, d):
    hours = inputs.exposure_raw(spark, d).select(daytime.hour12("ts").alias("hour"))
    return hours.groupBy("hour", daytime.period("hour").alias("period")).agg(F.count("*").alias("row_count"))


# ---- bins --------------------------------------------------------------------------


@register
def bin_distance(spark, d):
    return _nearest(spark, d).select(
        *matching.CLUSTER_KEY,
        bins.bin_by("distance_miles", bins.DISTANCE_BINS).alias("distance_range"),
        bins.bin_ordinal("distance_miles", bins.DISTANCE_BINS).alias("bin_ordinal"),
    )


@register
def bin_exposure(spark, d):
    totals = rates.exposure_totals(inputs.exposure(spark, d))
    return totals.select("site_id", "exposure", bins.bin_by("exposure", SITE_BINS).alias("exposure_range"))


@register
def bin_attribute(spark, d):
    return _site_attr(spark, d).select(
        "site_id", "attr", bins.bin_by("attr", bins.INCOME_BINS, bins.MISSING).alias("attr_group")
    )


@register
def flag_threshold(spark, d):
    totals = rates.exposure_totals(inputs.exposure(spark, d))
    mark = bins.flag(F.col("exposure") >= MIN_SITE, "Include", "Low Ridership")
    return totals.select("site_id", "exposure", mark.alias("threshold"))


# ---- geometry ----------------------------------------------------------------------


@register
def coord_clusters(spark, d):
    return matching.coord_clusters(inputs.incidents(spark, d))


@register
def nearest_site(spark, d):
    return rounded(_nearest(spark, d), "distance_miles")


@register
def nearest_sites_in_reach(spark, d):
    """Up to five sites of every cluster, none of them farther than half a mile."""
    clusters = matching.coord_clusters(inputs.incidents(spark, d))
    points = clusters.select(
        *matching.CLUSTER_KEY, geometry.unscaled("lat_e5").alias("lat"), geometry.unscaled("lon_e5").alias("lon")
    )
    found = nearest(points, matching.site_dim(inputs.exposure_raw(spark, d)), k=5, max_miles=0.5)
    return rounded(found.select(*matching.CLUSTER_KEY, "site_rank", "site_id", "site_name", "distance_miles"), "distance_miles")


@register
def nearest_by_great_circle(spark, d):
    """Nearest site around the globe, and the one that differences in degrees would choose."""
    points, sites = inputs.globe_points(spark, d), inputs.globe_sites(spark, d)
    planar = nearest(points, sites).select("c_custkey", F.col("site_id").alias("planar_site_id"))
    found = nearest(points, sites, metric="haversine").join(planar, "c_custkey")
    return rounded(found.select("c_custkey", "site_id", "distance_miles", "planar_site_id"), "distance_miles")


@register
def nearest_sites_by_great_circle(spark, d):
    """Up to three sites within 1,000 miles of every point of the globe."""
    found = nearest(inputs.globe_points(spark, d), inputs.globe_sites(spark, d), k=3, max_miles=1000.0, metric="haversine")
    return rounded(found.select("c_custkey", "site_rank", "site_id", "distance_miles"), "distance_miles")


@register
def distance_histogram(spark, d):
    return matching.distance_histogram(_nearest(spark, d))


@register
def distance_histogram_low_volume(spark, d):
    rare = matching.low_volume(_nearest(spark, d), REVIEW_MIN)
    return matching.distance_histogram(rare, bins.DISTANCE_BINS_SHORT)


@register
def pip_join(spark, d):
    return zones.pip_join(inputs.sites(spark, d), inputs.zones(spark, d))


@register
def pip_unmatched(spark, d):
    return profiling.missing(zones.pip_join(inputs.sites(spark, d), inputs.zones(spark, d)), "zone_id")


@register
def pip_edges(spark, d):
    """Zones given as a table of edges, with holes, never put together."""
    return zones.pip_edges(inputs.sites(spark, d), inputs.band_edges(spark, d)).select("site_id", "zone_id")


@register
def polygon_texts(spark, d):
    """Zones written as well-known text and as GeoJSON, and the edges of what is read back."""
    shapes, path = inputs.zones(spark, d), tables.scratch_path(spark, "features")
    shapes.select(polygons.geojson(F.col("zone_id"), F.col("rings"))).write.text(path)
    texts = tables.save(shapes.select("zone_id", polygons.wkt(F.col("rings")).alias("wkt")), path + "-wkt")
    read = {"geojson": polygons.read_geojson(spark, path), "wkt": polygons.from_wkt(texts)}
    edges = [zones.zone_edges(polygons.usable(z)).withColumn("format", F.lit(name)) for name, z in read.items()]
    return edges[0].unionByName(edges[1])


@register
def polygon_problems(spark, d):
    """Geometries that cannot be used, counted by what is wrong with them."""
    k = F.col("n_nationkey")
    text = (
        F.when(k % 6 == 0, "POLYGON ((0 0, 4 0, 4 4, 0 0))")
        .when(k % 6 == 1, "MULTIPOLYGON EMPTY")
        .when(k % 6 == 2, "POINT (1 2)")
        .when(k % 6 == 3, "POLYGON ((0 0, 4 0, 4 4, 0 0)")
        .when(k % 6 == 4, "POLYGON ((0 0, 4 x, 4 4, 0 0))")
        .otherwise("POLYGON ((0 0, 4 0, 0 0))")
    )
    rows = inputs.table(spark, d, "nation").select(inputs.zone_id(k).alias("zone_id"), text.alias("wkt"))
    return polygons.problem_counts(polygons.from_wkt(rows))


# ---- aggregates and keys -----------------------------------------------------------


@register
def site_dimension(spark, d):
    return matching.site_dim(inputs.exposure_raw(spark, d))


@register
def pick_one(spark, d):
    return matching.site_lookup(matching.site_dim(inputs.exposure_raw(spark, d)))


@register
def best_row_per_key(spark, d):
    lines = inputs.table(spark, d, "lineitem").select(
        "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"
    )
    return best_per_key(lines, ["l_suppkey"], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"])


@register
def average_rank(spark, d):
    m = tables.materialize(rates.exposure_totals(inputs.exposure(spark, d)), "totals")
    m = m.withColumn("thousands", F.floor(F.col("exposure") / 10_000))
    return statistics.average_rank(m, "thousands", "avg_rank").select("site_id", "thousands", "avg_rank")


@register
def average_rank_quantity(spark, d):
    """Fifty values over all line items: every value holds a large share of the rows."""
    lines = inputs.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    ranked = statistics.average_rank(lines, "l_quantity", "avg_rank")
    return ranked.groupBy("l_quantity", "avg_rank").agg(F.count("*").alias("row_count"))


# ---- matching ----------------------------------------------------------------------


@register
def review_queue(spark, d):
    return rounded(_queue(_nearest(spark, d)), "distance_miles")


@register
def latest_decisions(spark, d):
    return matching.latest_decisions(decisions(_candidates(spark, d)))


@register
def apply_decisions(spark, d):
    cand = _candidates(spark, d)
    return rounded(matching.apply_decisions(_queue(cand), decisions(cand)), "distance_miles")


@register
def append_decisions(spark, d):
    return rounded(_reviews(_candidates(spark, d)), "distance_miles")


@register
def review_duplicates(spark, d):
    accepted = _reviews(_candidates(spark, d)).where(F.col("status") == "ACCEPT")
    return profiling.duplicates(accepted, list(matching.CLUSTER_KEY))


@register
def evidence(spark, d):
    queue = _queue(_candidates(spark, d))
    return matching.evidence(inputs.incidents(spark, d), queue, "district")


@register
def validated_names(spark, d):
    return matching.validated_names(_reviews(_candidates(spark, d)))


@register
def triage(spark, d):
    cand = _candidates(spark, d)
    return matching.triage(cand, matching.validated_names(_reviews(cand)), REVIEW_MIN)


@register
def triage_summary(spark, d):
    cand = _candidates(spark, d)
    classes = matching.triage(cand, matching.validated_names(_reviews(cand)), REVIEW_MIN)
    return profiling.summary(classes, "match_status", "incidents")


@register
def unassigned_clusters(spark, d):
    cand = _candidates(spark, d)
    accepted = _reviews(cand).where(F.col("status") == "ACCEPT")
    return matching.unassigned(cand, accepted).select(*matching.CLUSTER_KEY, "incidents")


@register
def crosswalk(spark, d):
    return _crosswalk(spark, d)


@register
def crosswalk_report(spark, d):
    return matching.crosswalk_report(_crosswalk(spark, d))


@register
def crosswalk_duplicates(spark, d):
    return profiling.duplicates(_crosswalk(spark, d), list(matching.CLUSTER_KEY))


@register
def attach_site(spark, d):
    stages = _stages(spark, d)
    joined = matching.attach_site(stages.incidents, stages.crosswalk, ["period"])
    return joined.groupBy("site_id", "period").agg(F.sum("incidents").cast("bigint").alias("incidents"))


@register
def enriched_crosswalk(spark, d):
    return _enriched(spark, d)


@register
def attr_coverage(spark, d):
    return zones.attribute_coverage(_enriched(spark, d))


@register
def site_attributes(spark, d):
    return _site_attr(spark, d)


# ---- rates -------------------------------------------------------------------------


@register
def exposure_totals(spark, d):
    return rates.exposure_ranking(inputs.exposure(spark, d))


@register
def incident_totals(spark, d):
    return rates.incident_totals(_crosswalk(spark, d))


@register
def site_metrics(spark, d):
    return _metrics(spark, d)


@register
def rank_rate(spark, d):
    return rates.top_k(_metrics(spark, d), "rate", 10)


@register
def rank_volume(spark, d):
    return rates.top_k(_metrics(spark, d), "incidents", 10)


@register
def rank_rate_min(spark, d):
    return rates.top_k(_metrics(spark, d), "rate", 10, "exposure", MIN_SITE)


@register
def exposure_distribution(spark, d):
    return rounded(rates.exposure_distribution(_metrics(spark, d)), "avg_exposure")


@register
def sites_per_bin(spark, d):
    return rates.sites_per_bin(_metrics(spark, d), SITE_BINS)


@register
def volume_set(spark, d):
    return rates.volume_set(_metrics(spark, d))


@register
def rate_set(spark, d):
    return _rates(spark, d)


@register
def attribute_set(spark, d):
    return _attrs(spark, d)


@register
def rate_by_bin(spark, d):
    return rounded(rates.rate_by_bin(_attrs(spark, d)), "avg_rate")


@register
def period_metrics(spark, d):
    return _periods(spark, d)


@register
def site_period_metrics(spark, d):
    return _site_periods(spark, d)


@register
def rank_site_period(spark, d):
    return rates.top_k(
        _site_periods(spark, d), "rate", 15, "exposure", MIN_SITE_PERIOD, tie=["site_id", "period"]
    )


@register
def serving_site(spark, d):
    return _published(spark, d)


@register
def serving_site_period(spark, d):
    return rates.publish_site_periods(_site_periods(spark, d), MIN_SITE_PERIOD)


@register
def serving_period(spark, d):
    return rates.period_metrics_from_rollups(*_rollups(spark, d))


@register
def rate_ratio(spark, d):
    return rates.rate_ratio(_periods(spark, d), "Morning")


@register
def quadrant(spark, d):
    return rates.quadrant(_written_metrics(spark, d))


@register
def recurring_outliers(spark, d):
    m = _written_metrics(spark, d)
    res = statistics.residual_table(rates.attribute_set(m, MIN_SITE))
    lists = [
        rates.top_k(m, "rate", 10, "exposure", MIN_SITE),
        rates.top_k(m, "incidents", 10),
        statistics.residual_outliers(res, "exposure_residual"),
        statistics.residual_outliers(res, "attr_residual"),
    ]
    return rates.recurring(lists, 2)


# ---- statistics --------------------------------------------------------------------


@register
def pearson_volume(spark, d):
    return rounded(statistics.pearson(rates.volume_set(_metrics(spark, d)), "exposure", "incidents"), "pearson")


@register
def pearson_rate(spark, d):
    return rounded(statistics.pearson(_rates(spark, d), "exposure", "rate"), "pearson")


@register
def pearson_attr(spark, d):
    return rounded(statistics.pearson(_attrs(spark, d), "attr", "rate"), "pearson")


@register
def pearson_lineitem(spark, d):
    lines = inputs.table(spark, d, "lineitem")
    return rounded(statistics.pearson(lines, "l_quantity", "l_extendedprice"), "pearson")


@register
def spearman_volume(spark, d):
    return rounded(statistics.spearman(rates.volume_set(_written_metrics(spark, d)), "exposure", "incidents"), "spearman")


@register
def spearman_rate(spark, d):
    return rounded(statistics.spearman(rates.rate_set(_written_metrics(spark, d), MIN_SITE), "exposure", "rate"), "spearman")


@register
def spearman_attr(spark, d):
    return rounded(statistics.spearman(rates.attribute_set(_written_metrics(spark, d), MIN_SITE), "attr", "rate"), "spearman")


@register
def spearman_lineitem(spark, d):
    lines = inputs.table(spark, d, "lineitem")
    return rounded(statistics.spearman(lines, "l_quantity", "l_extendedprice"), "spearman")


@register
def correlation_matrix(spark, d):
    """All pairs of five columns, two of which are not always known."""
    lines = inputs.table(spark, d, "lineitem")
    known = lines.withColumns(
        {
            "l_discount": F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")),
            "l_tax": F.when(F.col("l_linenumber") != 3, F.col("l_tax")),
        }
    )
    found = statistics.correlation_matrix(known, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])
    return rounded(found, "pearson", "spearman")


@register
def exact_quartiles(spark, d):
    """Quartiles of three columns, one of which is not always known, in the same reads."""
    lines = inputs.table(spark, d, "lineitem").withColumn("l_discount", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")))
    found = quantiles.exact_quantiles(lines, ["l_quantity", "l_extendedprice", "l_discount"], [0.25, 0.5, 0.75])
    return rounded(found, "value")


@register
def log_exposure(spark, d):
    totals = rates.exposure_totals(inputs.exposure(spark, d)).where(F.col("exposure") > 0)
    return rounded(
        statistics.log10(totals, "exposure", "log_exposure").select("site_id", "log_exposure"), "log_exposure"
    )


@register
def ols_exposure(spark, d):
    logged = statistics.log10(_attrs(spark, d), "exposure", "log_exposure")
    return rounded(statistics.ols(logged, "log_exposure", "rate"), "slope", "intercept")


@register
def ols_attr(spark, d):
    return rounded(statistics.ols(_attrs(spark, d), "attr", "rate"), "intercept").withColumn(
        "slope", F.round("slope", 10)
    )


@register
def residuals(spark, d):
    return rounded(
        statistics.residual_table(rates.attribute_set(_written_metrics(spark, d), MIN_SITE)),
        "log_exposure",
        "expected_from_exposure",
        "exposure_residual",
        "expected_from_attr",
        "attr_residual",
    )


def _outliers(spark: SparkSession, d: str, col: str, side: str) -> DataFrame:
    table = statistics.residual_table(rates.attribute_set(_written_metrics(spark, d), MIN_SITE))
    picked = statistics.residual_outliers(table, col, 10, side)
    return rounded(picked.select("site_id", "site_name", "attr", "exposure", "rate", col), col)


@register
def outliers_above_exposure(spark, d):
    return _outliers(spark, d, "exposure_residual", "above")


@register
def outliers_above_attr(spark, d):
    return _outliers(spark, d, "attr_residual", "above")


@register
def outliers_below_attr(spark, d):
    return _outliers(spark, d, "attr_residual", "below")


# ---- dashboard views ---------------------------------------------------------------


@register
def view_rate_by_bin(spark, d):
    return rounded(views.view_rate_by_bin(_published(spark, d), MIN_SITE), "avg_rate")


@register
def view_period_rate(spark, d):
    return views.view_period_rate(_periods(spark, d))


@register
def view_top_site_periods(spark, d):
    served = rates.publish_site_periods(_site_periods(spark, d), MIN_SITE_PERIOD)
    return rounded(views.view_top_site_periods(served, 15), "avg_rate", "max_rate")


@register
def view_rate_vs_attr(spark, d):
    return views.view_rate_vs_attr(_published(spark, d), MIN_SITE)


@register
def view_rate_vs_attr_trend(spark, d):
    return rounded(views.view_rate_vs_attr_trend(_published(spark, d), MIN_SITE), "intercept").withColumn(
        "slope", F.round("slope", 10)
    )


@register
def view_volume_vs_exposure(spark, d):
    return views.view_volume_vs_exposure(_published(spark, d))


@register
def view_volume_vs_exposure_trend(spark, d):
    return rounded(views.view_volume_vs_exposure_trend(_published(spark, d)), "intercept").withColumn(
        "slope", F.round("slope", 10)
    )


@register
def view_top_sites(spark, d):
    return rounded(views.view_top_sites(_published(spark, d), 10, MIN_SITE), "rate")


# ---- the whole analysis ------------------------------------------------------------


@register
def full_analysis(spark, d):
    """All stages from raw facts, published and read back: what each of the tables holds."""
    result = analysis.analyse(
        inputs.incidents(spark, d),
        inputs.exposure(spark, d),
        _site_attr(spark, d),
        lambda cand: (decisions(cand), low_batch(cand)),
        REVIEW_MIN,
        MIN_SITE_PERIOD,
    )
    served = analysis.publish(result, tables.scratch_path(spark, "served"), MIN_SITE)
    return analysis.contents(served)


@register
def published_sites(spark, d):
    """The site table as a CSV file holds it."""
    result = rates.publish_sites(_metrics(spark, d))
    path = tables.write_csv(result, tables.scratch_path(spark, "sites"))
    return tables.read_csv(spark, path, result.schema)


# ---- values that are easily lost ---------------------------------------------------


@register
def clean_decimal(spark, d):
    """Whole numbers that arrive as decimal text."""
    text = inputs.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("text")
    )
    return text.select("l_orderkey", "l_linenumber", "text", cleaning.clean_int("text").alias("cleaned"))


@register
def unreadable_values(spark, d):
    orders = inputs.table(spark, d, "orders")
    return profiling.unreadable(orders, "o_orderpriority", cleaning.clean_int("o_orderpriority"))


@register
def csv_odd_values(spark, d):
    """Texts with spaces at the ends, line ends, quotes, separators, and empty and missing ones."""
    o = inputs.table(spark, d, "orders")
    k, word = F.col("o_orderkey"), F.col("o_orderpriority")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("  "), word, F.lit(" ")))
        .when(k % 6 == 1, F.concat(word, F.lit("\n"), word))
        .when(k % 6 == 2, F.concat(F.lit('"'), word, F.lit('", "')))
        .when(k % 6 == 3, "")
        .when(k % 6 == 4, None)
        .otherwise(F.concat(word, F.lit("\r\n,\\")))
    )
    rows = o.select("o_orderkey", text.alias("text"))
    return tables.read_csv(spark, tables.write_csv(rows, tables.scratch_path(spark, "odd")), rows.schema)


@register
def nearest_site_of_facts(spark, d):
    """One point per incident: repeated places come back as often as they occur, places that are
    no numbers without a site."""
    facts = inputs.incidents(spark, d).select(
        "name", F.when(F.col("district") == 3, F.lit(float("nan"))).otherwise(F.col("lat")).alias("lat"), "lon"
    )
    found = nearest(facts, matching.site_dim(inputs.exposure_raw(spark, d)))
    return found.groupBy("site_id").agg(
        F.count("*").alias("points"), F.round(F.max("distance_miles"), 6).alias("farthest_miles")
    )


@register
def clusters_without_place(spark, d):
    """Coordinates that are no numbers have no key."""
    facts = inputs.incidents(spark, d).select(
        "name",
        F.when(F.col("district") == 3, F.lit(float("nan"))).otherwise(F.col("lat")).alias("lat"),
        F.when(F.col("district") == 5, F.lit(float("inf"))).otherwise(F.col("lon")).alias("lon"),
    )
    return matching.coord_clusters(facts)


# ---- raw tables to the columns of the analysis -------------------------------------


@register
def raw_incidents(spark, d):
    raw = inputs.incidents(spark, d).select(
        F.col("dt").alias("Start Date"),
        F.col("tm").alias("Start Time"),
        F.col("name").alias("Place"),
        F.col("lat").cast("string").alias("Lat"),
        F.col("lon").cast("string").alias("Long"),
        F.col("district").cast("string").alias("District"),
    )
    names = {"dt": "Start Date", "tm": "Start Time", "name": "Place", "lat": "Lat", "lon": "Long", "district": "District"}
    return tables.ingest(raw, tables.INCIDENT_SCHEMA, names)


@register
def raw_exposure(spark, d):
    raw = inputs.exposure_raw(spark, d)
    raw = raw.select([F.col(c).cast("string").alias(c) for c in raw.columns])
    return tables.ingest(raw, tables.EXPOSURE_SCHEMA)


@register
def raw_zone_attributes(spark, d):
    """A raw table without one of the declared columns."""
    raw = inputs.zone_attributes_raw(spark, d).drop("name")
    return tables.ingest(raw, tables.ZONE_ATTRIBUTE_SCHEMA, optional=["name"])
