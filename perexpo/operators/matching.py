"""Resolution of incident places to sites when the two sources share no key.

Places are clusters of (name, rounded coordinates). Each cluster gets its nearest site as
candidate; exact names are accepted, frequent mismatches go to review, rare ones reuse
names that review has tied to exactly one site, and whatever stays uncertain stays
unmatched. Keys hold coordinates as scaled integers (see ``geometry.scaled``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perexpo.functions.bins import DISTANCE_BINS, Bins, bin_by, bin_ordinal
from perexpo.functions.geometry import scaled, unscaled
from perexpo.functions.names import ADMIN_PATTERN, expand_abbrev, is_admin, with_site_key
from perexpo.operators.nearest import best_per_key, nearest

CLUSTER_KEY = ("name", "lat_e5", "lon_e5")
# Fixed value: clusters with fewer incidents are not reviewed one by one.
REVIEW_MIN_COUNT = 20


def cluster_keys(facts: DataFrame, name: str = "name", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Replace coordinates by the rounded integer keys that identify a cluster."""
    rest = [c for c in facts.columns if c not in (name, lat, lon)]
    return facts.select(
        F.col(name).alias("name"), scaled(lat).alias("lat_e5"), scaled(lon).alias("lon_e5"), *rest
    )


def coord_clusters(facts: DataFrame, name: str = "name", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Incidents per (name, rounded coordinates)."""
    keyed = cluster_keys(facts.select(name, lat, lon), name, lat, lon)
    return keyed.groupBy(*CLUSTER_KEY).agg(F.count("*").alias("incidents"))


def clusters_of(incident_roll: DataFrame) -> DataFrame:
    """The same clusters from incidents that are already counted by cluster and more."""
    return incident_roll.groupBy(*CLUSTER_KEY).agg(F.sum("incidents").cast("bigint").alias("incidents"))


def site_dim(exposure: DataFrame) -> DataFrame:
    """The sites that occur in the exposure facts."""
    return exposure.select("site_id", "site_name", "lat", "lon").distinct()


def site_lookup(sites: DataFrame) -> DataFrame:
    """One name per site id."""
    return sites.groupBy("site_id").agg(F.min("site_name").alias("site_name"))


def match_coverage(left: DataFrame, left_key: Column, right: DataFrame, right_key: str, name: str = "name") -> DataFrame:
    """How many distinct left names have an equal normalised name on the right.

    Both sides are reduced to distinct keys first and met by a semi join, so neither the
    number of facts per name nor repeated names multiply rows. The key also looks at the
    count, which keeps the planner from testing it for NULL on every fact.
    """
    names = left.groupBy(name).agg(F.count("*").alias("_n"))
    keys = right.select(F.col(right_key).alias("_key")).distinct()
    hit = names.withColumn("_key", F.when(F.col("_n") > 0, left_key)).join(keys, "_key", "left_semi")
    return hit.agg(F.count(name).alias("matched_names"))


def candidates(clusters: DataFrame, sites: DataFrame) -> DataFrame:
    """Nearest site of each cluster, with both names in comparable form."""
    points = clusters.select(
        "*",
        unscaled("lat_e5").alias("lat"),
        unscaled("lon_e5").alias("lon"),
        expand_abbrev("name").alias("name_key"),
    )
    keyed = with_site_key(sites, "site_name", "site_key")
    return nearest(points, keyed, keep=("site_name", "site_key")).select(
        *CLUSTER_KEY, "incidents", "name_key", "site_id", "site_name", "site_key", "distance_miles"
    )


def same_name() -> Column:
    return F.col("name_key") == F.col("site_key")


def other_name() -> Column:
    """Both names known and different."""
    return F.col("name_key") != F.col("site_key")


def name_match_summary(cand: DataFrame) -> DataFrame:
    verdict = F.when(same_name(), "EXACT MATCH").otherwise("NO EXACT MATCH")
    return cand.groupBy(verdict.alias("name_match")).agg(
        F.count("*").alias("clusters"), F.sum("incidents").cast("bigint").alias("incidents")
    )


def distance_histogram(cand: DataFrame, bins: Bins = DISTANCE_BINS) -> DataFrame:
    """Clusters and incidents per distance range, in range order."""
    return (
        cand.groupBy(
            bin_by("distance_miles", bins).alias("distance_range"),
            bin_ordinal("distance_miles", bins).alias("bin_ordinal"),
        )
        .agg(F.count("*").alias("clusters"), F.sum("incidents").cast("bigint").alias("incidents"))
        .orderBy("bin_ordinal")
    )


def low_volume(cand: DataFrame, max_count: int = REVIEW_MIN_COUNT) -> DataFrame:
    """Clusters with another name than their candidate, too rare for the review queue."""
    return cand.where(other_name() & (F.col("incidents") < max_count))


def review_queue(cand: DataFrame, min_count: int = REVIEW_MIN_COUNT) -> DataFrame:
    """Frequent clusters whose name differs from their candidate's, still undecided."""
    return cand.where(other_name() & (F.col("incidents") >= min_count)).select(
        *CLUSTER_KEY,
        "incidents",
        "site_name",
        "site_id",
        "distance_miles",
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("reason"),
    )


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The decision with the highest ``seq`` for each cluster."""
    newest_first = decisions.withColumn("seq", -F.col("seq"))
    return best_per_key(newest_first, CLUSTER_KEY, ["seq"]).withColumn("seq", -F.col("seq"))


def apply_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Write status and reason into the queue; an override also replaces the candidate."""
    newest = latest_decisions(decisions).select(
        *CLUSTER_KEY,
        F.col("status").alias("new_status"),
        F.col("reason").alias("new_reason"),
        "override_site_id",
        "override_site_name",
    )
    return queue.join(newest, list(CLUSTER_KEY), "left").select(
        *CLUSTER_KEY,
        "incidents",
        F.coalesce("override_site_name", "site_name").alias("site_name"),
        F.coalesce("override_site_id", "site_id").alias("site_id"),
        "distance_miles",
        F.coalesce("new_status", "status").alias("status"),
        F.coalesce("new_reason", "reason").alias("reason"),
    )


def accept(cand: DataFrame, reason: str) -> DataFrame:
    """Candidates turned into accepted review rows."""
    return cand.select(
        *CLUSTER_KEY,
        "incidents",
        "site_name",
        "site_id",
        "distance_miles",
        F.lit("ACCEPT").alias("status"),
        F.lit(reason).alias("reason"),
    )


def append_decisions(reviews: DataFrame, *batches: DataFrame) -> DataFrame:
    """Add reviewed batches below the existing rows."""
    for batch in batches:
        reviews = reviews.unionByName(batch)
    return reviews


def evidence(facts: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """Incidents of the listed clusters split by a further attribute.

    Facts are counted per cluster and attribute before they meet the list.
    """
    counts = cluster_keys(facts).groupBy(*CLUSTER_KEY, by).agg(F.count("*").alias("incidents"))
    return counts.join(keys.select(*CLUSTER_KEY).distinct(), list(CLUSTER_KEY), "left_semi")


def validated_names(reviews: DataFrame) -> DataFrame:
    """Per accepted name, its smallest site id and how many different ids it was tied to."""
    return (
        reviews.where(F.col("status") == "ACCEPT")
        .groupBy("name")
        .agg(F.min("site_id").alias("validated_id"), F.count_distinct(F.col("site_id")).alias("validated_ids"))
    )


def triage(cand: DataFrame, validated: DataFrame, max_count: int = REVIEW_MIN_COUNT, admin: str = ADMIN_PATTERN) -> DataFrame:
    """Class of each low-volume cluster: what review has already said about its name."""
    n = F.col("validated_ids")
    return low_volume(cand, max_count).join(validated, "name", "left").select(
        *CLUSTER_KEY,
        "incidents",
        F.when(is_admin("name", admin), "ADMIN_LOCATION")
        .when(n == 1, "AUTO_ACCEPT_VALIDATED_NAME")
        .when(n > 1, "AMBIGUOUS_VALIDATED_NAME")
        .otherwise("NEEDS_REVIEW")
        .alias("match_status"),
    )


def unassigned(cand: DataFrame, assigned: DataFrame) -> DataFrame:
    """Clusters not assigned yet; clusters with an unknown key never count as assigned."""
    return cand.join(assigned.select(*CLUSTER_KEY), list(CLUSTER_KEY), "left_anti")


def build_crosswalk(
    cand: DataFrame,
    reviews: DataFrame,
    lookup: DataFrame,
    low_count: int = REVIEW_MIN_COUNT,
    admin: str = ADMIN_PATTERN,
) -> DataFrame:
    """Final assignment of every cluster, by the first rule that applies.

    EXACT_NAME, then MANUAL_ACCEPT, then AUTO_ACCEPT_VALIDATED_NAME for rare clusters,
    else no site with the reason ADMIN_LOCATION, AMBIGUOUS or UNRESOLVED. The rules are
    one priority chain over a single join of clusters and reviews instead of one pass per
    rule. Accepted review rows for clusters that no longer occur are kept as accepted.
    """
    accepted = best_per_key(
        reviews.where(F.col("status") == "ACCEPT").select(
            *CLUSTER_KEY, "site_id", "site_name", "incidents"
        ),
        CLUSTER_KEY,
        ["site_id", "site_name", "incidents"],
    ).select(
        *CLUSTER_KEY,
        F.col("site_id").alias("review_id"),
        F.col("site_name").alias("review_name"),
        F.col("incidents").alias("review_incidents"),
        F.lit(True).alias("reviewed"),
    )
    # Names tied to one site, with that site's name; ids the site table lacks drop out.
    names = (
        validated_names(reviews)
        .join(lookup.select(F.col("site_id").alias("validated_id"), F.col("site_name").alias("validated_name")), "validated_id", "left")
    )
    exact = F.coalesce(same_name(), F.lit(False))
    manual = F.coalesce(F.col("reviewed"), F.lit(False))
    auto = (
        (F.col("validated_ids") == 1)
        & F.col("validated_name").isNotNull()
        & (F.col("incidents") < low_count)
        & other_name()
        & ~is_admin("name", admin)
    )
    status = (
        F.when(exact, "EXACT_NAME")
        .when(manual, "MANUAL_ACCEPT")
        .when(auto, "AUTO_ACCEPT_VALIDATED_NAME")
        .when(is_admin("name", admin), "ADMIN_LOCATION")
        .when(F.col("validated_ids") > 1, "AMBIGUOUS")
        .otherwise("UNRESOLVED")
    )

    def by_status(exact_col: str, manual_col: str, auto_col: str) -> Column:
        s = F.col("match_status")
        return (
            F.when(s == "EXACT_NAME", F.col(exact_col))
            .when(s == "MANUAL_ACCEPT", F.col(manual_col))
            .when(s == "AUTO_ACCEPT_VALIDATED_NAME", F.col(auto_col))
        )

    # Clusters without a name match no validated name and would all meet in one task.
    joined = cand.join(accepted, list(CLUSTER_KEY), "full")
    named = joined.where(F.col("name").isNotNull()).join(names, "name", "left")
    return (
        named.unionByName(joined.where(F.col("name").isNull()), allowMissingColumns=True)
        .withColumn("match_status", status)
        .select(
            *CLUSTER_KEY,
            F.when(F.col("match_status") == "MANUAL_ACCEPT", F.col("review_incidents"))
            .otherwise(F.col("incidents"))
            .alias("incidents"),
            by_status("site_name", "review_name", "validated_name").alias("site_name"),
            by_status("site_id", "review_id", "validated_id").alias("site_id"),
            "match_status",
        )
    )


def crosswalk_report(crosswalk: DataFrame) -> DataFrame:
    """Clusters and incidents per assignment status, largest first."""
    return (
        crosswalk.groupBy("match_status")
        .agg(F.count("*").alias("clusters"), F.sum("incidents").cast("bigint").alias("incidents"))
        .orderBy(F.desc("incidents"))
    )


def attach_site(counts: DataFrame, crosswalk: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Matched incidents with their site.

    ``counts`` holds incidents already counted per cluster (and ``extra`` columns), so
    the join moves one row per cluster instead of one per fact and a busy place is no
    heavier than a quiet one.
    """
    target = crosswalk.where(F.col("site_id").isNotNull()).select(*CLUSTER_KEY, "site_id")
    return counts.join(target, list(CLUSTER_KEY)).select("site_id", *extra, "incidents")
