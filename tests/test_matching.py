import random

import pytest
from pyspark.sql import functions as F

from perexpo.operators import matching, profiling
from perexpo.sources.tables import DECISION_SCHEMA, REVIEW_SCHEMA

CANDIDATE_SCHEMA = (
    "name string, lat_e5 bigint, lon_e5 bigint, incidents bigint, name_key string, "
    "site_id bigint, site_name string, site_key string, distance_miles double"
)
KEY = list(matching.CLUSTER_KEY)


def review(name, lat, n, site_id, status="ACCEPT", site=None):
    return (name, lat, 0, n, site or f"S{site_id}", site_id, 0.1, status, "r")


def one_per_status(spark):
    cand = spark.createDataFrame(
        [
            ("EXACT", 1, 0, 50, "EXACT", 1, "S1", "EXACT", 0.0),
            ("MANUAL", 1, 0, 30, "MANUAL", 2, "S2", "OTHER", 0.1),
            ("MANUAL", 2, 0, 19, "MANUAL", 3, "S3", "OTHER", 0.1),  # rare, same name: reused
            ("MANUAL", 3, 0, 20, "MANUAL", 3, "S3", "OTHER", 0.1),  # too frequent to be reused
            ("TWICE", 3, 0, 5, "TWICE", 3, "S3", "OTHER", 0.1),
            ("district 7 office", 1, 0, 2, "district 7 office", 3, "S3", "OTHER", 0.1),
            ("UNKNOWN", 1, 0, 2, "UNKNOWN", 3, "S3", "OTHER", 0.1),
            (None, 1, 0, 4, None, 3, "S3", "OTHER", 0.1),
            ("GONE", 1, 0, 4, "GONE", 3, "S3", "OTHER", 0.1),
        ],
        CANDIDATE_SCHEMA,
    )
    reviews = spark.createDataFrame(
        [
            review("MANUAL", 1, 30, 2),
            review("TWICE", 1, 25, 2),
            review("TWICE", 2, 25, 3),
            review("UNKNOWN", 1, 2, 3, "INVESTIGATE"),
            review("EXACT", 1, 50, 9),
            review("GONE", 7, 21, 99),  # the site table does not have 99
        ],
        REVIEW_SCHEMA,
    )
    lookup = spark.createDataFrame([(1, "S1"), (2, "S2"), (3, "S3")], "site_id bigint, site_name string")
    return cand, reviews, lookup


def test_crosswalk_rules(spark):
    rows = {(r.name, r.lat_e5): r for r in matching.build_crosswalk(*one_per_status(spark)).collect()}
    status = {k: (r.match_status, r.site_id) for k, r in rows.items()}
    assert status == {
        ("EXACT", 1): ("EXACT_NAME", 1),
        ("MANUAL", 1): ("MANUAL_ACCEPT", 2),
        ("MANUAL", 2): ("AUTO_ACCEPT_VALIDATED_NAME", 2),
        ("MANUAL", 3): ("UNRESOLVED", None),
        ("TWICE", 1): ("MANUAL_ACCEPT", 2),  # accepted although the cluster is gone
        ("TWICE", 2): ("MANUAL_ACCEPT", 3),
        ("TWICE", 3): ("AMBIGUOUS", None),
        ("district 7 office", 1): ("ADMIN_LOCATION", None),
        ("UNKNOWN", 1): ("UNRESOLVED", None),
        (None, 1): ("UNRESOLVED", None),
        ("GONE", 1): ("UNRESOLVED", None),
        ("GONE", 7): ("MANUAL_ACCEPT", 99),
    }
    assert rows[("MANUAL", 2)].site_name == "S2"
    assert rows[("TWICE", 1)].incidents == 25


def in_batches(cand, reviews, lookup, low=20):
    """The same rules as four batches, each filling what the earlier ones left."""
    out = [*KEY, "incidents", "site_name", "site_id", "match_status"]
    ok = reviews.where("status = 'ACCEPT'")
    done = cand.where("name_key = site_key").withColumn("match_status", F.lit("EXACT_NAME")).select(out)
    manual = ok.join(done.select(KEY), KEY, "left_anti").withColumn("match_status", F.lit("MANUAL_ACCEPT")).select(out)
    done = done.unionByName(manual)
    names = matching.validated_names(reviews)
    auto = (
        cand.drop("site_id", "site_name").where("name_key <> site_key").where(F.col("incidents") < low)
        .where(~F.col("name").ilike("district % office"))
        .join(names.where("validated_ids = 1"), "name")
        .join(lookup, F.col("validated_id") == lookup.site_id)
        .join(done.select(KEY), KEY, "left_anti")
        .withColumn("match_status", F.lit("AUTO_ACCEPT_VALIDATED_NAME")).select(out)
    )
    done = done.unionByName(auto)
    rest = (
        cand.join(done.select(KEY), KEY, "left_anti").join(names, "name", "left")
        .withColumn(
            "match_status",
            F.when(F.col("name").ilike("district % office"), "ADMIN_LOCATION")
            .when(F.col("validated_ids") > 1, "AMBIGUOUS").otherwise("UNRESOLVED"),
        )
        .withColumn("site_name", F.lit(None).cast("string")).withColumn("site_id", F.lit(None).cast("bigint")).select(out)
    )
    return done.unionByName(rest)


def key_of(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("seed", [0, 1])
def test_one_pass_equals_batches(spark, seed):
    rng = random.Random(seed)
    names = ["A", "B", "C", "D", "DISTRICT 1 OFFICE", None]
    cand, reviews = [], []
    for name in names:
        for lat in range(8):
            site = rng.randint(1, 4)
            key = name if rng.random() < 0.2 else "X"
            n = rng.choice([1, 5, 19, 20, 40])
            cand.append((name, lat, 0, n, name, site, f"S{site}", key, 0.1))
            if rng.random() < 0.5:
                reviews.append(review(name, lat + rng.choice([0, 0, 100]), n, rng.choice([1, 1, site]), rng.choice(["ACCEPT", "INVESTIGATE"])))
    lookup = spark.createDataFrame([(i, f"S{i}") for i in range(1, 4)], "site_id bigint, site_name string")
    args = spark.createDataFrame(cand, CANDIDATE_SCHEMA), spark.createDataFrame(reviews, REVIEW_SCHEMA), lookup
    once = sorted((tuple(r) for r in matching.build_crosswalk(*args).collect()), key=key_of)
    assert once == sorted((tuple(r) for r in in_batches(*args).collect()), key=key_of)


def test_every_cluster_once(spark):
    cand, reviews, lookup = one_per_status(spark)
    known = reviews.join(cand, KEY, "left_semi")
    crosswalk = matching.build_crosswalk(cand, known, lookup)
    assert profiling.duplicates(crosswalk, KEY).count() == 0
    assert profiling.reconcile(cand, crosswalk, "incidents", "incidents").first().measure_equal


def test_decisions_latest_wins(spark):
    queue = spark.createDataFrame(
        [("A", 1, 0, 30, "S1", 1, 0.1, None, None), ("B", 1, 0, 30, "S1", 1, 0.1, None, None)], REVIEW_SCHEMA
    )
    decisions = spark.createDataFrame(
        [
            (2, "A", 1, 0, "ACCEPT", 7, "S7", "second"),
            (1, "A", 1, 0, "INVESTIGATE", None, None, "first"),
            (1, "Z", 1, 0, "ACCEPT", None, None, "not in the queue"),
        ],
        DECISION_SCHEMA,
    )
    rows = {r.name: r for r in matching.apply_decisions(queue, decisions).collect()}
    assert set(rows) == {"A", "B"}
    assert (rows["A"].status, rows["A"].site_id, rows["A"].site_name, rows["A"].reason) == ("ACCEPT", 7, "S7", "second")
    assert (rows["B"].status, rows["B"].site_id) == (None, 1)


def test_clusters_merge_close_spellings_of_a_coordinate(spark):
    facts = spark.createDataFrame(
        [("A", 40.123451, -73.9), ("A", 40.123449, -73.900001), ("A", 40.5, -73.9), ("A", None, None), (None, 40.5, -73.9)],
        "name string, lat double, lon double",
    )
    rows = {(r.name, r.lat_e5, r.lon_e5): r.incidents for r in matching.coord_clusters(facts).collect()}
    assert rows == {
        ("A", 4012345, -7390000): 2, ("A", 4050000, -7390000): 1, ("A", None, None): 1, (None, 4050000, -7390000): 1,
    }


def test_queue_and_triage_limits(spark):
    cand, reviews, _ = one_per_status(spark)
    assert {(r.name, r.lat_e5) for r in matching.review_queue(cand).collect()} == {("MANUAL", 1), ("MANUAL", 3)}
    classes = {
        (r.name, r.lat_e5): r.match_status
        for r in matching.triage(cand, matching.validated_names(reviews)).collect()
    }
    assert classes == {
        ("MANUAL", 2): "AUTO_ACCEPT_VALIDATED_NAME",
        ("TWICE", 3): "AMBIGUOUS_VALIDATED_NAME",
        ("district 7 office", 1): "ADMIN_LOCATION",
        ("UNKNOWN", 1): "NEEDS_REVIEW",
        ("GONE", 1): "AUTO_ACCEPT_VALIDATED_NAME",
    }


def test_unknown_keys_are_never_assigned(spark):
    cand, reviews, _ = one_per_status(spark)
    left = matching.unassigned(cand, cand.where("name is null or name = 'EXACT'"))
    assert {r.name for r in left.collect()} >= {None} and left.count() == 8


def test_evidence_counts_only_listed_clusters(spark):
    facts = spark.createDataFrame(
        [("A", 1.0, 2.0, 5), ("A", 1.0, 2.0, 5), ("A", 1.0, 2.0, 6), ("B", 1.0, 2.0, 5)], "name string, lat double, lon double, district int"
    )
    keys = spark.createDataFrame([("A", 100000, 200000), ("A", 100000, 200000)], "name string, lat_e5 bigint, lon_e5 bigint")
    got = {(r.name, r.district): r.incidents for r in matching.evidence(facts, keys, "district").collect()}
    assert got == {("A", 5): 2, ("A", 6): 1}
