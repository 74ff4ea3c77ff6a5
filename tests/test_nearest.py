import re
import random

import pytest
from pyspark.sql import functions as F

from perexpo.operators.nearest import best_per_key, nearest


def brute(points, sites):
    out = {}
    for pid, lat, lon in points:
        if lat is None or lon is None:
            out[pid] = None
            continue
        out[pid] = min(
            ((lat - y) * (lat - y) + (lon - x) * (lon - x), sid) for sid, y, x in sites
        )[1]
    return out


def run(spark, points, sites, leaf_size=32):
    p = spark.createDataFrame(points, "pid int, lat double, lon double")
    s = spark.createDataFrame([(sid, f"s{sid}", y, x) for sid, y, x in sites], "site_id bigint, site_name string, lat double, lon double")
    rows = nearest(p, s, leaf_size=leaf_size).collect()
    assert len(rows) == len(points)
    assert all(r.site_name == (None if r.site_id is None else f"s{r.site_id}") for r in rows)
    return {r.pid: r.site_id for r in rows}


def cloud(rng, n, spread=0.4):
    return [(i, 40.5 + rng.random() * spread, -74.0 + rng.random() * spread) for i in range(n)]


@pytest.mark.parametrize("leaf_size", [1, 4, 32])
def test_matches_brute_force(spark, leaf_size):
    rng = random.Random(leaf_size)
    sites, points = cloud(rng, 300), cloud(rng, 200, 0.6)
    assert run(spark, points, sites, leaf_size) == brute(points, sites)


def test_index_too_large_to_broadcast(spark):
    rng = random.Random(11)
    sites, points = cloud(rng, 300), cloud(rng, 150, 0.6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run(spark, points, sites, 4) == brute(points, sites)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dense_clump_far_from_most_points(spark):
    """A third of sites and of points within a few metres, the rest around the world."""
    rng = random.Random(7)
    clump = [(i, 40.7 + rng.random() * 1e-5, -73.9 + rng.random() * 1e-5) for i in range(150)]
    wide = [(150 + i, rng.uniform(-80, 80), rng.uniform(-179, 179)) for i in range(300)]
    points = [(i, 40.7 + rng.random() * 1e-5, -73.9 + rng.random() * 1e-5) for i in range(60)]
    points += [(60 + i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(120)]
    assert run(spark, points, clump + wide, 8) == brute(points, clump + wide)


def test_ties_and_shared_places_go_to_the_smallest_id(spark):
    sites = [(9, 1.0, 0.0), (3, -1.0, 0.0), (5, 0.0, 1.0), (4, -1.0, 0.0), (2, 5.0, 5.0), (1, 5.0, 5.0)]
    assert run(spark, [(0, 0.0, 0.0), (1, 5.0, 4.0)], sites, 1) == {0: 3, 1: 1}


def test_points_without_coordinates_stay(spark):
    got = run(spark, [(0, None, 1.0), (1, 1.0, None), (2, 1.0, 1.0)], [(1, 0.0, 0.0)])
    assert got == {0: None, 1: None, 2: 1}


def test_no_sites(spark):
    assert run(spark, [(0, 1.0, 1.0)], []) == {0: None}


def test_coordinates_outside_degrees(spark):
    rng = random.Random(3)
    sites = [(i, rng.uniform(-5000, 5000), rng.uniform(-5000, 5000)) for i in range(200)]
    points = [(i, rng.uniform(-6000, 6000), rng.uniform(-6000, 6000)) for i in range(100)]
    assert run(spark, points, sites, 4) == brute(points, sites)


def test_best_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, n int, v string")
    assert sorted(best_per_key(df, ["k"], ["n"]).collect()) == [("a", 1, "y"), ("b", 5, "z")]


def test_distance_is_reported_in_miles(spark):
    p = spark.createDataFrame([(40.0, -74.0)], "lat double, lon double")
    s = spark.createDataFrame([(1, "s", 41.0, -74.0)], "site_id bigint, site_name string, lat double, lon double")
    assert nearest(p, s).select(F.round("distance_miles", 2)).first()[0] == 69.1


def test_repeated_points_and_places_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    points = [(1.0, 1.0)] * 3 + [(nan, 1.0), (1.0, inf), (None, 1.0), (nan, 1.0)]
    sites = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "b", 2.0, 2.0)], "site_id bigint, site_name string, lat double, lon double")
    found = nearest(spark.createDataFrame(points, "lat double, lon double"), sites)
    assert sorted((r.site_id for r in found.collect()), key=str) == [1, 1, 1, None, None, None, None]


def test_steps_below_the_exploded_cells_use_one_number(spark):
    rng = spark.range(3000).selectExpr("cast(rand(1) as double) lat", "cast(rand(2) as double) lon")
    sites = spark.range(500).selectExpr("id site_id", "'x' site_name", "rand(3) lat", "rand(4) lon")
    plan = nearest(rng, sites)._jdf.queryExecution().executedPlan().toString()
    # The window of a level sorts and deals out by the place's number, not by its coordinates.
    assert re.search(r"Window \[min\(upper#\d+\) windowspecdefinition\(_place#", plan)
