"""Several sites per point, a reach in miles, and great circles, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from perexpo.functions.geometry import EARTH_RADIUS_MILES, great_circle_bounds, haversine_miles
from perexpo.operators.nearest import nearest


def miles(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    a += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_MILES * math.asin(min(1.0, math.sqrt(a)))


def brute(points, sites, k, max_miles, metric):
    """{point number: [(site id, lat, lon)]}, nearest first; repeated (id, place) count once."""
    out = {}
    for pid, lat, lon in points:
        ranked = []
        for sid, y, x in set(sites) if lat is not None and not math.isnan(lat) else ():
            far = miles(lat, lon, y, x)
            if max_miles is None or far <= max_miles:
                rank = (lat - y) * (lat - y) + (lon - x) * (lon - x) if metric == "planar" else round(far, 6)
                ranked.append((rank, sid, y, x))
        out[pid] = [r[1:] for r in sorted(ranked)[:k]]
    return out


def check(spark, points, sites, k, max_miles=None, metric="planar", leaf_size=8):
    p = spark.createDataFrame(points, "pid int, lat double, lon double")
    s = spark.createDataFrame([(sid, f"s{sid}", y, x) for sid, y, x in sites], "site_id bigint, site_name string, lat double, lon double")
    rows = nearest(p, s, leaf_size=leaf_size, k=k, max_miles=max_miles, metric=metric).collect()
    found = {pid: [] for pid, *_ in points}
    for r in sorted(rows, key=lambda r: r.site_rank if k > 1 and r.site_rank else 0):
        if r.site_id is None:
            assert r.site_lat is None and r.distance_miles is None
            assert sum(q.pid == r.pid for q in rows) == 1
        else:
            assert r.site_name == f"s{r.site_id}"
            assert r.distance_miles == pytest.approx(miles(r.lat, r.lon, r.site_lat, r.site_lon), abs=1e-6)
            found[r.pid].append((r.site_id, r.site_lat, r.site_lon))
            if k > 1:
                assert r.site_rank == len(found[r.pid])
    assert found == brute(points, sites, k, max_miles, metric)
    return found


def cloud(rng, n, spread=0.4):
    return [(i, 40.5 + rng.random() * spread, -74.0 + rng.random() * spread) for i in range(n)]


def globe(rng, n):
    edges = [(90.0, 10.0), (-90.0, 0.0), (89.9, -170.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.999), (-10.0, -179.999)]
    rest = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n - len(edges))]
    return [(i, *place) for i, place in enumerate(edges + rest)]


@pytest.mark.parametrize("metric", ["planar", "haversine"])
@pytest.mark.parametrize("k", [1, 2, 7])
@pytest.mark.parametrize("max_miles", [None, 3.0])
def test_city(spark, metric, k, max_miles):
    rng = random.Random(k)
    found = check(spark, cloud(rng, 120, 0.6), cloud(rng, 300), k, max_miles, metric)
    assert max_miles is None or {len(v) for v in found.values()} >= {0, k}


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("max_miles", [None, 600.0, 20000.0])
def test_globe_with_date_line_and_poles(spark, k, max_miles):
    rng = random.Random(20 + k)
    check(spark, globe(rng, 150), globe(rng, 400), k, max_miles, "haversine", leaf_size=2)


def test_reach_with_planar_ranks_on_the_globe(spark):
    rng = random.Random(30)
    check(spark, globe(rng, 120), globe(rng, 400), 3, 700.0, "planar", leaf_size=2)


def test_metrics_choose_differently_in_the_north(spark):
    points, sites = [(0, 60.0, 10.0)], [(1, 61.0, 10.0), (2, 60.0, 11.5)]
    assert check(spark, points, sites, 1)[0][0][0] == 1
    assert check(spark, points, sites, 1, metric="haversine")[0][0][0] == 2


@pytest.mark.parametrize("metric", ["planar", "haversine"])
def test_ties_repeats_and_fewer_sites_than_wanted(spark, metric):
    sites = [(9, 40.0, -74.0), (3, 40.0, -74.0), (3, 40.0, -74.0), (5, 40.0, -74.0), (3, 41.0, -74.0)]
    points = [(0, 40.0, -74.0), (1, 40.0, -74.0), (2, None, -74.0), (3, 40.5, -74.0), (4, float("nan"), 0.0)]
    check(spark, points, sites, 3, None, metric)
    check(spark, points, sites, 50, None, metric)
    check(spark, points, [], 3, None, metric)
    check(spark, points, sites, 2, 1e-9, metric)


def test_many_sites_at_one_place(spark):
    sites = [(i, 40.0, -74.0) for i in range(500)] + [(1000 + i, 40.0 + i * 1e-4, -74.0) for i in range(1, 40)]
    check(spark, [(0, 40.0, -74.0), (1, 40.004, -74.0)], sites, 20)


def test_shuffled_joins(spark):
    rng = random.Random(31)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, globe(rng, 60), globe(rng, 300), 3, None, "haversine", leaf_size=4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_latitudes_that_do_not_exist(spark):
    p = spark.createDataFrame([(95.0, 0.0), (40.0, 0.0)], "lat double, lon double")
    s = spark.createDataFrame([(1, "a", 40.0, 0.0), (2, "b", 99.0, 0.0)], "site_id bigint, site_name string, lat double, lon double")
    assert {(r.lat, r.site_id) for r in nearest(p, s, metric="haversine").collect()} == {(95.0, None), (40.0, 1)}
    assert {(r.lat, r.site_id) for r in nearest(p, s).collect()} == {(95.0, 2), (40.0, 1)}


def test_wrong_arguments(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1.0)], "site_id bigint, site_name string, lat double, lon double")
    with pytest.raises(ValueError):
        nearest(df, df, k=0)
    with pytest.raises(KeyError):
        nearest(df, df, metric="taxi")


def test_bounds_hold_for_every_point_of_a_box(spark):
    """Boxes of all sizes, and a fine net of places in each."""
    rng = random.Random(33)
    rows = []
    for i in range(400):
        lat = sorted(rng.uniform(-90, 90) for _ in range(2))
        lon = sorted(rng.uniform(-180, 180) for _ in range(2))
        if i % 4 == 0:
            lat[1], lon[1] = min(90.0, lat[0] + 0.01), min(180.0, lon[0] + 0.01)
        rows.append((i, *lat, *lon, rng.uniform(-90, 90), rng.uniform(-180, 180)))
    df = spark.createDataFrame(rows, "i int, lat_lo double, lat_hi double, lon_lo double, lon_hi double, lat double, lon double")
    box = {c: F.col(c) for c in ("lat_lo", "lat_hi", "lon_lo", "lon_hi")}
    bounds = df.withColumn("bounds", great_circle_bounds(box, F.col("lat"), F.col("lon"))).select("*", "bounds.*")
    net = F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda j: j / 40))
    inner = bounds.withColumn("a", net).withColumn("b", net)
    y, x = (F.col(f"{c}_lo") + F.col(p) * (F.col(f"{c}_hi") - F.col(f"{c}_lo")) for c, p in (("lat", "a"), ("lon", "b")))
    far = inner.withColumn("far", haversine_miles(F.col("lat"), F.col("lon"), y, x))
    on = [F.min(F.when(F.col(c) == v, F.col("far"))).alias(f"{c}{v}") for c in "ab" for v in (0, 1)]
    worst = [F.max(F.when(F.col(c) == v, F.col("far"))).alias(f"w{c}{v}") for c in "ab" for v in (0, 1)]
    rows = far.groupBy("i", "least", "some", "most").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), *on, *worst).collect()
    for r in rows:
        assert r.least - 1e-4 <= r.lo and r.hi <= r.most + 1e-4
        # Whatever point each side holds, the nearest of them keeps the middle bound.
        assert min(r.wa0, r.wa1, r.wb0, r.wb1) <= r.some + 1e-4
        # The bounds are tight: the net comes near them.
        assert r.lo - r.least < 200 and r.most - r.hi < 200


@pytest.mark.parametrize("k, max_miles", [(1, None), (3, 1000.0)])
def test_great_circles_are_bounded_by_compiled_code_in_many_tasks(spark, tmp_path, k, max_miles):
    """A lambda for every cell of a place is interpreted, and few places in one file were work for one task."""
    p = spark.createDataFrame(globe(random.Random(5), 40), "pid int, lat double, lon double")
    s = spark.createDataFrame([(i, f"s{i}", y, x) for i, y, x in globe(random.Random(6), 60)], "site_id bigint, site_name string, lat double, lon double")
    plan = nearest(p, s, k=k, max_miles=max_miles, metric="haversine")._jdf.queryExecution().optimizedPlan().toString()
    assert "atan2" in plan.lower() and "lambda" not in plan.lower()
    assert "RepartitionByExpression [_place" in plan
