import random

from pyspark.sql import functions as F

from perexpo.operators import zones
from perexpo.sources.tables import ZONE_ATTRIBUTE_SCHEMA, ZONE_SCHEMA


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]


def crossings(x, y, rings):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                n += 1
    return n % 2 == 1


def locate(spark, points, shapes):
    p = spark.createDataFrame(points, "site_id bigint, lat double, lon double")
    z = spark.createDataFrame(list(shapes.items()), ZONE_SCHEMA)
    out = {}
    for r in zones.pip_join(p, z).collect():
        out.setdefault(r.site_id, set())
        if r.zone_id is not None:
            out[r.site_id].add(r.zone_id)
    return out


def test_holes_parts_and_boundaries(spark):
    shapes = {
        "hole": [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)],
        "parts": [square(10.0, 0.0, 1.0), square(12.0, 0.0, 1.0)],
        "neighbour": [square(4.0, 0.0, 2.0)],
        "closed": [square(20.0, 0.0, 1.0) + [(20.0, 0.0)]],
    }
    points = [
        (1, 0.5, 0.5),  # in the ring
        (2, 2.0, 2.0),  # in the hole
        (3, 0.5, 10.5),  # first part
        (4, 0.5, 12.5),  # second part
        (5, 0.5, 11.5),  # between the parts
        (6, 1.0, 4.0),  # on a shared edge
        (7, 0.0, 0.0),  # on a vertex
        (8, 1.0, 2.0),  # on the edge of the hole
        (9, 50.0, 50.0),
        (10, 0.5, 20.5),
        (11, None, 0.5),
    ]
    got = locate(spark, points, shapes)
    assert got == {
        1: {"hole"}, 2: set(), 3: {"parts"}, 4: {"parts"}, 5: set(), 6: set(),
        7: set(), 8: set(), 9: set(), 10: {"closed"}, 11: set(),
    }


def test_zones_of_very_different_size(spark):
    rng = random.Random(1)
    shapes = {"world": [square(-100.0, -50.0, 200.0)]}
    for i in range(60):
        size = rng.choice([0.01, 0.3, 2.0, 17.0])
        x, y = rng.uniform(-90, 90), rng.uniform(-40, 40)
        corners = [(x + rng.random() * size, y + rng.random() * size) for _ in range(rng.randint(3, 7))]
        shapes[f"z{i}"] = [corners]
    points = [(i, rng.uniform(-45, 45), rng.uniform(-95, 95)) for i in range(150)]
    for i, ring in enumerate(list(shapes.values())[1:41]):  # points inside small zones too
        xs, ys = zip(*ring[0])
        points.append((200 + i, sum(ys) / len(ys), sum(xs) / len(xs)))
    got = locate(spark, points, shapes)
    assert got == {i: {k for k, s in shapes.items() if crossings(x, y, s)} for i, y, x in points}


def test_no_zones(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "site_id bigint, lat double, lon double")
    z = spark.createDataFrame([], ZONE_SCHEMA)
    assert zones.pip_join(p, z).select("zone_id").first()[0] is None


def test_zone_edges(spark):
    z = spark.createDataFrame([("a", [square(0.0, 0.0, 1.0) + [(0.0, 0.0)]])], ZONE_SCHEMA)
    edges = zones.zone_edges(z).orderBy("edge_no").collect()
    assert len(edges) == 4
    assert (edges[3].x2, edges[3].y2) == (0.0, 0.0)


def test_attributes(spark):
    raw = spark.createDataFrame(
        [("Geography", "Name", "Estimate"), ("1400000US00012", "Z", "250,000+"), ("1400000US00013", "Y", "-"), (None, "X", "1")],
        ZONE_ATTRIBUTE_SCHEMA,
    )
    rows = {r.name: r for r in zones.clean_attributes(raw).collect()}
    assert set(rows) == {"X", "Y", "Z"}
    assert (rows["Z"].zone_id, rows["Z"].attr, rows["Z"].topcoded) == ("00012", 250000.0, True)
    assert (rows["Y"].attr, rows["Y"].topcoded) == (None, False)


def test_enrich_keeps_unassigned_clusters(spark):
    crosswalk = spark.createDataFrame([("a", 1, 5), ("b", None, 2), ("c", 9, 1)], "name string, site_id bigint, incidents bigint")
    attrs = spark.createDataFrame([(1, "z", 10.0, False)], "site_id bigint, zone_id string, attr double, topcoded boolean")
    done = zones.enrich(crosswalk, attrs)
    assert {r.name: r.attr for r in done.collect()} == {"a": 10.0, "b": None, "c": None}
    cover = {r.attr_status: (r.clusters, r.incidents) for r in zones.attribute_coverage(done).collect()}
    assert cover == {"HAS_ATTRIBUTE": (1, 5), "MISSING_ATTRIBUTE": (2, 3)}


def test_drop_rows_keeps_unknown(spark):
    df = spark.createDataFrame([("x",), (None,), ("y",)], "a string")
    assert zones.drop_rows(df, F.col("a") == "x").count() == 2
