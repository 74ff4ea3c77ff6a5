"""Polygons from text, and point-in-polygon from a table of edges."""

import json
import math
import random

import pytest
from test_zones import crossings, square

from perexpo.operators import zones
from perexpo.sources import polygons
from perexpo.sources.tables import ZONE_SCHEMA


def wkt_rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "zone_id int, wkt string")
    return {int(r.zone_id): ([[tuple(p) for p in ring] for ring in r.rings] if r.rings is not None else None, r.problem) for r in polygons.from_wkt(df).collect()}


BOX = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def test_well_known_text(spark):
    found = wkt_rows(
        spark,
        [
            "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))",
            "polygon((0 0,4 0,4 4,0 4,0 0),(1 1, 2 1, 2 2, 1 1))",
            " MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1)), ((9e0 9, 10.5 9, 9 -1e1)))",
            "SRID=4326; POLYGON Z ((0 0 7, 4 0 7, 4 4 7, 0 4 7, 0 0 7))",
            "POLYGON EMPTY",
            "POINT (1 2)",
            "",
            None,
            "POLYGON ((0 0, 4 0, x 4, 0 4))",
            "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0)",
            "POLYGON ((0 0, 1 1, 0 0))",
            "POLYGON ((0 0, 4 NaN, 4 4, 0 0))",
            "POLYGON ((0 0, 4, 4 4, 0 0))",
            "some words",
            "MULTIPOLYGON ((0 0, 4 0, 4 4, 0 0))",
        ],
    )
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)]
    assert found[0] == ([BOX], None) and found[1] == ([BOX, hole], None) and found[3] == ([BOX], None)
    assert found[2] == ([BOX, hole, [(9.0, 9.0), (10.5, 9.0), (9.0, -10.0)]], None)
    problems = [found[i][1] for i in range(4, 15)]
    assert problems == ["MISSING", "TYPE", "MISSING", "MISSING", "NUMBER", "UNREADABLE", "RING", "NUMBER", "NUMBER", "TYPE", "UNREADABLE"]
    assert all(found[i][0] is None for i in range(4, 15))


def feature(zone_id, kind, coordinates, **more):
    geometry = None if kind is None else {"type": kind, "coordinates": coordinates}
    return {"type": "Feature", "properties": {"zone_id": zone_id, "name": "x, y"}, "geometry": geometry, **more}


def features():
    closed = [list(p) for p in [*BOX, BOX[0]]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 1]]
    return [
        feature("a", "Polygon", [closed]),
        feature("b", "Polygon", [closed, hole]),
        feature("c", "MultiPolygon", [[closed, hole], [[[9, 9, 3], [10.5, 9, 3], [9, -10, 3], [9, 9, 3]]]], bbox=[0, 0, 1, 1]),
        feature("d", None, None),
        feature("e", "Point", [1, 2]),
        feature("f", "Polygon", []),
        feature("g", "Polygon", [[[0, 0], [1, None], [2, 2], [0, 0]]]),
        feature("h", "Polygon", [[[0, 0], [1, 1], [0, 0]]]),
        feature("i", "Polygon", {"x": 1}),
        feature(7, "Polygon", [closed]),
    ]


PROBLEMS = {"a": None, "b": None, "c": None, "d": "MISSING", "e": "TYPE", "f": "MISSING", "g": "NUMBER", "h": "RING", "i": "UNREADABLE", "7": None}


@pytest.mark.parametrize("lines", [True, False])
def test_geojson(spark, tmp_path, lines):
    rows = features()
    path = tmp_path / "zones.json"
    if lines:
        path.write_text("\n".join(json.dumps(f) for f in rows) + "\n\n{ broken\n" + json.dumps({"type": "Topology"}) + "\n")
    else:
        path.write_text(json.dumps({"type": "FeatureCollection", "features": rows}, indent=2))
    found = polygons.read_geojson(spark, str(path), lines=lines)
    named = {r.zone_id: r for r in found.collect() if r.zone_id is not None}
    assert {k: r.problem for k, r in named.items()} == PROBLEMS
    assert [tuple(p) for p in named["a"].rings[0]] == BOX
    assert [len(r) for r in named["c"].rings] == [4, 3, 3] and named["c"].rings[2][2] == (9.0, -10.0)
    counts = {r.problem: r.geometries for r in polygons.problem_counts(found).collect()}
    assert counts == {"OK": 4, "MISSING": 2, "TYPE": 1 + lines, "NUMBER": 1, "RING": 1, "UNREADABLE": 1 + lines}
    assert polygons.usable(found).count() == 4
    assert polygons.usable(found).schema == spark.createDataFrame([], ZONE_SCHEMA).schema


def test_round_trips(spark):
    shapes = [("00017", [square(0.1, 1 / 3, 4.0), square(1.0, 1.0, 2.0)]), ("x", [square(-1e-7, 1e12, 1.0), square(5.0, 1e12, 1.0)])]
    df = spark.createDataFrame(shapes, ZONE_SCHEMA)
    for text in (
        polygons.from_wkt(df.select("zone_id", polygons.wkt(df.rings).alias("wkt"))),
        polygons.from_geojson(df.select(polygons.geojson(df.zone_id, df.rings).alias("feature"))),
    ):
        assert sorted(polygons.usable(text).collect()) == sorted(df.collect())


def locate(spark, points, edges):
    p = spark.createDataFrame(points, "site_id bigint, lat double, lon double")
    rows = zones.pip_edges(p, edges).collect()
    out = {}
    for r in rows:
        out.setdefault(r.site_id, []).append(r.zone_id)
    assert {i for i, *_ in points} == set(out)
    return {i: sorted(z for z in v if z is not None) for i, v in out.items()}


def test_edges_with_holes_parts_and_boundaries(spark):
    shapes = {
        "hole": [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)],
        "parts": [square(10.0, 0.0, 1.0), square(12.0, 0.0, 1.0)],
        "neighbour": [square(4.0, 0.0, 2.0)],
        "over": [square(-1.0, -1.0, 30.0)],
    }
    points = [(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 0.5, 10.5), (4, 0.5, 12.5), (5, 0.5, 11.5), (6, 1.0, 4.0), (7, 0.0, 0.0)]
    points += [(8, 1.0, 2.0), (9, 50.0, 50.0), (10, None, 0.5), (11, float("nan"), 0.5), (12, 0.5, 0.5)]
    edges = zones.zone_edges(spark.createDataFrame(list(shapes.items()), ZONE_SCHEMA))
    assert locate(spark, points, edges) == {
        1: ["hole", "over"], 2: ["over"], 3: ["over", "parts"], 4: ["over", "parts"], 5: ["over"], 6: ["over"],
        7: ["over"], 8: ["over"], 9: [], 10: [], 11: [], 12: ["hole", "over"],
    }
    assert locate(spark, points[:3], edges.limit(0)) == {1: [], 2: [], 3: []}


def ring(n, radius, rng, x=0.0, y=0.0):
    """A star-shaped ring of n corners."""
    at = [2 * math.pi * i / n for i in range(n)]
    far = [radius * (0.7 + 0.3 * rng.random()) for _ in at]
    return [(x + r * math.cos(a), y + r * math.sin(a)) for a, r in zip(at, far, strict=True)]


def test_large_polygons_with_holes(spark):
    """50,000 corners, a hole of 20,000 and an island in it, against the plain even-odd rule."""
    rng = random.Random(5)
    shapes = {"large": [ring(50_000, 3.0, rng), ring(20_000, 1.5, rng), ring(3_000, 0.5, rng)], "small": [ring(40, 0.3, rng, 1.0, 1.0)]}
    points = [(i, rng.uniform(-3.2, 3.2), rng.uniform(-3.2, 3.2)) for i in range(300)]
    edges = zones.zone_edges(spark.createDataFrame(list(shapes.items()), ZONE_SCHEMA))
    wanted = {i: sorted(z for z, rings in shapes.items() if crossings(x, y, rings)) for i, y, x in points}
    assert locate(spark, points, edges) == wanted
    assert {len(v) for v in wanted.values()} == {0, 1, 2}


def test_edges_of_all_heights_and_rows_in_any_order(spark):
    """Spikes across the whole zone, flat edges, and one zone given in several rows."""
    rng = random.Random(6)
    teeth = [(x / 50, 5.0 if x % 2 else rng.random()) for x in range(1, 400)]
    outline = [(0.0, 0.0), *teeth, (8.0, 0.0)]
    parts = [[square(20.0 + i, 0.0, 0.5)] for i in range(5)]
    rows = [("teeth", [outline]), *[("parts", p) for p in parts]]
    edges = zones.zone_edges(spark.createDataFrame(rows, ZONE_SCHEMA)).repartition(7)
    points = [(i, rng.uniform(0, 5), rng.uniform(0, 25)) for i in range(400)]
    shapes = {"teeth": [outline], "parts": [p[0] for p in parts]}
    assert locate(spark, points, edges) == {i: sorted(z for z, r in shapes.items() if crossings(x, y, r)) for i, y, x in points}


def test_no_array_of_edges_in_the_probe_join(spark):
    df = spark.createDataFrame([("a", [square(0.0, 0.0, 4.0)])], ZONE_SCHEMA)
    points = spark.createDataFrame([(1, 1.0, 1.0)], "site_id bigint, lat double, lon double")
    found = zones.pip_edges(points, zones.zone_edges(df))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "edges#" not in plan and "rings#" not in plan and "x1" in plan


def test_edges_without_numbers_and_shuffled_joins(spark):
    edges = zones.zone_edges(spark.createDataFrame([("a", [square(0.0, 0.0, 4.0)])], ZONE_SCHEMA))
    odd = spark.createDataFrame([("a", float("nan"), 0.0, 1.0, 1.0), ("b", None, 0.0, 1.0, 1.0)], "zone_id string, x1 double, y1 double, x2 double, y2 double")
    every = edges.drop("edge_no").unionByName(odd)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert locate(spark, [(1, 1.0, 1.0), (2, 9.0, 9.0)], every) == {1: ["a"], 2: []}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
