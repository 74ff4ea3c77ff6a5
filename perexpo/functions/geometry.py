"""Coordinate arithmetic and polygon tests on plain columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perexpo.functions.cleaning import as_col

EARTH_RADIUS_MILES = 3959.0
#: Named values: columns, or one column with them as fields.
Columns = dict[str, Column] | Column


def scaled(c: Column | str, digits: int = 5) -> Column:
    """Coordinate rounded to ``digits`` as a BIGINT, the form used in join and group keys.

    Equal keys compare exactly, which rounded doubles only do by luck. What is no finite
    number has no place, so its key is NULL.
    """
    c = as_col(c)
    steps = F.floor(F.abs(c) * F.lit(float(10**digits)) + 0.5).cast("bigint")
    finite = ~F.isnan(c.cast("double")) & (F.abs(c) < F.lit(float("inf")))
    return F.when(finite, F.when(c < 0, -steps).otherwise(steps))


def unscaled(c: Column | str, digits: int = 5) -> Column:
    return as_col(c).cast("double") / F.lit(float(10**digits))


def planar_d2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared difference in degrees: the metric candidates are ranked by."""
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance: the metric that is reported."""
    sin_lat = F.sin(F.radians(lat2 - lat1) / 2)
    sin_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lon * sin_lon
    return _miles(chord)


def _miles(chord: Column) -> Column:
    """Miles of a squared half chord, which rounding can put above 1 at the antipode."""
    half = F.sqrt(chord)
    return F.lit(2 * EARTH_RADIUS_MILES) * F.when(chord.isNotNull(), F.asin(F.least(half, F.lit(1.0))))


def bound_once(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of values that it uses several times, each worked out once."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body)[0]


def _sides(box: dict[str, Column], lat: Column, lon: Column) -> dict[str, Column]:
    """The point and the box in radians, longitudes as turns from the point's meridian."""

    def turned(x: Column) -> Column:
        return F.pmod(x, F.lit(360.0))

    def apart(x: Column) -> Column:
        return F.radians(F.abs(turned(x - lon + 180) - 180))

    width = box["lon_hi"] - box["lon_lo"]
    return {
        "own": F.radians(lat),
        "low": F.radians(box["lat_lo"]),
        "high": F.radians(box["lat_hi"]),
        "first": apart(box["lon_lo"]),
        "last": apart(box["lon_hi"]),
        "over": turned(lon - box["lon_lo"]) <= width,
        "opposite": turned(lon + 180 - box["lon_lo"]) <= width,
    }


def _turns(v: Columns) -> dict[str, Column]:
    return {
        "near": F.when(v["over"], F.lit(0.0)).otherwise(F.least(v["first"], v["last"])),
        "far": F.when(v["opposite"], F.lit(math.pi)).otherwise(F.greatest(v["first"], v["last"])),
    }


_TURNS = ("near", "far", "first", "last")


def _feet(v: Columns) -> dict[str, Column]:
    """Latitude of each meridian that is closest to the point, and what chords to it have in common."""
    feet = {f"foot_{t}": F.atan2(F.sin(v["own"]), F.cos(v["own"]) * F.cos(v[t])) for t in _TURNS}
    swings = {f"swing_{t}": F.cos(v["own"]) * F.sin(v[t] / 2) * F.sin(v[t] / 2) for t in _TURNS}
    return feet | swings


def _places(v: Columns) -> dict[str, Column]:
    """Latitudes at which the distance of a meridian can be least or most."""

    def held(at: Column) -> Column:
        return F.greatest(v["low"], F.least(v["high"], at))

    most = {f"{t}_{way}": held(v[f"foot_{t}"] + sign * math.pi) for t in _TURNS[1:] for way, sign in (("down", -1), ("up", 1))}
    return most | {"near_foot": held(v["foot_near"])}


def _measured(v: Columns) -> dict[str, Column]:
    def chord(at: Column, turn: str) -> Column:
        rise = F.sin((at - v["own"]) / 2)
        return rise * rise + F.cos(at) * v[f"swing_{turn}"]

    def most(turn: str) -> Column:
        return F.greatest(*[chord(v[at], turn) for at in ("low", "high", f"{turn}_down", f"{turn}_up")])

    least = F.least(*[chord(v[at], "near") for at in ("low", "high", "near_foot")])
    some = F.least(chord(v["low"], "far"), chord(v["high"], "far"), most("first"), most("last"))
    return {"least": _miles(least), "some": _miles(some), "most": _miles(most("far"))}


def rough_miles(box: dict[str, Column], lat: Column, lon: Column) -> Column:
    """A cheap lower bound of the great-circle miles to a box: to its latitudes, and to its closest meridian."""
    v = _sides(box, lat, lon)
    turn, own = _turns(v)["near"], v["own"]
    gap = F.greatest(v["low"] - own, own - v["high"], F.lit(0.0))
    # Of half a great circle that is a quarter turn away, the pole is closest.
    aside = F.when(turn < math.pi / 2, F.asin(F.cos(own) * F.sin(turn))).otherwise(math.pi / 2 - F.abs(own))
    return F.lit(EARTH_RADIUS_MILES) * F.greatest(gap, aside)


_STEPS = (_turns, _feet, _places, _measured)
_ENDS = ("least", "some", "most")


def great_circle_bounds(box: dict[str, Column], lat: Column, lon: Column) -> Column:
    """Great-circle miles from a point to what lies in a box of latitudes and longitudes.

    A struct of ``least``, of any point of the box, ``some``, which some point on the sides keeps if
    every side has a point, and ``most``, of any. Longitudes count around the globe, so boxes and
    points may lie on both sides of the date line. At one latitude, distance grows with the
    difference of longitudes; at one difference it is a cosine of the latitude, least where
    the great circle meets the meridian at a right angle.
    """

    def after(values: dict[str, Column], steps: Sequence[Callable[[Columns], dict[str, Column]]]) -> Column:
        if not steps:
            return F.struct(*[values[n].alias(n) for n in _ENDS])
        return bound_once(values, lambda v: after({n: v[n] for n in values} | steps[0](v), steps[1:]))

    return after(_sides(box, lat, lon), _STEPS)


def with_great_circle_bounds(df: DataFrame, box: dict[str, Column], lat: Column, lon: Column) -> DataFrame:
    """``df`` with ``least``, ``some`` and ``most`` of ``great_circle_bounds`` as columns.

    Each step is a projection of its own, which Spark compiles; a lambda is interpreted.
    """
    given, values = df.columns, _sides(box, lat, lon)
    known: dict[str, Column] = {}
    for step in (*_STEPS, None):
        df = df.withColumns({f"_gc_{n}": c for n, c in values.items()})
        known |= {n: F.col(f"_gc_{n}") for n in values}
        values = step(known) if step else {}
    return df.select(*given, *[known[n].alias(n) for n in _ENDS])


def ring_edges(rings: Column | str) -> Column:
    """All edges of a polygon as one array; the last point of a ring joins its first.

    Repeated points (a ring that is already closed) give no edge.
    """

    def of_ring(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        pairs = F.arrays_zip(ring.alias("a"), following.alias("b"))
        edges = F.transform(
            pairs,
            lambda p: F.struct(
                p["a"]["x"].alias("x1"),
                p["a"]["y"].alias("y1"),
                p["b"]["x"].alias("x2"),
                p["b"]["y"].alias("y2"),
            ),
        )
        return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))

    return F.flatten(F.transform(as_col(rings), of_ring))


def touches(x: Column, y: Column, e: Column | dict[str, Column]) -> Column:
    """Whether a point lies on an edge."""
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (
        (cross == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def crosses(x: Column, y: Column, e: Column | dict[str, Column]) -> Column:
    """Whether an edge crosses the line from a point to the right."""
    spans = (e["y1"] > y) != (e["y2"] > y)
    at = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
    return spans & (x < at)


def on_boundary(x: Column, y: Column, edges: Column) -> Column:
    return F.exists(edges, lambda e: touches(x, y, e))


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule over all edges, so holes and multi-part shapes need no special case.

    Points on the boundary are outside.
    """
    crossings = F.size(F.filter(edges, lambda e: crosses(x, y, e)))
    return (crossings % 2 == 1) & ~on_boundary(x, y, edges)
