"""Nearest sites of every point, exact, without pairing all points with all sites.

Sites are indexed by a pyramid of grid cells: each level halves a cell twice in each
direction, so it has at most 16 children, and every cell knows the tight bounding box of
its sites and how many it holds. A point walks down the pyramid, starting at the finest level that still
has no more than 64 cells. At each level it keeps the child cells whose box is not farther
away than sites it is sure of, and joins only those with the next level. What is left at the bottom are a few cells of a few sites
each, and the smallest (distance, site id) win. Boxes come from the sites, not from the
grid, so the grid affects speed only, never the result.

Each step is an equi-join on a cell number against a table with one row per cell, so a
cell that attracts a third of the points is an ordinary skewed join key with a single
match: adaptive execution splits it, and while the index is small the planner broadcasts
it by its measured size. The depth follows the densest cell, so crowded areas are split
further rather than scanned.

A metric tells how far a site is and between which bounds the sites of a box are: ``PLANAR``
compares degrees, ``HAVERSINE`` great circles, across the date line and around the poles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perexpo.functions.geometry import haversine_miles, planar_d2, rough_miles, with_great_circle_bounds
from perexpo.sources.tables import materialize

_BITS = 2
_DEPTH = 15
_SIDE = float(1 << (_BITS * _DEPTH))
_MAX_ROOT = 64
#: So many places at most go down the index in one task.
_PART_PLACES = 1 << 13
_BOX = ("lat_lo", "lat_hi", "lon_lo", "lon_hi")
#: Miles by which bounds of great circles may be off: near the antipode the sine is flat.
_SLACK = 1e-3


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order.

    An aggregate of one struct instead of a ranking window: it combines map-side, so a
    key with many rows is down to one row per task before the shuffle. A struct has no fixed
    width, so each task sorts its rows by key for it.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    picked = df.groupBy(*keys).agg(F.min(row).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*order, *rest]])


def _has_point(lat: Column, lon: Column, globe: bool = False) -> Column:
    """Whether both coordinates are finite numbers, on a globe with a latitude that exists; never NULL."""
    finite = F.abs(lat) <= 90 if globe else F.lit(True)
    for c in (lat, lon):
        finite = finite & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(finite, F.lit(False))


def _step(fraction: Column) -> Column:
    """Grid line below a coordinate; what lies outside the grid goes to its border."""
    inner = F.least(F.greatest(fraction * _SIDE, F.lit(0.0)), F.lit(_SIDE - 1))
    return inner.cast("bigint")


def _cell(level: int) -> Column:
    shift = _BITS * (_DEPTH - level)
    return F.shiftright("gx", shift) * F.lit(1 << (_BITS * _DEPTH + 1)) + F.shiftright("gy", shift)


def _gridded(df: DataFrame, lat: Column, lon: Column) -> DataFrame:
    return df.withColumn("gx", _step((lon + 180) / 360)).withColumn("gy", _step((lat + 90) / 360))


def _boxes(grid: DataFrame, *keys: Column | str) -> DataFrame:
    """Non-empty cells, each with the tight bounding box and the number of its sites."""
    return grid.groupBy(*keys).agg(
        F.min("site_lat").alias("lat_lo"),
        F.max("site_lat").alias("lat_hi"),
        F.min("site_lon").alias("lon_lo"),
        F.max("site_lon").alias("lon_hi"),
        F.sum("n_sites").alias("n_sites"),
    )


_BOUNDS = ("lower", "some", "every")


def _planar_bounds(cand: DataFrame, lat: Column, lon: Column) -> DataFrame:
    """A cell is no closer than its box. Every side of the box touches a site, so the nearer
    side plus the farther corner of it bounds the distance of some site from above."""

    def gap(lo: str, hi: str, v: Column) -> Column:
        away = F.greatest(F.col(lo) - v, v - F.col(hi), F.lit(0.0))
        return away * away

    def ends(lo: str, hi: str, v: Column) -> tuple[Column, Column]:
        a, b = (v - F.col(lo)) * (v - F.col(lo)), (v - F.col(hi)) * (v - F.col(hi))
        return F.least(a, b), F.greatest(a, b)

    (y_near, y_far), (x_near, x_far) = ends("lat_lo", "lat_hi", lat), ends("lon_lo", "lon_hi", lon)
    lower = gap("lat_lo", "lat_hi", lat) + gap("lon_lo", "lon_hi", lon)
    return cand.withColumns({"lower": lower, "some": F.least(y_near + x_far, y_far + x_near), "every": y_far + x_far})


def _round_bounds(cand: DataFrame, lat: Column, lon: Column) -> DataFrame:
    found = with_great_circle_bounds(cand, {name: F.col(name) for name in _BOX}, lat, lon)
    slack = ((F.col("least") - _SLACK), (F.col("some") + _SLACK), (F.col("most") + _SLACK))
    return found.select(*cand.columns, *[c.alias(n) for n, c in zip(_BOUNDS, slack, strict=True)])


def _round_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.round(haversine_miles(lat1, lon1, lat2, lon2), 6)


@dataclass(frozen=True)
class Metric:
    """What sites are ranked by, and its bounds for the sites of a box, as columns beside those of the box.

    They are the least distance of any site (``lower``), one that some site keeps and one that every site keeps.
    """

    distance: Callable[[Column, Column, Column, Column], Column]
    bounds: Callable[[DataFrame, Column, Column], DataFrame]


#: Squared difference in degrees, and great-circle miles, in which distances that agree to six places tie.
PLANAR = Metric(planar_d2, _planar_bounds)
HAVERSINE = Metric(_round_distance, _round_bounds)
METRICS = {"planar": PLANAR, "haversine": HAVERSINE}


@dataclass(frozen=True)
class _Search:
    """One search: how many sites a point gets, by what, and how far they may be."""

    metric: Metric
    k: int
    max_miles: float | None

    def judged(self, cand: DataFrame, lat: Column, lon: Column) -> DataFrame:
        """Of each box: whether it is in reach, its least distance, one that is kept, and how many sites keep that."""
        given = [c for c in cand.columns if c not in (*_BOX, "n_sites")]
        found = self.metric.bounds(cand, lat, lon)
        upper, sure = (F.col("some"), F.lit(1).cast("bigint")) if self.k == 1 else (F.col("every"), F.col("n_sites"))
        reach = F.lit(True)
        if self.max_miles is not None:
            # Only sites that are surely within reach may rule out others.
            if self.metric is HAVERSINE:
                near = {n: F.col(n) for n in ("lower", "every")}
            else:
                found = found.withColumnsRenamed({n: f"_{n}" for n in _BOUNDS})
                found = HAVERSINE.bounds(found, lat, lon).withColumnsRenamed({n: f"near_{n}" for n in _BOUNDS})
                found = found.withColumnsRenamed({f"_{n}": n for n in _BOUNDS})
                near = {n: F.col(f"near_{n}") for n in ("lower", "every")}
            reach = near["lower"] <= self.max_miles
            sure = F.when(near["every"] <= self.max_miles, sure).otherwise(F.lit(0).cast("bigint"))
        return found.select(*given, reach.alias("reach"), "lower", upper.alias("upper"), sure.alias("sure"))

    def seeded(self, start: DataFrame, grid: DataFrame, levels: Sequence[int], lat: Column, lon: Column) -> DataFrame:
        """``start`` with ``bound``: what ``k`` sites of one of the cells that a place itself lies in surely keep.

        So a place goes down with a bound as small as the sites around it are dense, instead of finding one on its way.
        """

        def in_cells(df: DataFrame, *kept: str) -> DataFrame:
            cells = F.array(*[F.struct(F.lit(level).alias("level"), _cell(level).alias("cell")) for level in levels])
            return df.select(*kept, F.explode(cells).alias("_at")).select(*kept, "_at.*")

        index = _boxes(in_cells(grid, "site_lat", "site_lon", "n_sites"), "level", "cell").where(F.col("n_sites") >= self.k)
        own = in_cells(_gridded(start, lat, lon), *start.columns).join(index, ["level", "cell"], "left")
        sure = F.when(F.col("reach") & (F.col("sure") >= self.k), F.col("upper"))
        rest = [c for c in start.columns if c != "_place"]
        return (
            self.judged(own, lat, lon)
            .groupBy("_place")
            .agg(*[F.first(c).alias(c) for c in rest], F.coalesce(F.min(sure), F.lit(float("inf"))).alias("bound"))
            .select(*start.columns, "bound")
        )

    def roughly(self, cand: DataFrame, lat: Column, lon: Column) -> DataFrame:
        """Without cells that a cheap bound rules out already."""
        limits = [F.lit(self.max_miles)] if self.max_miles is not None else []
        limits += [F.col("bound")] if self.metric is HAVERSINE else []
        if not limits:
            return cand
        most = F.least(*limits) if len(limits) > 1 else limits[0]
        return cand.where(rough_miles({name: F.col(name) for name in _BOX}, lat, lon) - _SLACK <= most)

    def narrow(self, cand: DataFrame, place: Sequence[str], lat: Column, lon: Column) -> DataFrame:
        """Keep the candidate cells of each place that may hold a wanted site.

        What the others have to beat is the smallest distance that ``k`` sites of all
        candidates of the place, of this and of earlier levels, surely keep.
        """
        cand = self.judged(self.roughly(cand, lat, lon).select(*place, "bound", "cell", *_BOX, "n_sites"), lat, lon).where("reach")
        if self.k == 1 and self.max_miles is None:
            best = F.min("upper").over(Window.partitionBy("_place"))
        elif self.k == 1:
            best = F.min(F.when(F.col("sure") > 0, F.col("upper"))).over(Window.partitionBy("_place"))
        else:
            so_far = Window.partitionBy("_place").orderBy("upper").rowsBetween(Window.unboundedPreceding, 0)
            cand = cand.withColumn("so_far", F.sum("sure").over(so_far))
            best = F.min(F.when(F.col("so_far") >= self.k, F.col("upper"))).over(Window.partitionBy("_place"))
        return (
            cand.withColumn("bound", F.least("bound", F.coalesce(best, F.lit(float("inf")))))
            .where(F.col("lower") <= F.col("bound"))
            .select(*place, "bound", "cell")
        )


def _site_grid(sites: DataFrame, keep: Sequence[str], k: int, globe: bool) -> DataFrame:
    """(site_lat, site_lon, at, n_sites, gx, gy): different places of sites, each with its first ``k`` by id."""
    lat, lon = F.col("lat"), F.col("lon")
    known = sites.where(_has_point(lat, lon, globe))
    if k == 1:
        places = known.groupBy(lat.alias("site_lat"), lon.alias("site_lon")).agg(F.min(F.struct("site_id", *keep)).alias("site"))
        places = places.select("site_lat", "site_lon", F.array("site").alias("at"))
    else:
        single = known.groupBy(lat.alias("site_lat"), lon.alias("site_lon"), "site_id").agg(F.min(F.struct("site_id", *keep)).alias("site"))
        turn = F.row_number().over(Window.partitionBy("site_lat", "site_lon").orderBy("site_id"))
        first = single.withColumn("turn", turn).where(F.col("turn") <= k)
        places = first.groupBy("site_lat", "site_lon").agg(F.collect_list("site").alias("at"))
    return _gridded(places.withColumn("n_sites", F.size("at").cast("bigint")), F.col("site_lat"), F.col("site_lon"))


def nearest(
    points: DataFrame,
    sites: DataFrame,
    keep: Sequence[str] = ("site_name",),
    leaf_size: int = 16,
    k: int = 1,
    max_miles: float | None = None,
    metric: str = "planar",
) -> DataFrame:
    """The ``k`` closest sites of each point, ties by ``site_id``.

    ``points`` has ``lat`` and ``lon``; ``sites`` has ``site_id``, ``lat``, ``lon`` and the
    ``keep`` columns. ``metric`` is what sites are ranked by: ``planar`` or ``haversine``. With
    ``max_miles`` only sites within these great-circle miles count. All points come back,
    repeated rows as often as they occur; one without coordinates (great circles also need a latitude within 90 degrees), or without a site in reach, gets one
    row without a site. Adds ``site_id``, the kept columns, ``site_lat``, ``site_lon``,
    ``distance_miles`` and, if ``k`` is above 1, ``site_rank`` from 1. Where there are fewer
    sites than ``k``, fewer rows come back. Rows of one site id at one place count as one site.

    Different places walk down the index, each under a number, so many points at one place
    cost one walk, and the steps carry and compare one integer instead of the point's columns.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    search = _Search(METRICS[metric], k, max_miles)
    lat, lon = F.col("lat"), F.col("lon")
    globe = metric == "haversine" or max_miles is not None
    placed = _has_point(lat, lon, globe)
    point_cols = points.columns
    # The site list is usually distilled from a large fact table: write it once.
    grid = materialize(_site_grid(sites, keep, k, globe), "sites")
    # Cells and densest cell per level: sixteen rows, whatever the number of sites.
    occupancy = {
        r["level"]: r
        for r in grid.select(F.posexplode(F.array(*[_cell(i) for i in range(_DEPTH + 1)])).alias("level", "cell"))
        .groupBy("level", "cell")
        .count()
        .groupBy("level")
        .agg(F.count("*").alias("cells"), F.max("count").alias("densest"))
        .collect()
    }
    top = max((i for i, r in occupancy.items() if r["cells"] <= _MAX_ROOT), default=0)
    depth = min((i for i, r in occupancy.items() if i >= top and r["densest"] <= leaf_size), default=_DEPTH if occupancy else top)

    places = materialize(
        points.where(placed)
        .select("lat", "lon")
        .distinct()
        .withColumn("_place", F.monotonically_increasing_id()),
        "places",
    )
    place = ["_place", "lat", "lon"]
    root = _boxes(grid, _cell(top).alias("cell")).agg(F.collect_list(F.struct("cell", *_BOX, "n_sites")).alias("cells"))
    # A place becomes many rows, so few places are work for many tasks. They stay in their part while the index is broadcast.
    settled = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(settled, -(-places.count() // _PART_PLACES))
    start = search.seeded(places.select(*place).repartition(parts, "_place"), grid, range(top, depth + 1), lat, lon)
    first = start.withColumn("_cells", root.scalar()).select(*start.columns, F.explode("_cells").alias("_cell"))
    cand = search.narrow(first.select(*start.columns, "_cell.*"), place, lat, lon)
    for level in range(top + 1, depth + 1):
        below = _boxes(grid, _cell(level - 1).alias("parent"), _cell(level).alias("cell"))
        cand = search.narrow(cand.withColumnRenamed("cell", "parent").join(below, "parent"), place, lat, lon)

    leaf = grid.select(_cell(depth).alias("cell"), "at", "site_lat", "site_lon")
    near = cand.join(leaf, "cell").withColumn("far", search.metric.distance(lat, lon, F.col("site_lat"), F.col("site_lon")))
    if max_miles is not None:
        near = near.where(haversine_miles(lat, lon, F.col("site_lat"), F.col("site_lon")) <= max_miles)
    if k == 1:
        # The first site of a place has its smallest id.
        hit = F.struct("far", F.col("at")[0].alias("site"), "site_lat", "site_lon")
        found = near.groupBy("_place").agg(F.min(hit).alias("hit")).withColumn("site_rank", F.lit(1))
    else:
        single = near.select("_place", "far", "site_lat", "site_lon", F.explode("at").alias("site"))
        turn = F.row_number().over(Window.partitionBy("_place").orderBy("far", "site.site_id", "site_lat", "site_lon"))
        found = single.withColumn("site_rank", turn).where(F.col("site_rank") <= k)
        found = found.select("_place", "site_rank", F.struct("site", "site_lat", "site_lon").alias("hit"))
    # Back to the points by their place; a place that a third of them share is a skewed key with few matches.
    where = places.join(found, "_place", "left").select(
        F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "hit", "site_rank"
    )
    located = points.where(placed).join(where, (lat == F.col("_lat")) & (lon == F.col("_lon")), "left")
    every = located.drop("_lat", "_lon").unionByName(points.where(~placed), allowMissingColumns=True)
    return every.select(
        *point_cols,
        *[F.col(f"hit.site.{c}").alias(c) for c in ("site_id", *keep)],
        F.col("hit.site_lat").alias("site_lat"),
        F.col("hit.site_lon").alias("site_lon"),
        haversine_miles(lat, lon, F.col("hit.site_lat"), F.col("hit.site_lon")).alias("distance_miles"),
        *(["site_rank"] if k > 1 else []),
    )
