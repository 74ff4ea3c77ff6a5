"""Point-in-polygon join and zone attributes.

A zone is indexed on the grid whose cells are just larger than the zone itself, so it
touches at most four cells whatever its size; a point probes one cell per grid in use.
Both become an equi-join on (level, cell), and the exact test runs only on zones whose
bounding box holds the point.

``pip_join`` takes the edges of a zone as one array, which suits zones of some hundred edges.
``pip_edges`` takes a table of edges and never puts those of a zone together: an edge is filed in
the horizontal slabs of its own height, a point looks into one slab for each height that
occurs in the zone, and what it crosses there adds up to the parity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perexpo.functions.cleaning import as_col, attribute_value, is_topcoded, strip_literal
from perexpo.functions.geometry import crosses, inside, ring_edges, touches
from perexpo.operators.nearest import best_per_key
from perexpo.sources.tables import materialize

# What the zone attribute source puts in front of ids and in its extra row.
ZONE_ID_PREFIX = "1400000US"
DESCRIPTION_ROW = "Geography"


def zone_edges(zones: DataFrame) -> DataFrame:
    """One row per polygon edge; the geometry is the only column read besides the id."""
    edges = zones.select("zone_id", F.posexplode(ring_edges("rings")).alias("edge_no", "e"))
    return edges.select("zone_id", "edge_no", "e.x1", "e.y1", "e.x2", "e.y2")


def _cell(c: Column | str, level: Column) -> Column:
    return F.floor(as_col(c) / F.pow(F.lit(2.0), level)).cast("bigint")


def _cover(zones: DataFrame) -> DataFrame:
    def bound(pick, axis: str) -> Column:
        return pick(F.transform("edges", lambda e: e[f"{axis}1"]))

    boxed = zones.select("zone_id", ring_edges("rings").alias("edges")).select(
        "zone_id",
        "edges",
        bound(F.array_min, "x").alias("x_lo"),
        bound(F.array_max, "x").alias("x_hi"),
        bound(F.array_min, "y").alias("y_lo"),
        bound(F.array_max, "y").alias("y_hi"),
    )
    span = F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo"))
    return boxed.where(span > 0).withColumn("level", F.ceil(F.log2(span)).cast("int"))


def pip_join(points: DataFrame, zones: DataFrame, how: str = "left") -> DataFrame:
    """Zone that contains each point; the boundary belongs to no zone.

    ``points`` has a unique ``site_id``, ``lat`` and ``lon``; ``zones`` has ``zone_id``
    and ``rings``. With ``left`` unmatched points are kept. A point in two overlapping
    zones comes back once for each.
    """
    cover = _cover(zones)
    x, y = F.col("lon"), F.col("lat")
    # One number per power of two between the smallest and the largest zone.
    levels = cover.agg(F.collect_set("level").alias("levels")).scalar()
    level = F.col("level")
    probe = points.select("site_id", "lat", "lon", F.explode(levels).alias("level")).select(
        "*", _cell(x, level).alias("cx"), _cell(y, level).alias("cy")
    )
    cells = (
        cover.withColumn("cx", F.explode(F.sequence(_cell("x_lo", level), _cell("x_hi", level))))
        .withColumn("cy", F.explode(F.sequence(_cell("y_lo", level), _cell("y_hi", level))))
    )
    hits = (
        probe.join(cells, ["level", "cx", "cy"])
        .where((x > F.col("x_lo")) & (x < F.col("x_hi")) & (y > F.col("y_lo")) & (y < F.col("y_hi")))
        .where(inside(x, y, F.col("edges")))
        .select("site_id", "zone_id")
    )
    return points.join(hits, "site_id", how)


#: Heights below 2 to this power, horizontal edges among them, share one level of slabs.
_LEAST_LEVEL = -40


def _level(height: Column) -> Column:
    """Power of two that is not below a height."""
    return F.greatest(F.ceil(F.log2(F.when(height > 0, height))), F.lit(_LEAST_LEVEL)).cast("int")


def _filed(edges: DataFrame) -> DataFrame:
    """Edges with the level of their height and their one or two slabs of it."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    level = F.coalesce(_level(high - low), F.lit(_LEAST_LEVEL))
    return edges.withColumn("edge_level", level).withColumn(
        "slab", F.explode(F.sequence(_cell(low, F.col("edge_level")), _cell(high, F.col("edge_level"))))
    )


def pip_edges(points: DataFrame, edges: DataFrame, how: str = "left") -> DataFrame:
    """Zone that contains each point, from a table of polygon edges; the boundary belongs to no zone.

    ``points`` has ``lat`` and ``lon``; ``edges`` has ``zone_id``, ``x1``, ``y1``, ``x2`` and ``y2``,
    as ``zone_edges`` gives them. Holes, parts, and rows of one zone in any order or place count by
    the even-odd rule. Adds ``zone_id``; with ``left`` points without a zone, and those without
    coordinates, are kept. Repeated points come back as often as they occur, a point in two
    overlapping zones once for each. Edges with a coordinate that is no finite number are an error
    of the source and count as none.
    """
    lat, lon = F.col("lat"), F.col("lon")
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    real = F.lit(True)
    for c in corners:
        real = real & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    lines = edges.where(real & ((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))))
    filed = materialize(_filed(lines.select("zone_id", *corners)), "edges")
    boxes = filed.groupBy("zone_id").agg(
        F.min(F.least("x1", "x2")).alias("x_lo"),
        F.max(F.greatest("x1", "x2")).alias("x_hi"),
        F.min(F.least("y1", "y2")).alias("y_lo"),
        F.max(F.greatest("y1", "y2")).alias("y_hi"),
        # As many numbers as there are powers of two among the heights.
        F.collect_set("edge_level").alias("edge_levels"),
    )
    span = F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo"))
    cover = materialize(boxes.where(span > 0).withColumn("level", _level(span)), "boxes")
    placed = F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) + F.abs(lon) < F.lit(float("inf"))), F.lit(False))
    places = materialize(
        points.where(placed).select("lat", "lon").distinct().withColumn("_place", F.monotonically_increasing_id()),
        "places",
    )
    levels = cover.agg(F.collect_set("level").alias("levels")).scalar()
    level = F.col("level")
    probe = places.select("_place", "lat", "lon", F.explode(levels).alias("level")).select(
        "*", _cell(lon, level).alias("cx"), _cell(lat, level).alias("cy")
    )
    cells = cover.withColumn("cx", F.explode(F.sequence(_cell("x_lo", level), _cell("x_hi", level)))).withColumn(
        "cy", F.explode(F.sequence(_cell("y_lo", level), _cell("y_hi", level)))
    )
    pairs = (
        probe.join(cells, ["level", "cx", "cy"])
        .where((lon > F.col("x_lo")) & (lon < F.col("x_hi")) & (lat > F.col("y_lo")) & (lat < F.col("y_hi")))
        .select("_place", "lat", "lon", "zone_id", F.explode("edge_levels").alias("edge_level"))
        .withColumn("slab", _cell(lat, F.col("edge_level")))
    )
    met = pairs.join(filed, ["zone_id", "edge_level", "slab"]).where(lat.between(F.least("y1", "y2"), F.greatest("y1", "y2")))
    edge = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    hits = (
        met.groupBy("_place", "zone_id")
        .agg(F.count_if(crosses(lon, lat, edge)).alias("crossed"), F.count_if(touches(lon, lat, edge)).alias("touched"))
        .where((F.col("crossed") % 2 == 1) & (F.col("touched") == 0))
    )
    found = places.join(hits, "_place").select(lat.alias("_lat"), lon.alias("_lon"), "zone_id")
    return points.join(found, (lat == F.col("_lat")) & (lon == F.col("_lon")), how).drop("_lat", "_lon")


def drop_rows(df: DataFrame, cond: Column) -> DataFrame:
    """Delete by predicate; rows for which it is unknown stay."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def clean_attributes(
    raw: DataFrame, prefix: str = ZONE_ID_PREFIX, description: str = DESCRIPTION_ROW
) -> DataFrame:
    """Zone attributes from text: id without prefix, number or NULL, open-end flag."""
    return drop_rows(raw, F.col("geo_id") == description).select(
        strip_literal("geo_id", prefix).alias("zone_id"),
        "name",
        "value",
        attribute_value("value").alias("attr"),
        is_topcoded("value").alias("topcoded"),
    )


def site_attributes(sites_in_zones: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attribute of the zone each site lies in; sites without one are kept."""
    return sites_in_zones.join(
        attributes.select("zone_id", "attr", "topcoded"), "zone_id", "left"
    ).select("site_id", "site_name", "zone_id", "attr", "topcoded")


def enrich(crosswalk: DataFrame, site_attr: DataFrame) -> DataFrame:
    """Attach the attribute of the assigned site; every cluster stays.

    A site in several zones takes the first of them by zone id, so that no cluster is
    counted twice. Clusters without a site can be many and would all meet in one task of the
    join, so they go around it.
    """
    attrs = best_per_key(site_attr.select("site_id", "zone_id", "attr", "topcoded"), ["site_id"], ["zone_id"])
    matched = crosswalk.where(F.col("site_id").isNotNull()).join(attrs, "site_id", "left")
    rest = crosswalk.where(F.col("site_id").isNull())
    return matched.unionByName(rest, allowMissingColumns=True)


def attribute_coverage(enriched: DataFrame) -> DataFrame:
    """Clusters and incidents with and without a usable attribute."""
    status = F.when(F.col("attr").isNotNull(), "HAS_ATTRIBUTE").otherwise("MISSING_ATTRIBUTE")
    return enriched.groupBy(status.alias("attr_status")).agg(
        F.count("*").alias("clusters"), F.sum("incidents").cast("bigint").alias("incidents")
    )
