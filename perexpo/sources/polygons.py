"""Polygon tables from text: GeoJSON features and well-known text.

Both become rows of ``ZONE_SCHEMA``: an id and a flat list of rings. Parts and holes need no
marks of their own, because the even-odd rule tells inside from outside. A ring is kept without
the closing repeat of its first point. Text is read by built-in parsers with a declared
shape; a geometry that cannot be used is kept with the reason in ``problem``, so it can be counted.

A geometry has one problem at most, the first of: ``MISSING`` (no geometry or an empty one),
``TYPE`` (not a polygon or multipolygon), ``UNREADABLE`` (coordinates do not parse), ``NUMBER`` (one
that is missing, infinite or no number) and ``RING`` (fewer than three different points in a row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING, TYPE, UNREADABLE, NUMBER, RING = "MISSING", "TYPE", "UNREADABLE", "NUMBER", "RING"
PROBLEMS = (MISSING, TYPE, UNREADABLE, NUMBER, RING)

_RING = "array<array<double>>"
_RINGS = "array<array<struct<x: double, y: double>>>"
_FEATURE = "type STRING, properties MAP<STRING, STRING>, geometry STRUCT<type: STRING, coordinates: STRING>"
_COLLECTION = (
    "type STRING, features ARRAY<STRUCT<type: STRING, properties: MAP<STRING, STRING>, "
    "geometry: STRUCT<type: STRING, coordinates: STRING>>>"
)


def _points(ring: Column) -> Column:
    """Points of a ring of number lists, without the closing repeat; further numbers (heights) are left out."""
    points = F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    closed = (F.size(points) > 1) & F.coalesce(F.get(points, F.lit(0)) == F.get(points, F.size(points) - 1), F.lit(False))
    return F.when(closed, F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)


def _is_number(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def _checked(df: DataFrame, kind: Column, lists: Column, empty: Column, keep: list[Column], first: Column) -> DataFrame:
    """``keep``, ``rings`` and ``problem`` from the kind of a geometry and its rings as lists of number lists.

    ``first`` is a problem that comes before all others, or null.
    """
    rings = F.transform("_lists", _points)
    numbers = F.forall("_rings", lambda r: F.forall(r, lambda p: _is_number(p["x"]) & _is_number(p["y"])))
    shaped = F.forall("_rings", lambda r: F.size(F.array_distinct(r)) >= 3)
    read = df.select(*keep, kind.alias("_kind"), empty.alias("_empty"), lists.alias("_lists"), first.alias("_first"))
    read = read.withColumn("_rings", rings)
    names = [c for c in read.columns if c not in ("_kind", "_empty", "_lists", "_first", "_rings")]
    problem = (
        F.when(F.col("_first").isNotNull(), F.col("_first"))
        .when(F.col("_kind").isNull() | F.col("_empty"), MISSING)
        .when(~F.col("_kind").isin("POLYGON", "MULTIPOLYGON"), TYPE)
        .when(F.col("_rings").isNull() | F.exists("_rings", lambda r: r.isNull()), UNREADABLE)
        .when(F.size("_rings") == 0, MISSING)
        .when(~numbers, NUMBER)
        .when(~shaped, RING)
    )
    return read.select(*names, problem.alias("problem"), F.col("_rings").cast(_RINGS).alias("_r")).select(
        *names, F.when(F.col("problem").isNull(), F.col("_r")).alias("rings"), "problem"
    )


def _of_features(df: DataFrame, f: Column, id_property: str) -> DataFrame:
    kind, text = F.upper(f["geometry"]["type"]), f["geometry"]["coordinates"]
    several = F.flatten(F.from_json(text, f"array<array<{_RING}>>"))
    lists = F.when(kind == "MULTIPOLYGON", several).when(kind == "POLYGON", F.from_json(text, f"array<{_RING}>"))
    empty = text.isNull() | (F.regexp_replace(text, r"\s", "") == "[]")
    first = F.when(f["type"].isNull(), UNREADABLE).when(f["type"] != "Feature", TYPE)
    return _checked(df, kind, lists, empty, [f["properties"][id_property].alias("zone_id")], first)


def from_geojson(df: DataFrame, feature: str = "feature", id_property: str = "zone_id") -> DataFrame:
    """(zone_id, rings, problem) of a column of features as text; the id is one of the feature's properties."""
    parsed = df.select(F.from_json(F.col(f"`{feature}`"), _FEATURE).alias("f"))
    return _of_features(parsed, F.col("f"), id_property)


def read_geojson(spark: SparkSession, path: str, id_property: str = "zone_id", lines: bool = True) -> DataFrame:
    """(zone_id, rings, problem) of GeoJSON files.

    With ``lines`` a file holds one feature a line and is split among tasks. Without, a
    file is one feature collection, read by one task and dealt out by feature.
    """
    if lines:
        return from_geojson(spark.read.text(path).where(F.trim("value") != ""), "value", id_property)
    whole = spark.read.schema(_COLLECTION).option("multiLine", True).json(path)
    rows = whole.select(F.explode_outer("features").alias("f"))
    return _of_features(rows, F.col("f"), id_property)


def from_wkt(df: DataFrame, wkt: str = "wkt", zone_id: str = "zone_id") -> DataFrame:
    """(zone_id, rings, problem) of a column of well-known text; heights and a leading SRID are left out."""
    text = F.upper(F.trim(F.regexp_replace(F.col(f"`{wkt}`"), r"(?i)^\s*SRID\s*=\s*\d+\s*;", "")))
    kind = F.regexp_extract(text, r"^([A-Z]+)(\s+(Z|M|ZM))?\s*(\(|EMPTY)", 1)
    body = F.regexp_replace(text, r"^[A-Z]+(\s+(Z|M|ZM))?\s*", "")
    # The innermost parentheses are the rings, of one polygon or of several.
    rings = F.regexp_extract_all(body, F.lit(r"\(([^()]*)\)"), F.lit(1))
    lists = F.transform(
        rings,
        lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), lambda p: F.transform(F.split(p, r"\s+"), lambda v: v.try_cast("double"))),
    )
    # What is left of a readable text without its rings' content: parentheses that match, and commas.
    shape = F.regexp_replace(F.regexp_replace(body, r"\([^()]*\)", "r"), r"\s", "")
    single, several = r"^\(r(,r)*\)$", r"^\(\(r(,r)*\)(,\(r(,r)*\))*\)$"
    fits = F.when(kind == "MULTIPOLYGON", shape.rlike(several)).otherwise(shape.rlike(single))
    known = F.when(F.length(kind) > 0, kind).when(F.length(text) > 0, F.lit("?"))
    return _checked(df, known, F.when(fits, lists), body == "EMPTY", [F.col(f"`{zone_id}`").cast("string").alias("zone_id")], F.lit(None))


def usable(zones: DataFrame) -> DataFrame:
    """Zones without a problem, as ``ZONE_SCHEMA``."""
    return zones.where(F.col("problem").isNull()).select("zone_id", "rings")


def problem_counts(zones: DataFrame) -> DataFrame:
    """Number of geometries by problem; those without one are ``OK``."""
    return zones.groupBy(F.coalesce("problem", F.lit("OK")).alias("problem")).agg(F.count("*").alias("geometries"))


def _closed(ring: Column) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


def wkt(rings: Column) -> Column:
    """Well-known text of a zone: one polygon, whose rings count by the even-odd rule."""

    def of_ring(ring: Column) -> Column:
        return F.concat(
            F.lit("("),
            F.array_join(F.transform(_closed(ring), lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "),
            F.lit(")"),
        )

    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, of_ring), ", "), F.lit(")"))


def geojson(zone_id: Column, rings: Column) -> Column:
    """A zone as a GeoJSON feature, one line of text."""
    coordinates = F.transform(rings, lambda r: F.transform(_closed(r), lambda p: F.array(p["x"], p["y"])))
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(zone_id.alias("zone_id")).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        )
    )
