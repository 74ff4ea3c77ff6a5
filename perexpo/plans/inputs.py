"""Incident, exposure, site and zone tables derived from the driver tables.

The driver tables have no places, so places are computed from ids with integer arithmetic
and single divisions, which any engine evaluates alike. Every row of the source tables
that carries the event types in question is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perexpo.functions.cleaning import clean_int


# Declared, so that planning does not start with a job that looks into the files.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def site_lat(u: Column) -> Column:
    return F.lit(40.5) + (u * 7919) % 4000 / F.lit(1e4)


def site_lon(u: Column) -> Column:
    return F.lit(-74.05) + (u * 104729) % 3000 / F.lit(1e4)


def site_name(u: Column) -> Column:
    """Site spelling: abbreviated words, line letters in parentheses, some without."""
    n = u.cast("string")
    line = F.concat(F.lit(" ("), (u % 9).cast("string"), F.lit(")"))
    return (
        F.when(u % 6 == 0, F.concat(n, F.lit(" St"), line))
        .when(u % 6 == 1, F.concat(n, F.lit(" Av"), line))
        .when(u % 6 == 2, F.concat(n, F.lit(" St-Oak Park"), line))
        .when(u % 6 == 3, F.concat(n, F.lit(" Av/Elm"), line))
        .when(u % 6 == 4, F.concat(F.lit("St. "), n, F.lit(" Blvd"), line))
        .otherwise(F.concat(n, F.lit(" Pkwy")))
    )


def incident_name(u: Column) -> Column:
    """Spelling of the same places in the incident source; offices, unknowns and names that
    several places share included."""
    n = u.cast("string")
    return (
        F.when(u % 50 == 49, None)
        .when(u % 25 == 24, F.concat(F.lit("DISTRICT "), n, F.lit(" OFFICE")))
        .when(u % 10 == 3, F.concat(F.lit("PLAZA "), (u % 3).cast("string")))
        .when(u % 6 == 0, F.concat(n, F.lit(" ST.")))
        .when(u % 6 == 1, F.concat(n, F.lit(" AVE.")))
        .when(u % 12 == 2, F.concat(n, F.lit(" ST.-OAK PARK")))
        .when(u % 12 == 8, F.concat(F.lit("OAK PARK-"), n, F.lit(" ST.")))
        .when(u % 6 == 3, F.concat(F.lit("ELM-"), n, F.lit(" AVE.")))
        .when(u % 6 == 4, F.concat(F.lit("ST. "), n, F.lit(" BLVD.")))
        .otherwise(F.concat(n, F.lit(" PKWY.")))
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident facts: text date and time, free-form name, scattered coordinates."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    u, i = F.col("user_id"), F.col("event_id")
    return e.select(
        F.date_format("ts", "MM/dd/yyyy").alias("dt"),
        F.when(i % 97 != 0, F.date_format("ts", "HH:mm:ss")).alias("tm"),
        incident_name(u).alias("name"),
        (site_lat(u) + (i % 5) * (i % 5 + 1) * F.lit(5e-4)).alias("lat"),
        site_lon(u).alias("lon"),
        (u % 12).cast("int").alias("district"),
    )


def exposure_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure facts as they arrive: 12-hour timestamps and numbers with separators, some as
    decimals and some missing."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase"))
    u, i = F.col("user_id"), F.col("event_id")
    number = F.format_number(F.floor(F.col("value") * 100).cast("bigint"), 0)
    return e.select(
        F.date_format("ts", "MM/dd/yyyy hh:mm:ss a").alias("ts"),
        u.alias("site_id"),
        site_name(u).alias("site_name"),
        F.concat(F.lit("R"), (u % 5).cast("string")).alias("region"),
        site_lat(u).alias("lat"),
        site_lon(u).alias("lon"),
        F.when(i % 89 == 0, F.concat(number, F.lit(".0"))).when(i % 101 != 0, number).alias("exposure"),
    )


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure_raw(spark, sf_dir).withColumn("exposure", clean_int("exposure"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site list of its own, for the zone join."""
    u = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        u.alias("site_id"), site_name(u).alias("site_name"), site_lat(u).alias("lat"), site_lon(u).alias("lon")
    )


def globe(spark: SparkSession, sf_dir: str, name: str, key: str, lat_step: int, lon_step: int) -> DataFrame:
    """Places all over the globe for the rows of a table, on both sides of the date line and at the poles."""
    u = F.col(key)
    return table(spark, sf_dir, name).select(
        key,
        (((u * lat_step) % 18001 - 9000) / F.lit(1e2)).alias("lat"),
        (((u * lon_step) % 36001 - 18000) / F.lit(1e2)).alias("lon"),
    )


def globe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per customer; every eighth lies at the date line, every eighth at a pole."""
    c = globe(spark, sf_dir, "customer", "c_custkey", 7919, 104729)
    k = F.col("c_custkey")
    return c.withColumns(
        {
            "lon": F.when(k % 8 == 3, F.when(k % 16 == 3, F.lit(179.99)).otherwise(F.lit(-179.99))).otherwise(F.col("lon")),
            "lat": F.when(k % 8 == 5, F.when(k % 16 == 5, F.lit(89.5)).otherwise(F.lit(-90.0))).otherwise(F.col("lat")),
        }
    )


def globe_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = globe(spark, sf_dir, "supplier", "s_suppkey", 5167, 30011)
    return s.select(F.col("s_suppkey").alias("site_id"), site_name(F.col("s_suppkey")).alias("site_name"), "lat", "lon")


def zone_id(k: Column) -> Column:
    return F.lpad(k.cast("string"), 5, "0")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per nation: triangles, rectangles with a hole, and rectangles."""
    k = F.col("n_nationkey")
    x0 = F.lit(-74.05) - F.lit(3.7e-5) + k % 5 * F.lit(6e-2)
    y0 = F.lit(40.5) - F.lit(3.7e-5) + F.floor(k / 5) * F.lit(8e-2)

    def at(dx: float, dy: float) -> Column:
        return F.struct((x0 + F.lit(dx)).alias("x"), (y0 + F.lit(dy)).alias("y"))

    box = F.array(at(0.0, 0.0), at(6e-2, 0.0), at(6e-2, 8e-2), at(0.0, 8e-2))
    hole = F.array(at(2e-2, 2e-2), at(4e-2, 2e-2), at(4e-2, 6e-2), at(2e-2, 6e-2))
    triangle = F.array(at(0.0, 0.0), at(6e-2, 0.0), at(0.0, 8e-2))
    rings = (
        F.when(k % 3 == 0, F.array(triangle)).when(k % 3 == 1, F.array(box, hole)).otherwise(F.array(box))
    )
    return table(spark, sf_dir, "nation").select(zone_id(k).alias("zone_id"), rings.alias("rings"))


def band_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of ragged bands with a hole, one row of 64 customers each; the last band may be shorter.

    Every customer gives its piece of the upper and the lower border, and of the hole's; the
    first and the last of a band, and of a hole, close it.
    """
    u = F.col("c_custkey")
    z, i = F.floor(u / 64).cast("bigint"), u % 64
    last = F.when(i == 63, F.lit(True)).otherwise(u == F.col("last"))
    x0 = F.lit(-74.05) - F.lit(3.7e-5) + z % 6 * F.lit(5e-2)
    y0 = F.lit(40.5) - F.lit(3.7e-5) + F.floor(z / 6) % 5 * F.lit(8e-2)

    def x(k: Column) -> Column:
        return x0 + k / F.lit(1280.0)

    def upper(k: Column) -> Column:
        return y0 + F.lit(6e-2) + (z * 31 + k * 7919) % 100 / F.lit(1e4)

    def lower(k: Column) -> Column:
        return y0 + (z * 17 + k * 104729) % 100 / F.lit(1e4)

    def edge(when: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return F.when(when, F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))

    always, hole = F.lit(True), (i >= 16) & (i < 48)
    low, high = y0 + F.lit(2e-2), y0 + F.lit(4e-2)
    pieces = F.array(
        edge(always, x(i), upper(i), x(i + 1), upper(i + 1)),
        edge(always, x(i), lower(i), x(i + 1), lower(i + 1)),
        edge(i == 0, x(i), lower(i), x(i), upper(i)),
        edge(last, x(i + 1), lower(i + 1), x(i + 1), upper(i + 1)),
        edge(hole, x(i), low, x(i + 1), low),
        edge(hole, x(i), high, x(i + 1), high),
        edge(i == 16, x(i), low, x(i), high),
        edge(hole & (last | (i == 47)), x(i + 1), low, x(i + 1), high),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    ended = customers.withColumn("last", customers.agg(F.max("c_custkey")).scalar())
    return ended.select(zone_id(z).alias("zone_id"), F.explode(F.filter(pieces, lambda e: e.isNotNull())).alias("e")).select(
        "zone_id", "e.*"
    )


def zone_attributes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone attribute as text: separators, open-ended and suppressed values, a header row."""
    k = F.col("c_nationkey")
    text = F.format_number(F.col("n") * 997 % 180000 + 30000, 0)
    rows = (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("n"))
        .select(
            F.concat(F.lit("1400000US"), zone_id(k)).alias("geo_id"),
            F.concat(F.lit("Zone "), k.cast("string")).alias("name"),
            F.when(k % 7 == 3, "-").when(k % 7 == 5, F.concat(text, F.lit("+"))).otherwise(text).alias("value"),
        )
    )
    header = spark.createDataFrame(
        [("Geography", "Geographic Area Name", "Estimate")], "geo_id STRING, name STRING, value STRING"
    )
    return rows.unionByName(header)
