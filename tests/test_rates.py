import pytest
from pyspark.sql import functions as F

from perexpo.operators import rates, views

EXPOSURE = "ts string, site_id bigint, site_name string, lat double, lon double, exposure bigint"


def facts(spark):
    exposure = spark.createDataFrame(
        [
            ("01/01/2025 07:00:00 AM", 1, "S1", 40.0, -74.0, 100),
            ("01/01/2025 08:00:00 AM", 1, "S1", 40.0, -74.0, 300),
            ("01/01/2025 11:00:00 PM", 1, "S1", 40.0, -74.0, 50),
            ("01/01/2025 07:00:00 AM", 2, "S2", 41.0, -74.0, 0),
            ("garbage", 2, "S2", 41.0, -74.0, 10),
        ],
        EXPOSURE,
    )
    incidents = spark.createDataFrame(
        [("09:00:00", "A", 40.0, -74.0), ("9:30:00", "A", 40.0, -74.0), ("23:00:00", "A", 40.0, -74.0), ("08:00:00", "Z", 1.0, 1.0), (None, "A", 40.0, -74.0)],
        "tm string, name string, lat double, lon double",
    )
    crosswalk = spark.createDataFrame(
        [("A", 4000000, -7400000, 4, "S1", 1, "EXACT_NAME"), ("Z", 100000, 100000, 1, None, None, "UNRESOLVED")],
        "name string, lat_e5 bigint, lon_e5 bigint, incidents bigint, site_name string, site_id bigint, match_status string",
    )
    attrs = spark.createDataFrame([(1, 60000.0), (1, None)], "site_id bigint, attr double")
    return incidents, exposure, crosswalk, attrs


def test_period_metrics_use_all_incidents(spark):
    incidents, exposure, _, _ = facts(spark)
    direct = sorted(rates.period_metrics(incidents, exposure).collect())
    rolled = rates.period_metrics_from_rollups(rates.incident_rollup(incidents), rates.exposure_rollup(exposure))
    assert direct == sorted(rolled.collect())
    assert direct == [("Late Night", 1, 50, 2000.0), ("Morning", 3, 400, 750.0)]


def test_site_metrics_keep_sites_without_incidents(spark):
    _, exposure, crosswalk, attrs = facts(spark)
    rows = {r.site_id: r for r in rates.site_metrics(crosswalk, exposure, attrs).collect()}
    assert (rows[1].incidents, rows[1].exposure, rows[1].attr) == (4, 450, 60000.0)
    assert rows[1].rate == pytest.approx(4e5 / 450)
    assert (rows[2].incidents, rows[2].exposure, rows[2].attr, rows[2].rate) == (0, 10, None, 0.0)


def test_site_periods_use_matched_incidents(spark):
    incidents, exposure, crosswalk, attrs = facts(spark)
    got = rates.site_period_metrics(rates.incident_rollup(incidents), crosswalk, rates.exposure_rollup(exposure), attrs)
    rows = {(r.site_id, r.period): (r.incidents, r.exposure, r.rate) for r in got.collect()}
    assert rows == {
        (1, "Morning"): (2, 400, 500.0),
        (1, "Late Night"): (1, 50, 2000.0),
        (2, "Morning"): (0, 0, None),
        (2, None): (0, 10, 0.0),
    }


@pytest.mark.parametrize(
    "count, exposure, rate",
    [
        (6640, 415_027_109, 1.59989549020038),
        (9931, 406_476_845, 2.44318959915171),
        (7983, 372_937_037, 2.14057580985178),
        (9137, 104_075_041, 8.77924227769461),
    ],
)
def test_published_rates(spark, count, exposure, rate):
    df = spark.createDataFrame([(count, exposure)], "c bigint, e bigint")
    assert df.select(rates.rate_per("c", "e")).first()[0] == pytest.approx(rate, rel=1e-13)


def metrics(spark, rows):
    return spark.createDataFrame(rows, "site_id bigint, site_name string, incidents bigint, exposure bigint, attr double, rate double")


def test_thresholds_are_inclusive(spark):
    m = metrics(spark, [(1, "a", 1, 500_000, 1.0, 0.2), (2, "b", 9, 499_999, 1.0, 9.0), (3, "c", 1, 500_000, None, 0.2)])
    assert {r.site_id for r in rates.rate_set(m).collect()} == {1, 3}
    assert {r.site_id for r in rates.attribute_set(m).collect()} == {1}
    assert [r.site_id for r in rates.top_k(m, "rate", 5, "exposure", 500_000).collect()] == [1, 3]
    assert [r.site_id for r in rates.top_k(m, "rate", 1).collect()] == [2]
    sp = m.withColumn("exposure", F.lit(100_000)).withColumn("period", F.lit("Morning"))
    assert {r.threshold for r in rates.publish_site_periods(sp).collect()} == {"Include"}


def test_groups_and_views(spark):
    m = metrics(
        spark,
        [(1, "a", 1, 600_000, 49_999.0, 4.0), (2, "b", 2, 600_000, 50_000.0, 2.0), (3, "c", 3, 600_000, None, 9.0), (4, "d", 4, 10, 1.0, 99.0)],
    )
    served = rates.publish_sites(m)
    assert {r.site_id: r.attr_group for r in served.collect()} == {1: "Under $50k", 2: "$50k-$75k", 3: "Missing", 4: "Under $50k"}
    assert views.view_rate_by_bin(served).collect() == [("Under $50k", 4.0), ("$50k-$75k", 2.0)]
    assert [r.attr_group for r in rates.rate_by_bin(rates.attribute_set(m)).collect()] == ["Under $50k", "$50k-$75k"]
    assert [r.site_name for r in views.view_top_sites(served).collect()] == ["c", "a", "b"]
    assert views.view_volume_vs_exposure(served).count() == 4
    assert {r.site_id for r in views.view_rate_vs_attr(served).collect()} == {1, 2}


def test_quadrants(spark):
    m = metrics(spark, [(i, "s", i, 1, None, float(r)) for i, r in ((1, 9), (2, 1), (3, 8), (4, 2))])
    got = {r.site_id: r.quadrant for r in rates.quadrant(m, volume_cut=3, rate_cut=5.0).collect()}
    assert got == {
        1: "Low volume / high rate", 2: "Low volume / low rate", 3: "High volume / high rate", 4: "High volume / low rate",
    }
    assert rates.quadrant(m).where("quadrant like 'High volume%'").count() == 3


def test_rate_ratio(spark):
    p = spark.createDataFrame([("Late Night", 8.0), ("Morning", 2.0)], "period string, rate double")
    assert {r.period: r.times_morning for r in rates.rate_ratio(p, "Morning").collect()} == {"Late Night": 4.0, "Morning": 1.0}


def test_recurring(spark):
    lists = [spark.createDataFrame([(i,) for i in ids], "site_id bigint") for ids in ([1, 2, 2], [2, 3], [2, 3])]
    assert sorted(rates.recurring(lists, 2).collect()) == [(2, 3), (3, 2)]


def test_median_is_exact_at_any_size(spark):
    df = spark.range(1, 60_002).selectExpr("(id * 7919) % 60001 as v")
    assert rates.exact_quantile(df, "v", most=500) == 30_000
    assert rates.exact_quantile(df.where("v < 4"), "v") == 1
    assert rates.exact_quantile(df.where("v < 0"), "v") is None
    heavy = df.selectExpr("case when v < 40000 then 5.0 else double(v) end as v")
    assert rates.exact_quantile(heavy, "v", most=100) == 5.0
    assert rates.exact_quantile(heavy.selectExpr("case when v > 5 then v end as v"), "v", most=100) == 50_000.0
