import pytest
from pyspark.sql import functions as F

from perexpo.operators import profiling
from perexpo.sources import tables


def test_reconcile(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "x bigint")
    same = profiling.reconcile(a, a.repartition(3), "x", "x").first()
    assert (same.rows_before, same.measure_after, same.rows_equal, same.measure_equal) == (3, 3, True, True)
    lost = profiling.reconcile(a, a.where("x > 1"), "x", "x").first()
    assert (lost.rows_equal, lost.measure_equal) == (False, False)


def test_reconcile_empty(spark):
    row = profiling.reconcile(spark.createDataFrame([], "x bigint"), spark.createDataFrame([], "x bigint"), "x", "x").first()
    assert row.rows_equal and row.measure_equal


def test_fd_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, None, 1.0), (2, "b", 1.0)], "k int, n string, l double")
    assert profiling.fd_violations(df, "k", ["n", "l"]).collect() == [(1, 1, 2)]
    assert profiling.null_counts(df).first() == (4, 0, 1, 0)
    assert profiling.missing(df, "n").first()[0] == 1


def test_range_in_time_order(spark):
    df = spark.createDataFrame([("12/31/2024 11:00:00 PM",), ("01/01/2025 01:00:00 AM",)], "ts string")
    row = profiling.value_range(df, "ts", "MM/dd/yyyy hh:mm:ss a").first()
    assert row.min_value.startswith("01/01/2025")
    assert row.min_ts.year == 2024 and row.max_ts.year == 2025


def test_coverage_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 2)], "k string, t int")
    assert {tuple(r) for r in profiling.coverage(df, "k", "t", 2).collect()} == {("b", 1)}
    assert profiling.coverage_range(df, "k", "t").first() == (1, 2)
    assert profiling.duplicates(df, ["k", "t"]).collect() == [("a", 1, 2)]
    assert profiling.distinct_count(df, "t").first()[0] == 2
    assert profiling.distinct_count(df, "t", approx=True).first()[0] == 2


def test_observed_totals_come_with_the_write(spark):
    df, seen = profiling.observed(spark.range(10).withColumnRenamed("id", "x"), "totals", "x")
    tables.save(df, tables.scratch_path(spark, "observed"))
    assert seen.get == {"rows": 10, "measure": 45}


def test_csv_keeps_quotes_commas_and_leading_zeros(spark):
    data = [(1, 'Avenue "U" (Q)', "00012"), (2, "5 Av/53 St (E,F)", None)]
    df = spark.createDataFrame(data, "id bigint, name string, zone string")
    path = tables.write_csv(df, tables.scratch_path(spark, "csv"))
    assert sorted(tables.read_csv(spark, path, df.schema).collect()) == sorted(df.collect())


def test_csv_loses_nothing(spark):
    texts = [" a ", "", None, "x\ny", "x\r\ny", '"', '","', "\\", "a\\", "\\n", "ü\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, name string")
    path = tables.write_csv(df, tables.scratch_path(spark, "csv"))
    assert [r.name for r in tables.read_csv(spark, path, df.schema).orderBy("id").collect()] == texts
    with pytest.raises(Exception, match="12x|MALFORMED|FAILFAST"):
        bad = tables.write_csv(df.select(F.lit("12x").alias("id")), tables.scratch_path(spark, "bad"))
        tables.read_csv(spark, bad, "id int").collect()
    with pytest.raises(Exception, match="mark for NULL"):
        tables.write_csv(df.select(F.lit(tables.NULL_MARK).alias("name")), tables.scratch_path(spark, "mark"))


def test_ingest(spark):
    raw = spark.createDataFrame([("7", "1,008.0", "x")], "`Site ID` string, Exposure string, other string")
    schema = "site_id bigint, exposure bigint, lat double"
    found = tables.ingest(raw, schema, {"site_id": "site id"}, optional=["lat"])
    assert found.collect() == [(7, 1008, None)] and found.schema.simpleString() == "struct<site_id:bigint,exposure:bigint,lat:double>"
    with pytest.raises(ValueError, match="lat"):
        tables.ingest(raw, schema, {"site_id": "site id"})


def test_unreadable(spark):
    from perexpo.functions import cleaning

    df = spark.createDataFrame([("5",), ("5.0",), ("x",), (None,)], "v string")
    assert profiling.unreadable(df, "v", cleaning.clean_int("v")).collect() == [(4, 1)]


def test_no_scratch_folder_is_left(tmp_path):
    import glob
    import os
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession\n"
        "from perexpo.sources import tables\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print(tables.materialize(s.range(3)).count())\n"
        "print(tables.scratch_dir(s))\n"
        "s.stop()\n"
    )
    env = os.environ | {"TMPDIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split()[0] == "3", done.stderr[-2000:]
    assert glob.glob(f"{tmp_path}/perexpo-*") == []


def test_raw_tables_are_text(spark):
    path = tables.scratch_path(spark, "raw")
    spark.createDataFrame([(1, 2.5)], "ID int, Value double").write.parquet(path)
    raw = tables.read_raw(spark, path)
    assert raw.dtypes == [("id", "string"), ("value", "string")]
    csv = tables.write_csv(raw, tables.scratch_path(spark, "raw-csv"))
    assert tables.read_raw(spark, csv, "csv").first() == ("1", "2.5")


def test_save_replaces(spark):
    path = tables.scratch_path(spark, "saved")
    tables.save(spark.range(5), path)
    assert tables.save(spark.range(3), path).count() == 3
    tables.append(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5


def test_declared_tables(spark):
    for schema in (tables.REVIEW_SCHEMA, tables.CROSSWALK_SCHEMA, tables.DECISION_SCHEMA, tables.ZONE_SCHEMA):
        assert tables.empty(spark, schema).count() == 0


def test_summary(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9)], "s string, incidents bigint")
    assert profiling.summary(df, "s", "incidents").collect() == [("b", 1, 9), ("a", 2, 3)]
    upper = profiling.summary(df, F.upper("s"), "incidents", alias="s")
    assert upper.columns == ["s", "clusters", "incidents"]
