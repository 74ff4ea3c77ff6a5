"""Partitioned tables, batches that can be replayed, split CSV files, rollups that grow, observed writes."""

import random

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from perexpo.operators import incremental, profiling, rates
from perexpo.plans import inputs
from perexpo.sources import tables

SCHEMA = "id int, name string, day string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_replayed_batch_replaces_itself(spark):
    path, df = tables.scratch_path(spark, "batches"), spark.range(10)
    assert tables.read_batches(spark, path, "id bigint").count() == 0
    for _ in range(2):
        tables.append_batch(df, path, "2024-01-01")
    tables.append_batch(df.where("id < 3"), path, "b")
    tables.append_batch(df.where("id > 90"), path, "b")
    tables.append_batch(df.withColumn("batch_id", F.lit("other")), path, "c")
    found = tables.read_batches(spark, path, "id bigint")
    assert {r.batch_id: r["count"] for r in found.groupBy("batch_id").count().collect()} == {"2024-01-01": 10, "c": 10}
    assert found.dtypes == [("id", "bigint"), ("batch_id", "string")]
    with pytest.raises(ValueError):
        tables.append_batch(df, path, "a/b")


def test_only_given_partitions_are_replaced(spark):
    path = tables.scratch_path(spark, "parts")
    df = spark.createDataFrame([(i, f"n{i}", f"d{i % 3}") for i in range(30)], SCHEMA)
    stored = tables.save_partitioned(df, path, ["day"])
    assert sorted(stored.select(df.columns).collect()) == sorted(df.collect())
    for _ in range(2):
        tables.replace_partitions(spark.createDataFrame([(100, "new", "d1")], SCHEMA), path, ["day"])
    rows = tables.read_partitioned(spark, path, SCHEMA)
    assert {r.day: r["count"] for r in rows.groupBy("day").count().collect()} == {"d0": 10, "d1": 1, "d2": 10}
    one = rows.where("day = 'd1'").select("id")
    assert "PartitionFilters: [isnotnull(day" in plan(one) and [r.id for r in one.collect()] == [100]
    assert one._jdf.queryExecution().executedPlan().collectLeaves().head().metadata().get("PartitionFilters").isDefined()
    assert len(one.inputFiles()) <= len(rows.inputFiles())
    tables.drop_partition(spark, path, "day=d1")
    assert tables.read_partitioned(spark, path, SCHEMA).where("day = 'd1'").count() == 0


def test_csv_without_line_ends_is_split(spark):
    schema = "id int, text string"
    whole = spark.range(20_000).select(F.col("id").cast("int"), F.concat(F.lit('a "b", '), F.col("id").cast("string")).alias("text"))
    path = tables.write_csv(whole.coalesce(1), tables.scratch_path(spark, "flat"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        found = tables.read_csv(spark, path, schema)
        assert found.rdd.getNumPartitions() > 5
        assert sorted(found.collect()) == sorted(whole.collect())
        broken = tables.write_csv(whole.withColumn("text", F.lit("x\ny")).coalesce(1), tables.scratch_path(spark, "ends"))
        assert tables.read_csv(spark, broken, schema).rdd.getNumPartitions() == 1
        assert tables.read_csv(spark, broken, schema).distinct().count() == 20_000
        with pytest.raises(Exception, match="MALFORMED"):
            tables.read_csv(spark, broken, schema, multi_line=False).collect()
        raw = tables.read_raw(spark, path, "csv")
        assert raw.rdd.getNumPartitions() > 5 and raw.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def made_facts(spark, n, seed):
    rng = random.Random(seed)
    incidents = [("01/01/2024", f"{rng.randint(0, 23):02d}:00:00", f"P{rng.randint(0, 9)}", 40.0 + rng.randint(0, 9) / 100, -74.0, 1) for _ in range(n)]
    exposure = [
        (f"01/01/2024 {rng.randint(1, 12):02d}:00:00 {rng.choice(['AM', 'PM'])}", s := rng.randint(0, 9), f"S{s}", "R", 40.0 + s / 100, -74.0, rng.randint(0, 99))
        for _ in range(n)
    ]
    return spark.createDataFrame(incidents, tables.INCIDENT_SCHEMA), spark.createDataFrame(exposure, tables.EXPOSURE_SCHEMA)


@pytest.fixture
def sites(spark):
    crosswalk = spark.createDataFrame(
        [(f"P{i}", 4000000 + j * 1000, -7400000, 1, f"S{i}", i, "EXACT_NAME") for i in range(8) for j in range(10)], tables.CROSSWALK_SCHEMA
    )
    attrs = spark.createDataFrame([(i, 1000.0 * i) for i in range(0, 10, 2)], "site_id bigint, attr double")
    return crosswalk, attrs


def test_grown_state_equals_the_full_run(spark, sites):
    crosswalk, attrs = sites
    path = tables.scratch_path(spark, "state")
    batches = {f"b{i}": made_facts(spark, 60, i) for i in range(3)}
    empty = tuple(f.limit(0) for f in batches["b0"])
    incremental.add_batch(*batches["b0"], path, "b0")
    served = incremental.publish_site_periods(spark, path, f"{path}/served", crosswalk, attrs)
    steps = [("b1", batches["b1"]), ("b2", made_facts(spark, 90, 77)), ("b2", batches["b2"]), ("b1", empty), ("b1", batches["b1"])]
    now = {"b0": batches["b0"]}
    for name, facts in steps:
        touched = incremental.replace_batch(*facts, path, name, crosswalk)
        served = incremental.publish_site_periods(spark, path, f"{path}/served", crosswalk, attrs, touched)
        now[name] = facts
        incidents, exposure = (functools_union([f[i] for f in now.values()]) for i in range(2))
        full = rates.site_period_metrics(rates.incident_rollup(incidents), crosswalk, rates.exposure_rollup(exposure), attrs)
        assert sorted(served.select(full.columns).collect(), key=str) == sorted(full.collect(), key=str)
    whole = rates.period_metrics_from_rollups(rates.incident_rollup(incidents), rates.exposure_rollup(exposure))
    assert sorted(incremental.publish_periods(spark, path).collect()) == sorted(whole.collect())


def functools_union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def test_sites_that_vanish_leave_the_served_table(spark, sites):
    crosswalk, attrs = sites
    path = tables.scratch_path(spark, "state")
    first = made_facts(spark, 40, 5)
    incremental.add_batch(*(f.limit(0) for f in first), path, "a")
    touched = incremental.replace_batch(*first, path, "b", crosswalk)
    incremental.publish_site_periods(spark, path, f"{path}/served", crosswalk, attrs)
    touched = incremental.replace_batch(*(f.limit(0) for f in first), path, "b", crosswalk)
    served = incremental.publish_site_periods(spark, path, f"{path}/served", crosswalk, attrs, touched)
    assert served.count() == 0


def test_old_facts_are_not_read(spark, sites):
    crosswalk, attrs = sites
    path = tables.scratch_path(spark, "state")
    incidents, exposure = (tables.materialize(f, name) for f, name in zip(made_facts(spark, 50, 9), ("old-incidents", "old-exposure"), strict=True))
    incremental.add_batch(incidents, exposure, path, "a")
    for df in incremental.state(spark, path):
        files = df.inputFiles()
        assert files and all("batch_id=a" in f for f in files) and not any("old-" in f for f in files)


def test_swapped_values_are_seen(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(100)], "id int, v int")
    path = tables.scratch_path(spark, "seen")
    stored, before = profiling.observed_write(df, path, "v", "one")
    _, same = profiling.observed_write(stored.orderBy(F.desc("id")).repartition(7), path + "2", "v", "two")
    swapped = stored.withColumn("v", F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(F.col("v")))
    _, other = profiling.observed_write(swapped, path + "3", "v", "three")
    assert before == same and before["measure"] == other["measure"] and before["checksum"] != other["checksum"]
    row = profiling.compare_totals(spark, before, other, "x").first()
    assert (row.rows_equal, row.measure_equal, row.contents_equal) == (True, True, False)
    _, none = profiling.observed_write(df.limit(0), path + "4", "v", "four")
    assert none["rows"] == 0 and none["measure"] is None


def test_dependencies_are_checked_in_one_read(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.0, None), (1, "a", -0.0, 5), (2, "a", 1.0, 1), (2, "b", float("nan"), 1), (2, None, float("nan"), 1), (None, "x", 1.0, 1), (None, "y", 1.0, 1)],
        "k int, t string, f double, n int",
    )
    found = profiling.fd_violations(df, "k", ["t", "f", "n"])
    assert sorted(found.collect(), key=str) == sorted([(2, 2, 2, 1), (None, 2, 1, 1)], key=str)
    lines = inputs.table(spark, f"{TESTDATA}/sf0.001", "lineitem")
    one = profiling.fd_violations(lines, "l_orderkey", ["l_suppkey", "l_returnflag"])
    assert plan(one).count("FileScan") == 1


def test_a_value_with_many_rows_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "skewed")
    rows = spark.range(0, 400_000, 1, 8).select("id", F.when(F.col("id") < 10, "rare").otherwise("often").alias("k"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "256KB")
    try:
        tables.save_partitioned(rows, path, ["k"])
        assert len(list((tmp_path / "skewed" / "k=often").glob("*.parquet"))) > 1
        tables.replace_partitions(rows.where("k = 'often'"), path, ["k"])
    finally:
        spark.conf.set(size, before)
    assert len(list((tmp_path / "skewed" / "k=often").glob("*.parquet"))) > 1
    found = tables.read_partitioned(spark, path, rows.schema)
    assert {r.k: (r["n"], r["ids"]) for r in found.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("ids")).collect()} == {
        "rare": (10, 45),
        "often": (399_990, sum(range(10, 400_000))),
    }
