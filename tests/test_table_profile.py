"""One-pass profiles, their union, and the matrix of correlations."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from perexpo.operators import statistics, table_profile
from perexpo.plans import inputs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_table_is_read_once(spark):
    lines = inputs.table(spark, f"{TESTDATA}/sf0.001", "lineitem")
    found = table_profile.profile_table(lines)
    assert plan(found).count("FileScan") == 1
    assert found.count() == len(lines.columns)


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame(
        [(1, 2.5, "7", True, [1]), (None, float("nan"), "x", None, None), (3, None, "2.5", False, [2]), (2**62, -1.0, None, True, [])],
        "i bigint, d double, t string, b boolean, a array<int>",
    ).withColumn("day", F.to_date(F.lit("2024-02-03"))).withColumn("ts", F.to_timestamp(F.lit("2024-02-03 04:05:06")))
    rows = {r.column_name: r for r in table_profile.report(table_profile.profile_table(df, exact=["i"])).collect()}
    assert (rows["i"].min_value, rows["i"].max_value, rows["i"].exact_distinct) == ("1", str(2**62), 3)
    assert (rows["d"].min_value, rows["d"].max_value, rows["d"].nulls) == ("-1.0", "NaN", 1)
    assert (rows["t"].integer_values, rows["t"].real_values, rows["t"].text_values, rows["t"].nulls) == (1, 1, 1, 1)
    assert (rows["b"].min_value, rows["b"].max_value, rows["b"].distinct_estimate) == ("0", "1", 2)
    assert (rows["a"].row_count, rows["a"].nulls, rows["a"].min_value, rows["a"].distinct_estimate) == (4, 1, None, None)
    assert rows["day"].max_value == "2024-02-03" and rows["ts"].min_value == "2024-02-03 04:05:06.000000"
    empty = table_profile.report(table_profile.profile_table(df.limit(0))).collect()
    assert len(empty) == 7 and all(r.row_count == 0 and r.min_value is None for r in empty)
    with pytest.raises(ValueError):
        table_profile.profile_table(df, exact=["no"])


def test_sketches_err_little_and_unite(spark):
    df = spark.range(60_000).select((F.col("id") % 50_000).alias("v"), (F.col("id") % 9).alias("batch"), F.lit(None).cast("string").alias("none"))
    whole = {r.column_name: r for r in table_profile.report(table_profile.profile_table(df)).collect()}
    parts = table_profile.profile_table(df, batch=["batch"])
    assert parts.count() == 18
    united = {r.column_name: r for r in table_profile.report(table_profile.merge_profiles(parts)).collect()}
    for found in (whole, united):
        assert abs(found["v"].distinct_estimate - 50_000) < 50_000 * 0.05
        assert (found["v"].row_count, found["v"].min_value, found["v"].max_value) == (60_000, "0", "49999")
        assert (found["none"].nulls, found["none"].distinct_estimate) == (60_000, 0)


def matrix(spark, data, cols):
    rows = [tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) for v in r) for r in data]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    return {(r.x, r.y): r for r in statistics.correlation_matrix(df, cols).collect()}


def test_matrix_with_gaps_and_ties(spark):
    rng = random.Random(3)
    cols = ["a", "b", "c", "d", "e"]
    data = []
    for _ in range(800):
        a = rng.randint(0, 20)
        row = [a, a + rng.gauss(0, 5), rng.random() < 0.3, math.exp(a / 5), rng.gauss(0, 1)]
        data.append([None if rng.random() < 0.15 else v for v in row])
    data += data[:200]
    found = matrix(spark, data, cols)
    frame = pd.DataFrame(data, columns=cols).astype(float)
    assert set(found) == set(itertools.combinations(cols, 2))
    for (x, y), r in found.items():
        both = frame[[x, y]].dropna()
        assert r.n == len(both)
        assert r.pearson == pytest.approx(np.corrcoef(both[x], both[y])[0, 1], abs=1e-9)
        ranks = both.rank()
        assert r.spearman == pytest.approx(np.corrcoef(ranks[x], ranks[y])[0, 1], abs=1e-9)


def test_matrix_without_variance_or_rows(spark):
    found = matrix(spark, [[1, 2, None], [1, 3, None], [1, 4, None]], ["a", "b", "c"])
    assert (found["a", "b"].n, found["a", "b"].spearman) == (3, None)
    assert (found["a", "c"].n, found["a", "c"].pearson, found["a", "c"].spearman) == (0, None, None)
    none = matrix(spark, [], ["a", "b"])
    assert (none["a", "b"].n, none["a", "b"].spearman) == (0, None)


def test_ranks_of_all_columns_take_one_range_exchange(spark):
    """The number of passes does not grow with the columns."""
    df = spark.range(100).select(*[(F.col("id") * k % 7).alias(f"c{k}") for k in range(1, 7)])
    found = plan(statistics.correlation_matrix(df, df.columns))
    # Ranges are written before; what is left is the join of ranks, its aggregates and the one-row subqueries.
    assert found.count("SortMergeJoin") + found.count("BroadcastHashJoin") <= 4


def test_rows_are_not_put_together_again_after_the_join(spark):
    """Ranks that go back to each row, in lists by its number, are sorted and shuffled with all rows once per column."""
    df = spark.range(100).select(*[(F.col("id") * k % 7).alias(f"c{k}") for k in range(1, 7)])
    found = plan(statistics.correlation_matrix(df, df.columns))
    assert "SortAggregate" not in found and "SortMergeJoin" not in found


@pytest.mark.parametrize("limit", [0, 200, 10**6])
def test_matrix_with_ranks_broadcast_or_shuffled(spark, monkeypatch, limit):
    """No column's ranks are broadcast, those of two, or all."""
    monkeypatch.setattr(statistics, "BROADCAST_NUMBERS", limit)
    rng = random.Random(5)
    cols = ["a", "b", "c", "d"]
    data = [[rng.randint(0, 8), rng.gauss(0, 5), rng.randint(0, 20), rng.randint(0, 300)] for _ in range(500)]
    data = [[r[0], r[1] + r[0], *r[2:]] for r in data] + [[0, -1e3, 1, 2]] * 200
    data = [[None if rng.random() < 0.2 else v for v in r] for r in data]
    found = matrix(spark, data, cols)
    assert list(found) == list(itertools.combinations(cols, 2))
    frame = pd.DataFrame(data, columns=cols).astype(float)
    for (x, y), r in found.items():
        both = frame[[x, y]].dropna()
        ranks = both.rank()
        assert r.n == len(both)
        assert r.pearson == pytest.approx(np.corrcoef(both[x], both[y])[0, 1], abs=1e-12)
        assert r.spearman == pytest.approx(np.corrcoef(ranks[x], ranks[y])[0, 1], abs=1e-12)


def test_matrix_takes_means_from_the_rows_of_each_pair(spark):
    """A value far away in rows that the pair leaves out, and equal values whose mean is rounded."""
    data = [[1e12 + i, None, 0.1] for i in range(20)] + [[i % 7, (i * i) % 5, 0.1] for i in range(60)]
    found = matrix(spark, data, ["a", "b", "c"])
    a, b = np.array([r[0] for r in data[20:]]), np.array([r[1] for r in data[20:]])
    assert found["a", "b"].pearson == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-12)
    assert (found["a", "c"].n, found["a", "c"].pearson, found["a", "c"].spearman) == (80, None, None)


def test_matrix_with_values_that_are_no_numbers(spark):
    df = spark.createDataFrame([(1.0, float("nan"), 2.0), (2.0, 1.0, 5.0), (3.0, 2.0, -0.0), (4.0, 3.0, 0.0)], "a double, b double, c double")
    found = {(r.x, r.y): r for r in statistics.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert math.isnan(found["a", "b"].pearson) and math.isnan(found["b", "c"].pearson)
    assert found["a", "b"].spearman == pytest.approx(np.corrcoef([1, 2, 3, 4], [4, 1, 2, 3])[0, 1])
    assert found["a", "c"].spearman == pytest.approx(np.corrcoef([1, 2, 3, 4], [3, 4, 1.5, 1.5])[0, 1])


def test_exact_counts_do_not_multiply_the_rows(spark):
    """Different values of several columns in one aggregate make a row for each of them, and sort all."""
    df = spark.createDataFrame([(1, "a", 0), (1, None, 0), (2, "b", 1), (2, "b", None)], "i int, t string, batch int")
    found = table_profile.profile_table(df, exact=["i", "t"])
    assert "Expand" not in plan(found)
    assert {r.column_name: r.exact_distinct for r in found.collect()} == {"i": 2, "t": 2, "batch": None}
    parts = table_profile.profile_table(df, exact=["t"], batch=["batch"]).where("column_name = 't'").collect()
    assert {(r.batch, r.row_count, r.exact_distinct) for r in parts} == {(0, 2, 1), (1, 1, 1), (None, 1, 1)}
