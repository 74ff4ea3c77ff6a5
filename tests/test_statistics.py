import numpy as np
import pandas as pd
import pytest

from perexpo.operators import statistics


def rank_corr(x, y):
    known = pd.DataFrame({"x": x, "y": y}, dtype=float).dropna().rank()
    return known.x.corr(known.y)


def frame(spark, x, y):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(x, y))], "id bigint, x double, y double")


def hot(n=3000, seed=0):
    """A third of the rows share one value; the rest is tied in places."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.34, 0.0, np.round(rng.exponential(50, n), 1))
    return x, x * 0.5 + rng.normal(0, 20, n)


@pytest.mark.parametrize("n", [1, 7, 3000])
def test_average_rank(spark, n):
    x, y = hot(n)
    got = statistics.average_rank(frame(spark, x.tolist(), y.tolist()), "x", "r").orderBy("id").toPandas()
    assert got.r.tolist() == pd.Series(x).rank().tolist()


def test_average_rank_distinct_values(spark):
    x = np.random.default_rng(1).permutation(5000).astype(float)
    got = statistics.average_rank(frame(spark, x.tolist(), x.tolist()), "x", "r").orderBy("id").toPandas()
    assert got.r.tolist() == (x + 1).tolist()


def test_average_rank_of_null_is_null(spark):
    df = frame(spark, [3.0, None, 1.0, 3.0], [0.0] * 4)
    got = statistics.average_rank(df, "x", "r").orderBy("id").collect()
    assert [r.r for r in got] == [2.5, None, 1.0, 2.5]
    empty = statistics.average_rank(df.where("x > 100"), "x", "r")
    assert empty.collect() == [] and empty.schema["r"].dataType.simpleString() == "double"


def test_spearman_matches_pandas(spark):
    x, y = hot(2000, 4)
    got = statistics.spearman(frame(spark, x.tolist(), y.tolist()), "x", "y").first()
    assert got.spearman == pytest.approx(rank_corr(x, y), abs=1e-12)


def test_pairs_with_a_missing_side_are_left_out(spark):
    x, y = [1.0, 2.0, 3.0, None, 5.0], [2.0, 1.0, None, 9.0, 7.0]
    df = frame(spark, x, y)
    a, b = pd.Series(x, dtype=float), pd.Series(y, dtype=float)
    s, p = statistics.spearman(df, "x", "y").first(), statistics.pearson(df, "x", "y").first()
    assert (s.n, p.n) == (3, 3)
    assert s.spearman == pytest.approx(rank_corr(x, y))
    assert p.pearson == pytest.approx(a.corr(b))


def test_ols_and_residuals(spark):
    x, y = hot(500, 2)
    df = frame(spark, x.tolist(), y.tolist())
    slope, intercept = np.polyfit(x, y, 1)
    fit = statistics.ols(df, "x", "y").first()
    assert (fit.slope, fit.intercept, fit.n) == (pytest.approx(slope), pytest.approx(intercept), 500)
    res = statistics.with_residual(df, "x", "y", "fitted", "left").orderBy("id").toPandas()
    assert np.allclose(res.left, y - (intercept + slope * x))
    assert abs(res.left.sum()) < 1e-6


def test_residual_outliers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{i}", float(20000 + i * 100), int(rng.integers(500_000, 10**7)), float(rng.random() * 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "site_id bigint, site_name string, attr double, exposure bigint, rate double")
    table = statistics.residual_table(df).toPandas().set_index("site_id")
    res = statistics.residual_table(df)
    above = [r.site_id for r in statistics.residual_outliers(res, "attr_residual", 5).collect()]
    below = [r.site_id for r in statistics.residual_outliers(res, "attr_residual", 5, "below").collect()]
    assert above == table.attr_residual.nlargest(5).index.tolist()
    assert below == table.attr_residual.nsmallest(5).index.tolist()
    logs = np.log10(table.exposure)
    slope, intercept = np.polyfit(logs, table.rate, 1)
    assert np.allclose(table.exposure_residual, table.rate - (intercept + slope * logs))
