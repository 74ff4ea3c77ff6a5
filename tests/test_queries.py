"""Every registered query against its SQL, and what its physical plan may not contain."""

import functools
import re

import oracle
import pytest
from conftest import TESTDATA

import __spark_entry__ as contract
from perexpo.plans import inputs
from perexpo.plans import queries as Q
from perexpo.plans.oracle import ORACLE_SQL

SF_DIR = f"{TESTDATA}/sf0.001"
SHARED = ("_candidates", "_crosswalk", "_metrics", "_written_metrics")
ORIGINAL = {name: getattr(Q, name) for name in SHARED}


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def shared_stages():
    """Stages that many queries write for themselves are written once for this module."""
    saved = {name: getattr(Q, name) for name in SHARED}
    for name, fn in saved.items():
        once = functools.cache(lambda spark, d, fn=fn: fn(spark, d))
        setattr(Q, name, lambda spark, d, *_, once=once: once(spark, d))
    yield
    for name, fn in saved.items():
        setattr(Q, name, fn)


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(ORACLE_SQL)
    assert set(Q.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["site_metrics", "rank_site_period", "crosswalk_report", "residuals"])
def test_facts_are_read_once(spark, name, monkeypatch):
    """Queries on sites and periods read incidents once and exposure once."""
    reads = []
    for fn in (inputs.incidents, inputs.exposure_raw):
        monkeypatch.setattr(inputs, fn.__name__, lambda *a, fn=fn: reads.append(fn.__name__) or fn(*a))
    for stage in SHARED:
        monkeypatch.setattr(Q, stage, ORIGINAL[stage])
    Q.QUERIES[name](spark, SF_DIR)
    assert sorted(reads) == ["exposure_raw", "incidents"]


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in plan, f"{operator} in the plan of {name}"
    # A window over one partition would collect a whole table in one task.
    assert not re.search(r"Window [^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan)
    spark_cols, spark_rows = oracle.spark_rows(df)
    duck_cols, duck_rows = oracle.duck_rows(duck, contract.oracle_sql()[name])
    assert spark_cols == duck_cols
    assert spark_rows == duck_rows


def test_entry(spark):
    assert contract.entry(spark).count() == 4


def test_filters_and_columns_reach_the_scan(spark):
    plan = Q.QUERIES["coord_clusters"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,error\)", plan)
    assert re.search(r"ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>", plan)
