"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelscope.plans import catalogue, market

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    known = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in known.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    want = sorted(repr(tuple(row[k] for k in order)) for row in known.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["date", "ticker", "price"]


def test_ttest_has_detections(spark):
    assert entry.queries()["detect_ttest"](spark, "/root/testdata/sf0.01").count() == 1192


def test_tasks_grow_with_the_items(spark, monkeypatch):
    """A task's rows stay as many as they are, however many there are in all; small tables leave the number to Spark."""
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    plan = lambda: market.panel(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan() and f", {-(-n // 100)}" not in plan()
    monkeypatch.setattr(market, "ITEMS", 100)
    assert market.panel(spark, SF).rdd.getNumPartitions() == -(-n // 100)
