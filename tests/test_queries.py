"""Every named query against its SQL, and the shape of the plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry
from check import TABLES, canon

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got, want = df.toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    from voxtide.operators.state import pending_sentiment
    from voxtide.session import shared_dir
    from voxtide.sources import readers, tables

    path = shared_dir(spark, "opinions")
    tables.stored(spark, SF).write.partitionBy("platform").parquet(path)
    df = pending_sentiment(readers.read_opinions(spark, path)).where("platform = 'reddit'").select("post_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNull(sentiment_score)]" in plan
    assert "ReadSchema: struct<post_id:string,sentiment_score:double>" in plan
    assert "PartitionFilters: [isnotnull(platform" in plan


def test_shared_folder_is_the_clusters_where_it_names_one(spark):
    from types import SimpleNamespace

    from voxtide.session import checkpoint_root, shared_dir

    assert shared_dir(spark, "x").startswith(checkpoint_root(spark))
    conf = {"spark.checkpoint.dir": "hdfs://shared/cp"}
    context = SimpleNamespace(getCheckpointDir=lambda: "hdfs://shared/cp/1", applicationId="app-1")
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=context)
    assert shared_dir(named, "x").startswith("hdfs://shared/cp/voxtide/app-1/x-")
