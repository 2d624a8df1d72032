from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from trendlens import session


def fake(master, named=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=context)


def test_scratch_folder_is_the_named_one():
    assert session.scratch_dir(fake("yarn", "hdfs://shared/scratch/")) == "hdfs://shared/scratch"


def test_cluster_without_a_named_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(fake("yarn"))


def test_local_session_gets_its_own_folder_once():
    assert session.scratch_dir(fake("local[2]")) == session.scratch_dir(fake("local[2]"))


@pytest.mark.parametrize("limit", [2, 100])
def test_attach_small_gives_the_same_rows_either_way(spark, limit):
    left = spark.range(50).withColumn("k", F.col("id") % 7)
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = session.attach_small(left, right, ["k"], "left", max_rows=limit)
    want = {i: (i % 7) * 10 if i % 7 < 5 else None for i in range(50)}
    assert {r["id"]: r["v"] for r in got.collect()} == want


def test_attach_small_hints_only_below_the_bound(spark):
    left, right = spark.range(10), spark.range(5)
    small = session.attach_small(left, right, ["id"], max_rows=5)._jdf.queryExecution().analyzed().toString()
    large = session.attach_small(left, right, ["id"], max_rows=4)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in small and "broadcast" not in large


def test_settle_cuts_the_lineage(spark):
    df = session.settle(spark.range(10).withColumn("x", F.col("id") + 1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan
    assert df.filter("x > 5").count() == 5
    assert "ReadSchema: struct<x:bigint>" in df.select("x")._jdf.queryExecution().executedPlan().toString()


def test_spread_only_few_splits(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == cores
    many = spark.range(0, 10, 1, cores)
    assert session.spread(many) is many
