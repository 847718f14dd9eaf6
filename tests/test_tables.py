"""Versioned bucketed tables: swap, aborted updates, competing writers, joins without a shuffle."""

import pytest
from pyspark.sql import functions as F

from reviewlake.operators.upsert import insert_ignore
from reviewlake.sources.tables import VersionedTable
from reviewlake.streaming.increments import scratch


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_and_aborted_update(spark):
    t = VersionedTable(spark, scratch(spark, "vt"), "k", 4, ("v",))
    assert t.version() is None
    with pytest.raises(ValueError):
        t.read()
    first = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert t.replace(first) == 1
    old = t.read()
    assert rows(old.where("k is not null")) == [(1, "a"), (2, "b")] and old.count() == 3
    more = spark.createDataFrame([(2, "x"), (3, "d")], "k int, v string")
    assert t.update(lambda now: insert_ignore(now.where("k is not null"), more, ["k"], order_by=["v"])) == 2
    assert rows(t.read()) == [(1, "a"), (2, "b"), (3, "d")]
    assert old.count() == 3  # who reads the old version is not disturbed

    def fails(now):
        return now.select("k", F.when(F.col("k") == 3, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("v")).alias("v"))

    with pytest.raises(Exception):
        t.update(fails)
    assert t.version()[0] == 2 and rows(t.read()) == [(1, "a"), (2, "b"), (3, "d")]
    assert t.update(lambda now: now.where("k > 1")) == 3 and rows(t.read()) == [(2, "b"), (3, "d")]


def test_second_writer_swaps_nothing_in(spark, monkeypatch):
    t = VersionedTable(spark, scratch(spark, "vt2"), "k", 2)
    t.replace(spark.range(3).withColumnRenamed("id", "k"))
    stale = t.version()
    t.replace(spark.range(5).withColumnRenamed("id", "k"))
    monkeypatch.setattr(VersionedTable, "version", lambda self: stale)
    with pytest.raises(Exception):
        t.replace(spark.range(9).withColumnRenamed("id", "k"))
    monkeypatch.undo()
    assert t.version()[0] == 2 and t.read().count() == 5


def test_features_without_shuffle_on_review(spark, pipeline):
    from reviewlake.plans.catalog import QUERIES, bucketed_stages
    tables = bucketed_stages(pipeline)
    from reviewlake.operators.features import review_features
    # only the dimension is small enough to be broadcast, as it would be at any scale
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = review_features(*tables, pipeline.fx.fx_aspect, pipeline.fx.fx_genre)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and plan.count("SortMergeJoin") == 2, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    a, b = (sorted(map(tuple, QUERIES[q](pipeline).collect())) for q in ("bucketed_features", "review_features"))
    assert a == b and a


def test_buckets_grow_with_the_cores():
    from types import SimpleNamespace
    from reviewlake.plans.catalog import bucket_count
    cores = [SimpleNamespace(sparkContext=SimpleNamespace(defaultParallelism=n)) for n in (1, 12)]
    assert [bucket_count(s) for s in cores] == [8, 24]
