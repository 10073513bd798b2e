"""The stored closure against a walk in plain Python."""

import contextlib
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pageloom.operators import closure
from pageloom.operators.closure import StoredClosure


def walked(edges, seeds, limit=None):
    out, depth, todo = {}, {s: 0 for s in seeds}, deque(seeds)
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    while todo:
        node = todo.popleft()
        if limit is not None and depth[node] >= limit:
            continue
        for target in out.get(node, ()):
            if target not in depth:
                depth[target] = depth[node] + 1
                todo.append(target)
    return depth


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def formatted(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@contextlib.contextmanager
def setting(spark, key, value):
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key)


def found(stored):
    return {r.node: r.depth for r in stored.reached().collect()}


@pytest.mark.parametrize("limit", [None, 3])
@pytest.mark.parametrize("few", [500, 2])
def test_links_in_parts_equal_one_walk(spark, monkeypatch, few, limit):
    monkeypatch.setattr(closure, "FEW", few)
    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(260)] + [(None, 1), (2, None)]
    real = [e for e in edges if None not in e]
    stored = StoredClosure(spark, limit, buckets=4)
    done = []
    for k, part in enumerate((edges[:120], edges[120:200], edges[200:], [])):
        stored.add(frame(spark, part), frame(spark, [(0, 0), (5, 5)]).select(F.col("src").alias("node")) if k == 0 else None)
        done += [e for e in part if None not in e]
        assert found(stored) == walked(done, [0, 5], limit)
    assert found(stored) == walked(real, [0, 5], limit)
    stored.drop()
    assert not stored._has("links")


def test_a_shorter_way_lowers_depths_behind_it(spark):
    stored = StoredClosure(spark, buckets=2)
    chain = [(k, k + 1) for k in range(6)]
    stored.add(frame(spark, chain), frame(spark, [(0, 0)]).select(F.col("src").alias("node")))
    assert found(stored)[6] == 6
    rounds = stored.add(frame(spark, [(0, 4)]))
    assert found(stored) == walked([*chain, (0, 4)], [0]) and rounds == 3


def test_links_of_hot_nodes_lie_under_several_keys(spark, monkeypatch):
    monkeypatch.setattr(closure, "HOT_ROWS", 20)
    edges = [(1, k) for k in range(100, 200)] + [(k, k + 1000) for k in range(100, 200)] + [(0, 1)]
    stored = StoredClosure(spark, buckets=4)
    stored.add(frame(spark, edges), frame(spark, [(0, 0)]).select(F.col("src").alias("node")))
    assert found(stored) == walked(edges, [0])
    keys = stored._table("links").where("src = 1").select("key").distinct().count()
    assert keys > 10
    stored.add(frame(spark, [(1, 7), (7, 8)]))
    assert found(stored) == walked([*edges, (1, 7), (7, 8)], [0])


def test_a_small_frontier_reads_its_buckets_and_moves_no_links(spark):
    stored = StoredClosure(spark, buckets=8)
    stored.add(frame(spark, [(k, k + 1) for k in range(400)]), frame(spark, [(0, 0)]).select(F.col("src").alias("node")).where("false"))
    level = spark.createDataFrame([(7, 0)], "node long, depth int")
    # Files are pruned by bucket either way; only a bucketed scan says how many are left.
    with setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
        assert "SelectedBucketsCount: 1 out of 8" in formatted(stored._targets(level, 1))
    many = spark.range(1000).select(F.col("id").alias("node"), F.lit(0).alias("depth"))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        assert "Bucketed: true" in formatted(stored._targets(many, 1000))
