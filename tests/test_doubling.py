"""Pointer doubling: long chains and cycles, and rate limits with one key that has most events."""

import math
import random

import pytest
from pyspark.sql import functions as F

from impactloom.operators import graph
from impactloom.streaming import events


def brute_lineage(parents, starts):
    out = []
    for s in starts:
        seen, x, steps = {s}, s, 0
        out.append((s, s, 0, False))
        while parents.get(x) is not None:
            x, steps = parents[x], steps + 1
            out.append((s, x, steps, x in seen))
            if x in seen:
                break
            seen.add(x)
    return sorted(out)


def test_lineage_of_long_chains_in_few_rounds(spark, monkeypatch):
    n = 1_500
    chain = {i: i - 1 if i else None for i in range(n)}
    ring = {n + (7 * i) % n: n + (7 * (i + 1)) % n for i in range(n)}
    tail = {2 * n + i: 2 * n + i - 1 if i else n + 5 for i in range(300)}
    parents = chain | ring | tail
    rounds, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    nodes = spark.createDataFrame(list(parents.items()), "id long, parent long")
    starts = [n - 1, 0, n, n + 17, 2 * n + 299, 2 * n]
    got = [tuple(r) for r in graph.lineage(nodes, spark.createDataFrame([(s,) for s in starts], "id long")).collect()]
    assert sorted(got) == brute_lineage(parents, starts)
    assert len(rounds) < 6 * math.ceil(math.log2(3 * n))


def test_lineage_of_random_parents(spark):
    rng = random.Random(4)
    for n in (1, 40):
        parents = {i: rng.choice([None, *range(n + 2)]) if rng.random() < 0.15 else rng.randrange(n) for i in range(n)}
        nodes = spark.createDataFrame(list(parents.items()), "id long, parent long")
        got = [tuple(r) for r in graph.lineage(nodes, nodes.select("id")).collect()]
        assert sorted(got) == brute_lineage(parents, parents)


def brute_limits(rows, most, window):
    out, now, start, count = [], object(), None, 0
    for k, t, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if k != now or t >= start + window:
            now, start, count = k, t, 0
        count += 1
        out.append((k, i, count <= most))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("partitions", "most", "window"), [("4", 2, 10), ("13", 3, 250)])
def test_limits_equal_brute_force(spark, partitions, most, window):
    rng = random.Random(int(partitions))
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None, *range(10, 40)]), rng.randrange(3_000), i) for i in range(900)]
    rows += [(1, 5, 5), (1, 5, 5), (77, 10, 1), (77, 20, 2), (77, 29, 3), (77, 30, 4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "k long, t long, id long")
        got = [tuple(r) for r in events.rate_limited(df, "k", "t", "id", most, window).collect()]
        assert sorted(got, key=repr) == brute_limits(rows, most, window)
        assert events.rate_limited(df.limit(0), "k", "t", "id", 1, 1).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_key_with_all_events_is_spread(spark):
    df = spark.range(3_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), "id")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = events.rate_limited(df, "k", "t", "id", 2, 10)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1_500
        assert out.where("allowed").count() == 600
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
