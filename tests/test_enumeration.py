"""Limits of an enumeration: which one stops, where, and in groups that lie in many ranges."""

import random

from pyspark.sql import functions as F

from impactloom.operators.ordering import running_counts
from impactloom.sources import scan

FILES = "repository string, path string, size long, binary boolean"


def stops(spark, rows, *limits):
    return {r["repository"]: r.asDict() for r in scan.stops(scan.enumerated(spark.createDataFrame(rows, FILES), *limits)).collect()}


def test_each_limit_stops_at_its_file(spark):
    scripts = [("ts", f"{i:02d}.{'tsx' if i % 2 else 'TS'}", 10, False) for i in range(6)] + [("ts", "05a.go", 10, False)]
    many = [("many", f"{i:02d}.go", 10, False) for i in range(9)]
    large = [("large", "a.go", 60, False), ("large", "b.go", 50, False), ("large", "c.go", 1, False)]
    fine = [("fine", "a.ts", 10, False), ("fine", "b.png", 900, False), ("fine", "c.ts", 900, True), (None, "a.go", 1, False)]
    found = stops(spark, scripts + many + large + fine, 8, 100, 4)
    told = {r: (x["stopped_by"], x["path"], x["n_read"], x["bytes_read"], x["typescript_read"]) for r, x in found.items()}
    assert told == {
        "ts": ("TS_FILE_LIMIT_EXCEEDED", "04.TS", 4, 40, 4),
        "many": ("FILE_LIMIT_EXCEEDED", "08.go", 8, 80, 0),
        "large": ("REPO_SIZE_LIMIT_EXCEEDED", "b.go", 1, 60, 0),
        "fine": (None, None, 1, 10, 1),
        None: (None, None, 1, 1, 0),
    }
    assert found["fine"]["complete"] and not found["ts"]["complete"]
    assert stops(spark, []) == {}


def test_nothing_is_read_after_a_stop(spark):
    rows = [("r", f"{i:02d}.{'ts' if i < 5 else 'go'}", 1, False) for i in range(9)]
    read = scan.enumerated(spark.createDataFrame(rows, FILES), 100, 100, 3).where("reason is null").select("path").collect()
    assert sorted(r["path"] for r in read) == ["00.ts", "01.ts", "02.ts"]


def test_running_counts_of_a_hot_group_equal_brute_force(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), i, r.choice([None, 1, 5])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, i long, x long").repartition(7)
    got = {(x["g"], x["i"]): (x["n"], x["s"]) for x in running_counts(df, ["g"], ["i"], {"n": F.lit(1), "s": F.col("x")}).collect()}
    sums, want = {}, {}
    for g, i, x in rows:
        n, s = sums.get(g, (0, 0))
        sums[g] = want[g, i] = (n + 1, s + (x or 0))
    assert got == want
