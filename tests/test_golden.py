"""Small hand-made relations: one case per class, ties, cycles, empty sides."""

import math

from pyspark.sql import functions as F

from impactloom.functions import text as x
from impactloom.functions.vector import cosine
from impactloom.operators import graph as g
from impactloom.operators import joins as j
from impactloom.operators import ordering as o
from impactloom.operators import projections as p
from impactloom.operators import retrieval as r
from impactloom.operators import review
from impactloom.sources import scan, tables
from impactloom.streaming.events import rate_limited


def pairs(df, *cols):
    return sorted(tuple(row) for row in df.select(*cols).collect())


def test_drift_has_every_class(spark):
    base = spark.createDataFrame([("r", "1"), ("c", "1"), ("u", "1"), ("n1", None), ("n2", "1")], "artifact_key string, content_hash string")
    target = spark.createDataFrame([("a", "1"), ("c", "2"), ("u", "1"), ("n1", "1"), ("n2", None)], "artifact_key string, content_hash string")
    changes = j.compared(base, target)
    assert dict(pairs(changes, "artifact_key", "change")) == {"a": "added", "r": "removed", "c": "changed", "u": "unchanged", "n1": "unknown", "n2": "unknown"}
    s = j.drift_summary(changes).first()
    assert (s["added"], s["removed"], s["changed"], s["unchanged"], s["unknown"], s["status"]) == (1, 1, 1, 1, 2, "DRIFTED")


def test_many_changes_between_versions_cannot_be_compared(spark):
    def status(added, same, differ):
        rows = [(f"a{i}", "added") for i in range(added)] + [(f"s{i}", "unchanged") for i in range(same)]
        return j.drift_summary(spark.createDataFrame(rows, "k string, change string"), differ).first()["status"]

    assert status(8, 2, True) == "DRIFTED"  # exactly 0.8 is not over it
    assert status(9, 1, True) == "INCOMPATIBLE"
    assert status(9, 1, False) == "DRIFTED"
    assert j.drift_summary(spark.createDataFrame([], "k string, change string"), True).first()["status"] == "NO_DRIFT"


def test_retrieval_signals(spark):
    artifacts = spark.createDataFrame(
        [(1, "en:1", "API_ROUTE", "API_ENDPOINT", "src/refund.ts", "refund"), (2, "en:2", "ENTITY", "DATA_MODEL", "src/x.ts", "x"), (3, "en:3", "SERVICE", "UNKNOWN", "src/audit/y.ts", "y"), (4, "en:4", "TEST", "TEST_FILE", "z.spec.ts", "cancelxorder")],
        "artifact_id long, artifact_key string, artifact_type string, universal_kind string, file_path string, name string",
    )
    words = spark.createDataFrame([("refund", True), ("cancel_order", False)], "keyword string, glossary boolean")
    hits = dict(pairs(r.lexical_hits(artifacts, words, F.lit("a refund api")), "artifact_id", "domain"))
    assert hits == {1: 1.0, 4: 0.0}  # _ is a wildcard
    lexical = spark.createDataFrame([(1, 1.0)], "artifact_id long, domain double")
    vector = spark.createDataFrame([(2, 0.70), (4, 0.74)], "artifact_id long, similarity double")
    alone = r.scored(r.candidates(lexical, vector, None), artifacts, r.intents(F.lit("refund api")), F.lit(False))
    by_id = {row["artifact_id"]: row for row in alone.collect()}
    assert set(by_id) == {1, 4}  # 2 is under the floor
    assert by_id[4]["penalty"] == 0.05 and by_id[4]["method"] == "VECTOR"
    assert by_id[1]["kind"] == 1.0 and math.isclose(by_id[1]["score"], 0.5) and by_id[1]["method"] == "HYBRID"
    edges = spark.createDataFrame([(1, 3, "CALLS")], "from_id long, to_id long, type string")
    grown = r.scored(r.candidates(lexical, vector, edges), artifacts, r.intents(F.lit("refund")), F.lit(False))
    found = {row["artifact_id"]: row for row in grown.collect()}
    assert set(found) == {1, 2, 4}  # 3 is reached, but 0.7 * 0.15 - 0.15 is under 0
    assert found[2]["method"] == "HYBRID"  # a seed of the expansion is no vector-only hit


def test_nearest_skips_zero_vectors_and_breaks_ties(spark):
    chunks = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 7, [2.0, 0.0]), (3, 7, [0.0, 0.0]), (4, 8, [1.0, 0.0])], "artifact_id long, snapshot_id int, embedding array<double>")
    q = spark.createDataFrame([(0, 7, [1.0, 0.0])], "query_id int, snapshot_id int, embedding array<double>")
    assert pairs(r.nearest(chunks, q, 1), "artifact_id") == [(1,)]
    assert pairs(r.nearest(chunks, q, 5), "artifact_id") == [(1,), (2,)]


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "from_id long, to_id long, type string")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_paths_stop_at_depth_and_count(spark):
    chain = edges(spark, *[(i + 1, i, "CALLS") for i in range(6)], (100, 4, "TESTS"), (101, 5, "TESTS"), (102, 0, "TESTS"))
    assert pairs(g.test_paths(chain, ids(spark, 0)), "test", "n_edges") == [(100, 5), (102, 1)]  # 101 is five calls away
    many = edges(spark, *[(t, 0, "TESTS") for t in (9, 8, 7, 6)])
    assert [t for (t,) in pairs(g.test_paths(many, ids(spark, 0)), "test")] == [6, 7, 8]
    cycle = edges(spark, (1, 0, "CALLS"), (0, 1, "CALLS"), (5, 1, "TESTS"))
    assert [row["path"] for row in g.test_paths(cycle, ids(spark, 0)).collect()] == [[5, 1, 0]]
    diamond = edges(spark, (1, 0, "CALLS"), (2, 0, "CALLS"), (3, 1, "CALLS"), (3, 2, "CALLS"))
    assert pairs(g.upstream(diamond, ids(spark, 0)), "id", "depth") == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_first_path_is_depth_first_not_shortest(spark):
    e = edges(spark, (0, 1, "CALLS"), (1, 2, "CALLS"), (2, 9, "CALLS"), (0, 9, "CALLS"))
    assert g.first_path(e, ids(spark, 0), 9).first()["path"] == [0, 1, 2, 9]
    assert g.first_path(e, ids(spark, 9), 9).first()["path"] == [9]


def test_lineage_tells_cycles(spark):
    n = spark.createDataFrame([(1, 2), (2, 3), (3, None), (8, 9), (9, 8)], "id long, parent long")
    got = pairs(g.lineage(n, ids(spark, 1, 8)), "start", "id", "steps", "cycle")
    assert got == [(1, 1, 0, False), (1, 2, 1, False), (1, 3, 2, False), (8, 8, 0, False), (8, 8, 2, True), (8, 9, 1, False)]


def test_budget_cuts_once(spark):
    rows = spark.createDataFrame([("g", 1, "a" * 60), ("g", 2, "b" * 60), ("g", 3, "c"), ("h", 1, "a" * 96), ("h", 2, "b" * 60), ("h", 3, "")], "g string, k int, t string")
    kept = o.within_budget(rows, ["g"], [F.col("k")], "t", budget=100, least=5, mark="!")
    assert pairs(kept, "g", "k", "t", "truncated") == [("g", 1, "a" * 60, False), ("g", 2, "b" * 40 + "!", True), ("h", 1, "a" * 96, False)]


def test_cutoff_keeps_a_tail(spark):
    rows = spark.createDataFrame([("q", i, s) for i, s in enumerate([9.0, 8.0, 7.5, 7.3, 5.0])], "q string, i int, s double")
    assert pairs(o.adaptive_cutoff(rows, ["q"], "s", ["i"], 2, 0.1), "i") == [(0,), (1,), (2,), (3,)]
    assert pairs(o.adaptive_cutoff(rows, ["q"], "s", ["i"], 2, 0.0), "i") == [(0,), (1,)]


def test_ranges_meet_once_across_buckets(spark):
    inner = spark.createDataFrame([("f", 1, 10, 20), ("f", 2, 60, 70), ("f", 3, 190, 201), ("g", 4, 10, 20)], "file string, inner_id int, start long, end long")
    outer = spark.createDataFrame([("f", 7, 0, 200), ("f", 8, 5, 1), ("f", 9, 10, 20)], "file string, outer_id int, start long, end long")
    assert pairs(j.contained(inner, outer, ["file"]), "inner_id", "outer_id") == [(1, 7), (1, 9), (2, 7)]


def test_sets_without_members(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2)], "repo string, k int")
    f = spark.createDataFrame([("a", 2), ("b", 3)], "repo string, k int")
    got = {row["repo"]: row for row in review.prf(t, f, ["repo"], ["k"]).collect()}
    assert (got["a"]["precision"], got["a"]["recall"]) == (1.0, 0.5)
    assert (got["b"]["precision"], got["b"]["recall"], got["b"]["f1"]) == (0.0, None, 0.0)


def test_coverage_gates(spark):
    judged = spark.createDataFrame([(1, 5, "ACCEPTED"), (2, 5, "ACCEPTED"), (3, 6, None)], "analysis_id long, run_id long, decision string")
    links = spark.createDataFrame([(10, 1, 100)], "link_id long, analysis_id long, artifact_id long")
    lb = spark.createDataFrame([(10, 50)], "link_id long, evidence_id long")
    insights = spark.createDataFrame(
        [(1, 1, "UNKNOWN", "UNKNOWN", None), (2, 1, "QA_SCENARIO", "INFERRED", None), (3, 1, "CLAIM", "EVIDENCED", '{"kind":"Risk"}'), (4, 3, "CLAIM", "EVIDENCED", "[1]")],
        "insight_id long, analysis_id long, insight_type string, certainty string, metadata string",
    )
    ib = spark.createDataFrame([(1, 50), (2, 50), (3, 51)], "insight_id long, evidence_id long")
    got = {row["run_id"]: row for row in review.coverage(judged, links, lb, insights, ib).collect()}
    a, b = got[5], got[6]
    assert (a["risks"], a["risks_with_qa"], a["risks_without_qa"], a["qa_scenarios"]) == (2, 1, 1, 1)
    assert (a["review_decision"], a["qa_coverage"], a["risk_coverage"], a["repository_readiness"], a["status"]) == ("PASS", "WARN", "PASS", "WARN", "WARN")
    assert (b["review_decision"], b["risks"], b["status"], b["not_accepted"]) == ("FAIL", 0, "FAIL", [3])


def test_merges(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    n = spark.createDataFrame([("b", 9), ("c", 4), ("c", 3)], "k string, v int")
    assert pairs(tables.insert_ignore(s, n, ["k"], ["v"]), "k", "v") == [("a", 1), ("b", 2), ("c", 3)]
    assert pairs(tables.upsert(s, n.where("v <> 3"), ["k"]), "k", "v") == [("a", 1), ("b", 9), ("c", 4)]
    assert tables.differences(s, s).isEmpty()


def test_windows_open_with_a_first_event(spark):
    rows = spark.createDataFrame([(1, 5, 0), (1, 9, 1), (1, 14, 2), (1, 15, 3), (2, 5, 4), (1, 16, 5), (1, 17, 6)], "k int, t long, id int")
    got = dict(pairs(rate_limited(rows, "k", "t", "id", 2, 10), "id", "allowed"))
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 6: False}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    path = lambda s: one(spark, x.canonical_path(F.lit(s)))
    assert (path("a/./b//../c"), path("a\\b"), path("../a"), path("/a"), path("a/../..")) == ("a/c", "a/b", None, None, None)
    assert one(spark, x.content_hash(F.lit("\n a \r\n\n"))) == one(spark, F.sha2(F.lit(" a"), 256))
    assert one(spark, x.content_hash(F.lit(" \n\t"))) is None
    assert one(spark, x.redacted(F.lit("token: 'abc' and x"))) == "token=[REDACTED] and x"
    assert one(spark, x.label(F.lit("q" * 61))) == "q" * 57 + "..."
    assert one(spark, x.symbols(F.lit("éfoo_bar FooBar foo"))) == ["foo_bar", "FooBar"]
    assert one(spark, p.normal_term(F.lit("Refunds"))) == "refund" and one(spark, p.normal_term(F.lit("status"))) == "status"
    assert one(spark, p.relevant(F.lit("two refunds"), F.lit("RefundController"))) is True
    assert one(spark, p.relevant(F.lit("an api"), F.lit("api"))) is False
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_scan_of_folders(spark, tmp_path):
    for name, data in (("go.mod", b"module x"), ("src/a.go", b"package a"), ("node_modules/b.js", b"1"), ("c.bin", b"\x00\x01"), ("d.lock", b"1")):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(data)
    files = scan.read_files(spark, str(tmp_path), "r").withColumn("binary", scan.is_binary(F.col("content")))
    short = files.withColumn("path", F.substr("path", F.lit(len(str(tmp_path)) + 2)))
    got = dict(pairs(scan.enumerated(short.drop("content")), "path", "reason"))
    assert got == {"go.mod": None, "src/a.go": None, "node_modules/b.js": "IGNORED_DIRECTORY", "c.bin": "BINARY_FILE", "d.lock": "UNSUPPORTED_EXTENSION"}
    assert scan.frameworks(short).first()["languages"] == ["GO"]
    capped = scan.enumerated(short.drop("content"), max_files=1)
    assert dict(pairs(capped, "path", "reason"))["src/a.go"] == "REPO_LIMIT_EXCEEDED"


def test_limits_and_places_over_many_ranges(spark):
    """One large group, a null one and small ones, against running sums on the driver."""
    from impactloom.operators import ordering as o

    rows = [(None if i % 10 == 9 else "big" if i % 10 else f"g{i % 7}", i * 7 % 1_000, i % 13 if i % 17 else None) for i in range(1_000)]
    df = spark.createDataFrame(rows, "g string, k int, size long").repartition(7)
    want, n, total = set(), {}, {}
    for g, k, size in sorted(rows, key=lambda r: r[1]):
        n[g], total[g] = n.get(g, 0) + 1, total.get(g, 0) + (size or 0)
        want |= {(g, k)} if n[g] <= 60 and total[g] <= 300 else set()
    got = {(r["g"], r["k"]) for r in o.within_limits(df, ["g"], ["k"], "size", 60, 300).where("kept").collect()}
    assert got == want
    placed = o.places(df, [F.col("k")], "place").collect()
    assert sorted((r["place"], r["k"]) for r in placed) == [(i + 1, i) for i in range(1_000)]


def test_first_path_only_goes_where_the_goal_is(spark):
    from impactloom.operators import graph

    wide = [(0, i, "CALLS") for i in range(1, 60)] + [(i, j, "CALLS") for i in range(1, 60) for j in range(100, 160)] + [(59, 9_000, "CALLS"), (9_000, 9_999, "CALLS"), (0, 1, "TESTS")]
    e = spark.createDataFrame(wide, "from_id long, to_id long, type string")
    assert graph.first_path(e, spark.createDataFrame([(0,), (150,)], "id long"), 9_999).collect()[0]["path"] == [0, 59, 9_000, 9_999]
