"""Findings of round 3: whole results beyond what the smallest tables show, and steps that grow no faster than their input."""

import random

import pytest

from impactloom.operators import joins as j
from impactloom.sources import scan, tables


def test_sums_of_contained_ranges_equal_those_of_pairs(spark):
    r = random.Random(3)
    inner = [(r.choice("ab"), i, s, s + r.randint(0, 20)) for i in r.sample(range(10_000), 400) for s in [r.randint(-5, 90)]]
    outer = [(r.choice("abc"), i, s, s + r.randint(-2, 70)) for i in range(120) for s in [r.randint(-5, 90)]]
    i = spark.createDataFrame(inner, "file string, inner_id long, start long, end long")
    o = spark.createDataFrame(outer, "file string, outer_id long, start long, end long")
    got = {x["outer_id"]: (x["n"], x["first"]) for x in j.contained_sums(i, o, ["file"], 3).collect()}
    inside = {b[1]: sorted(a[1] for a in inner if a[0] == b[0] and a[2] >= b[2] and a[3] <= b[3]) for b in outer}
    assert got == {k: (len(v), v[:3]) for k, v in inside.items()}
    assert j.contained_sums(i, o.limit(0), ["file"], 3).collect() == []


def test_claims_make_no_pairs(spark, monkeypatch):
    from impactloom.registry import QUERIES

    monkeypatch.setattr(j, "contained", lambda *a, **k: pytest.fail("pairs grow with the square of a file's ranges"))
    assert QUERIES["jn_claims"](spark, "/root/testdata/sf0.001").count() > 0


def test_equal_ranges_are_joined_as_one_and_their_pairs_leave_in_order(spark, monkeypatch):
    r = random.Random(6)
    spans = [(r.choice("ab"), s, s + r.randint(0, 9), s - r.randint(0, 9), s + r.randint(5, 60)) for s in range(20)]
    inner = [(f, n, s, e) for n, (f, s, e, _, _) in enumerate(r.sample(spans * 60, 1_200))] + [("a", None, 4, 5), ("a", None, 4, 5), (None, 1, 4, 5), ("a", 2, None, 5)]
    outer = [(f, n, s, e) for n, (f, _, _, s, e) in enumerate(r.sample(spans * 60, 1_200))] + [("a", None, 3, 9), ("b", -1, 9, 3), ("a", -2, 0, 10**9)]
    i = spark.createDataFrame(inner, "file string, inner_id long, start long, end long")
    o = spark.createDataFrame(outer, "file string, outer_id long, start long, end long")
    want = sorted(str((a[0], a[1], b[1])) for a in inner for b in outer if a[0] and a[0] == b[0] and None not in a[2:] and a[2] >= b[2] and a[3] <= b[3])
    for size, pairs in ((7, 1_000), (j.LIST, j.PAIRS_A_TASK)):
        monkeypatch.setattr(j, "LIST", size)
        monkeypatch.setattr(j, "PAIRS_A_TASK", pairs)
        assert sorted(str(tuple(x)) for x in j.contained(i, o, ["file"]).collect()) == want
    # An outer_id stays for all the inner ones of a range, so that files of pairs, which grow with the square of the lines, are small.
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    ids = [x["outer_id"] for x in j.contained(i, o, ["file"]).collect()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert sum(x != y for x, y in zip(ids, ids[1:])) < len(want) / 20
    assert j.contained(i, o.limit(0), ["file"]).collect() == []


def test_copies_from_several_old_artifacts_are_all_stored(spark):
    stored = spark.createDataFrame([(1, 0, 5), (2, 0, 5), (3, 0, 6), (9, 0, 7)], "artifact_id long, snapshot_id long, code long")
    plan = spark.createDataFrame([(1, 4, 0), (2, 4, 0), (3, 4, 0), (1, 9, 0)], "old_id long, artifact_id long, snapshot_id long")
    got = sorted(map(tuple, tables.copied(stored, plan).collect()))
    assert got == [(1, 0, 5), (2, 0, 5), (3, 0, 6), (4, 0, 5), (4, 0, 5), (4, 0, 6), (9, 0, 7)]


def test_domains_are_read_from_all_paths(spark):
    paths = [("r", f"a{i:04}.ts") for i in range(300)] + [("r", "z/booking.ts"), ("r", "z/reservation.ts")]
    assert scan.domains(spark.createDataFrame(paths, "repository string, path string")).collect()[0]["domain"] == "BOOKING"


def test_tokens_of_many_files_are_dealt_by_their_number(spark, monkeypatch):
    from impactloom.sources import spans

    files = spark.createDataFrame([(f"f{i}.ts", "/* " + "x\n" * 50 + "*/\nconst a = 1") for i in range(40)], "path string, content string")
    whole = sorted(map(tuple, spans.tokens(files).select("path", "i", "t", "start", "line").collect()))
    assert whole[:2] == [("f0.ts", 1, "const", 106, 52), ("f0.ts", 2, "a", 112, 52)]
    monkeypatch.setattr(spans, "FILES_A_TASK", 10)
    assert spans.dealt(files).rdd.getNumPartitions() == 5
    assert sorted(map(tuple, spans.tokens(files).select("path", "i", "t", "start", "line").collect())) == whole
    # Sorted for their places are lengths, not the texts of comments.
    plan = spans.lexed(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "whole" not in plan[: plan.index("Window")]


def test_lookups_of_tokens_are_dealt_by_the_number_of_files(spark, monkeypatch):
    from impactloom.sources import spans, specs

    files = spark.createDataFrame([(f"f{i}.spec.ts", f"describe('s', () => {{ it('a{i}', () => {{ expect(run({i})).toBe(1) }}) }})") for i in range(60)], "path string, content string")
    monkeypatch.setattr(spans, "FILES_A_TASK", 10)
    toks = spans.tokens(files)
    for found in (specs.declarations(toks), specs.calls(specs.with_functions(toks))):
        # Small files of many equal rows are neither broadcast nor put together in one task.
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.rdd.getNumPartitions() == 7
    assert specs.declarations(toks).count() == 120
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert sorted((r["subject"], r["kind"]) for r in specs.assertions(files).collect()) == sorted((f"run({i})", "RETURN_VALUE") for i in range(60))


def test_edges_of_impact_graphs_are_shuffled_as_lists_and_not_written(spark, monkeypatch):
    from impactloom.operators import graph as g
    from __spark_entry__ import QUERIES

    monkeypatch.setattr(g, "cut", lambda df: pytest.fail("written are all edges of all analyses"))
    for name in ("gr_impact", "gr_impact_edges"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        # Nothing is grouped or joined after the lists of an analysis are laid out as rows.
        assert plan.count("Generate explode") == 1, name


def test_ends_that_are_artifacts_themselves_bring_an_edge_once(spark):
    from impactloom.operators import graph as g

    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    links = table([(1, 1, 10, 0.5), (1, 2, 11, 0.9), (2, 3, 11, 0.1)], "analysis_id long, link_id long, artifact_id long, score double")
    edges = table([(10, 11, "CALLS"), (11, 10, "TESTS"), (10, 11, "TESTS"), (11, 12, None)], "from_id long, to_id long, type string")
    told = table([(2, 5, "CLAIM", "CONFIRMED"), (2, 6, "CLAIM", "REJECTED")], "analysis_id long, insight_id long, insight_type string, review_status string")
    proofs = table([(5, 1, 99), (5, 2, 12), (5, 3, 10), (6, 1, None)], "insight_id long, evidence_id long, artifact_id long")
    nodes, lines = g.impact_graph(table([(1, 7), (2, 8), (3, 9)], "analysis_id long, requirement_id long"), links, edges, told, proofs)
    got = sorted((r["analysis_id"], r["source"], r["target"], r["type"] or "") for r in lines.where("source_kind IN ('DEPENDENCY', 'EVIDENCE_LINK')").collect())
    first = [("artifact-10", "artifact-11", "CALLS"), ("artifact-10", "artifact-11", "TESTS"), ("artifact-11", "artifact-10", "TESTS"), ("artifact-11", "artifact-12", "")]
    assert got == sorted([(a, *x) for a in (1, 2) for x in first] + [(2, "artifact-12", "insight-5", "EVIDENCES"), (2, "analysis-2", "insight-6", "EVIDENCES")])
    assert sorted((r["analysis_id"], r["node"]) for r in nodes.where("rank = 4").collect()) == [(1, "artifact-12"), (2, "artifact-10"), (2, "artifact-12")]


def test_review_coverage_reads_no_evidence(spark):
    from __spark_entry__ import QUERIES

    plan = QUERIES["agg_reviewcov"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_shared_words_are_counted_without_pairs(spark):
    from impactloom.operators import retrieval

    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    asked = [(i, r.sample(words, r.randint(0, 12)) or None) for i in range(15)]
    held = [(i, r.sample(words + ["x"], r.randint(0, 12))) for i in r.sample(range(1000), 200)] + [(2000, None)]
    q, a = spark.createDataFrame(asked, "request_id int, words array<string>"), spark.createDataFrame(held, "artifact_id long, words array<string>")
    want = []
    for i, w in asked:
        counts = sorted((-len(set(w or ()) & set(v or ())), j) for j, v in held)
        want += [(i, j, -n) for n, j in counts[:4] if n]
    for limit in (100, 4):
        found = retrieval.most_shared(q, a, 4, limit)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Join" not in retrieval.most_shared(q, a, 4)._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_of_many_equal_vectors_are_the_smallest_identifiers(spark):
    from impactloom.operators import retrieval

    rows = [(i, i % 2, [0.1, 0.2, 0.7] if i % 3 else [0.1 * i, 1.0, -0.3]) for i in range(5_000)] + [(6_000, 0, [1.0, 2.0]), (6_001, 0, None), (6_002, 0, [0.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "artifact_id long, snapshot_id int, embedding array<double>").repartition(3)
    asked = [(i, 0 if i % 2 else None, [0.1, 0.2, 0.7]) for i in range(40)] + [(90, 0, [0.0, 0.0, 0.0]), (91, 1, [2.0, 4.0])]
    got = {}
    found = retrieval.nearest(chunks, spark.createDataFrame(asked, "query_id long, snapshot_id int, embedding array<double>"), 3)
    for x in found.collect():
        got.setdefault(x["query_id"], []).append((x["artifact_id"], x["similarity"]))
    assert {i: sorted(j for j, _ in got[i]) for i in range(40)} == {i: [2, 4, 8] if i % 2 else [1, 2, 4] for i in range(40)}
    assert sorted(got[90]) == [(0, None), (2, None), (4, None)] and 91 not in got
    # Vectors meet in products of matrices, not one by one in expressions.
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
