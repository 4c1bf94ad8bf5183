"""Findings of round 4: steps that cost no more than their input asks for, and methods with all of their steps."""

import pytest


def test_artifacts_are_read_without_writing_or_joining_tokens(spark, monkeypatch):
    from impactloom.sources import spans

    monkeypatch.setattr(spans, "stored", lambda *a: pytest.fail("tokens are written, and joined with one another"))
    text = "@Controller('c') export class C {{ @Get('g{0}') m(a: A<B, D>, b?) {{ if (a) {{ throw b }} switch (a) {{ case 1: b; default: c }} }} }}"
    files = spark.createDataFrame([(f"f{i}.ts", text.format(i)) for i in range(3)], "path string, content string")
    for found in (spans.artifacts(files), spans.decorated(files)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # Only contents are joined, from which the texts of artifacts are cut.
        assert plan.count("Join") == ("signature" in found.columns)
        assert len(found.collect()) == 3
    got = spans.artifacts(files).where("path = 'f1.ts'").collect()[0]
    assert (got["symbol"], got["route"], [tuple(p) for p in got["parameters"]]) == ("C.m", "g1", [("a", "A<B, D>", "a: A<B, D>"), ("b", "UNDECLARED", "b?")])
    assert [tuple(c)[:2] for c in got["conditions"]] == [("IF", "a"), ("SWITCH_CASE", "case 1: b;"), ("SWITCH_DEFAULT", "default: c")]
    assert [tuple(h)[:2] for h in got["handlers"]] == [("THROW", "throw b")]


def test_behaviour_of_specs_has_all_kinds_of_claims(spark):
    from __spark_entry__ import queries

    found = queries()["src_jest_behav"](spark, "/root/testdata/sf0.001").collect()
    assert {r["kind"] for r in found} == {"SETUP_HOOK", "TEARDOWN_HOOK", "INPUT", "MOCK", "ACTION", "ASSERTION", "EXPECTED_OUTCOME"}
    # Assertions know the call that they are about, outcomes their assertion; skipped and repeated cases state nothing.
    assert any(r["invocation_start"] for r in found) and all((r["assertion_start"] is not None) == (r["kind"] == "EXPECTED_OUTCOME") for r in found)
    assert not {r["title"] for r in found} & {"skipped", "twice"}


def test_lines_of_impact_graphs_are_shuffled_once(spark):
    from __spark_entry__ import queries

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = queries()["gr_impact_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # Links, insights and their evidence share one shuffle of lines, dependencies have another of fewer columns.
    scans = [x for x in plan.split("\n") if "FileScan" in x and "l_orderkey" in x]
    assert len(scans) == 2 and sum("l_suppkey" in x for x in scans) == 1


def test_ends_of_edges_are_packed_without_loss(spark):
    from impactloom.operators import graph as g

    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    big = 1 << 40
    links = table([(1, 1, 10, 0.5), (2, 2, big, 0.5)], "analysis_id long, link_id long, artifact_id long, score double")
    edges = [(10, 11, "CALLS"), (10, 11, None), (10, big, "CALLS"), (12, 10, "TESTS"), (13, 10, "CALLS"), (big, 3, "CALLS"), (-(1 << 31) - 1, big, None)]
    none = table([], "analysis_id long, insight_id long, insight_type string, review_status string"), table([], "insight_id long, evidence_id long, artifact_id long")
    lines = g.impact_graph(table([(1, 7), (2, 8), (3, 9)], "analysis_id long, requirement_id long"), links, table(edges, "from_id long, to_id long, type string"), *none)[1]
    got = sorted((r["analysis_id"], r["source"], r["target"], r["type"] or "") for r in lines.where("source_kind = 'DEPENDENCY'").collect())
    drawn = [(a, b, t) if t != "TESTS" else (b, a, t) for a, b, t in edges]
    assert got == sorted((n, f"artifact-{a}", f"artifact-{b}", t or "") for n, of in ((1, 10), (2, big)) for a, b, t in drawn if of in (a, b))
