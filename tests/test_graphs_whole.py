"""Impact graphs, code edges, module look-ups, claims and catalogues on small hand-made relations."""

from pyspark.sql import functions as F

from impactloom.operators import graph as g
from impactloom.operators import review
from impactloom.sources import extract as x


def pairs(df, *cols):
    return sorted(tuple(row) for row in df.select(*cols).collect())


def impact(spark, links, edges, insights, proofs=(), nodes=50, lines=80):
    return g.impact_graph(
        spark.createDataFrame([(1, 9)], "analysis_id long, requirement_id long"),
        spark.createDataFrame(links, "analysis_id long, link_id long, artifact_id long, score double"),
        spark.createDataFrame(edges, "from_id long, to_id long, type string"),
        spark.createDataFrame(insights, "analysis_id long, insight_id long, insight_type string, review_status string"),
        spark.createDataFrame(list(proofs), "insight_id long, evidence_id long, artifact_id long"),
        nodes,
        lines,
    )


def test_room_goes_to_links_then_neighbours_then_insights(spark):
    links = [(1, 1, 10, 0.5), (1, 2, 11, 0.9), (1, 3, 10, 0.7), (1, 4, 12, 0.1)]
    edges = [(11, 20, "CALLS"), (21, 10, "TESTS"), (12, 30, "CALLS")]
    insights = [(1, 1, "CLAIM", "REJECTED"), (1, 2, "UNKNOWN", "CONFIRMED")]
    nodes, lines = impact(spark, links, edges, insights, [(2, 5, 20), (2, 4, 99)], nodes=6)
    assert pairs(nodes, "rank", "node") == [(0, "req-9"), (1, "analysis-1"), (2, "artifact-10"), (2, "artifact-11"), (2, "artifact-12"), (4, "artifact-20")]
    assert {r["truncated"] for r in nodes.collect()} == {True}
    assert ("artifact-10", "artifact-21", "TESTS") in pairs(lines, "source", "target", "type")
    nodes, lines = impact(spark, links, edges, insights, [(2, 5, 20), (2, 4, 99)])
    assert ("artifact-20", "insight-2", "RAISES_UNKNOWN") in pairs(lines, "source", "target", "type")
    assert ("analysis-1", "insight-1", "EVIDENCES") in pairs(lines, "source", "target", "type")


def test_edges_are_bounded_and_hubs_do_not_lose_the_first(spark):
    edges = [(10, 100 + i, "CALLS") for i in range(200)]
    nodes, lines = impact(spark, [(1, 1, 10, 1.0)], edges, [])
    assert nodes.count() == 50 and lines.count() == 80
    assert [r["target"] for r in lines.where("source_kind = 'DEPENDENCY'").collect() if r["target"] == "artifact-100"] == ["artifact-100"]


def test_an_analysis_without_anything(spark):
    nodes, lines = impact(spark, [], [], [])
    assert pairs(nodes, "node") == [("analysis-1",), ("req-9",)] and lines.count() == 1


def test_pages_of_scenarios(spark):
    edges = spark.createDataFrame([(t, 1, "TESTS") for t in range(10, 17)] + [(2, 1, "CALLS"), (17, 2, "TESTS"), (17, 1, "TESTS"), (1, 3, "REFERENCES")], "from_id long, to_id long, type string")
    one = spark.createDataFrame([(1,), (5,)], "id long")
    rows = {r["id"]: r for r in g.scenario_page(edges, one, 3, 3).collect()}
    assert rows[1]["scenarios"] == [13, 14, 15] and rows[1]["has_more"] and rows[1]["limitations"] == ["COMPREHENSION_LIMIT"]
    assert rows[1]["dependencies"] == [3] and rows[1]["static_calls"] == []
    assert rows[5]["scenarios"] == [] and rows[5]["limitations"] == ["NO_SUPPORTED_TEST_REFERENCE"] and not rows[5]["has_more"]


def test_code_edges_of_odd_files(spark):
    files = [("a", None), ("b", ""), ("c", "no code"), ("d", "@Injectable()\nexport class A {\n  run(x) {\n    this.b.go(x);\n  }\n}\n"), ("e", "@Injectable()\nexport class B {\n  constructor(private readonly b: A) {}\n  go() {\n    this.b.run(1);\n    this.b.run(2);\n  }\n}\n")]
    found = x.code_edges(spark.createDataFrame(files, "path string, content string"))
    assert sorted(map(tuple, found.collect())) == [("A#run", "b.go", "CALLS", "UNRESOLVED_RECEIVER"), ("B#go", "A#run", "CALLS", None)]


def test_tokens_through_modules(spark):
    provides = spark.createDataFrame(
        [("m", "A", "CLASS", "CA"), ("m", "B", "EXISTING", "A"), ("m", "F", "FACTORY", "f"), ("m", "L", "EXISTING", "L"), ("n", "X", "CLASS", "X1"), ("o", "X", "CLASS", "X2"), ("n", "H", "CLASS", "H"), ("n", "G", "EXISTING", "none")],
        "module string, token string, kind string, target string",
    )
    imports = spark.createDataFrame([("m", "n"), ("m", "o")], "module string, imported string")
    exports = spark.createDataFrame([("n", "X"), ("o", "X"), ("n", "G")], "module string, token string")
    wanted = spark.createDataFrame([("m", t) for t in "ABFLXHG"] + [("n", "X")], "module string, token string")
    found = {(r["module"], r["token"]): (r["provider"], r["outcome"]) for r in g.resolve_tokens(wanted, provides, imports, exports).collect()}
    assert found == {
        ("m", "A"): ("CA", "RESOLVED"), ("m", "B"): ("CA", "RESOLVED"), ("m", "F"): (None, "UNSUPPORTED_FACTORY"), ("m", "L"): (None, "UNRESOLVED_ALIAS"),
        ("m", "X"): (None, "AMBIGUOUS"), ("m", "H"): (None, "UNRESOLVED"), ("m", "G"): (None, "UNRESOLVED"), ("n", "X"): ("X1", "RESOLVED"),
    }


def test_catalogue(spark):
    rows = [(1, "a", "1.0.0", "STABLE", ["X", "x "], 1, False), (2, "a", "1.1.0", "PARTIAL", [], 0, False), (3, "b", "1.0", "NEW", ["x"], 1, True), (4, "a", "1.0.0", "STABLE", ["x"], 1, True)]
    found = review.catalogue_errors(spark.createDataFrame(rows, "place int, pack string, version string, status string, aliases array<string>, limits int, explicit_only boolean"))
    codes = sorted((r["place"], r["code"]) for r in found.collect())
    assert codes == sorted(
        [
            (1, "DUPLICATE_DOMAIN_PACK_ALIAS"),
            *[(2, c) for c in ("DOMAIN_PACK_ALIASES_REQUIRED", "PARTIAL_DOMAIN_PACK_REQUIRES_KNOWN_LIMITS", "PARTIAL_DOMAIN_PACK_REQUIRES_EXPLICIT_SELECTION", "MULTIPLE_ACTIVE_DOMAIN_PACK_VERSIONS_UNSUPPORTED")],
            *[(3, c) for c in ("INVALID_DOMAIN_PACK_VERSION", "INVALID_DOMAIN_PACK_STATUS", "DUPLICATE_DOMAIN_PACK_ALIAS")],
            *[(4, c) for c in ("MULTIPLE_ACTIVE_DOMAIN_PACK_VERSIONS_UNSUPPORTED", "DUPLICATE_DOMAIN_PACK_VERSION")],
        ]
    )


def test_claims(spark):
    said = [
        (1, 1, "k", "QA_SCENARIO", "EVIDENCED", 80, "Given: a When: b Then: c", None, None, None, 1, 0),
        (1, 2, "k", "QA_SCENARIO", "EVIDENCED", 80, None, "a", "", "c", 1, 0),
        (1, 3, "l", "CLAIM", "CONFLICTING", 80, "", None, None, None, 1, 0),
        (2, 4, "k", "ACCEPTANCE_CRITERIA", "EVIDENCED", 80, "x", None, None, None, 0, 1),
        (2, 5, "q", "QUESTION", "EVIDENCED", 80, "x", None, None, None, 0, 0),
    ]
    df = spark.createDataFrame(said, "analysis_id int, insight_id int, insight_key string, insight_type string, certainty string, confidence int, description string, given string, when_ string, then_ string, n_evidence int, n_related int")
    rows = {r["insight_id"]: r for r in review.normalised_claims(df).collect()}
    assert (rows[1]["insight_type"], rows[1]["certainty"], rows[1]["confidence"], rows[1]["error"]) == ("QA_SCENARIO", "EVIDENCED", 80, None)
    assert (rows[2]["insight_type"], rows[2]["certainty"], rows[2]["confidence"], rows[2]["error"]) == ("UNKNOWN", "UNKNOWN", None, "AI_OUTPUT_SCHEMA_VALIDATION_FAILED")
    assert rows[3]["evidence_integrity"] == "CONFLICTING_DOWNGRADED_INSUFFICIENT_EVIDENCE" and rows[3]["original_certainty"] == "CONFLICTING"
    assert rows[4]["certainty"] == "UNKNOWN" and rows[4]["evidence_integrity"] == "EVIDENCED_DOWNGRADED_NO_PERSISTED_EVIDENCE"
    assert rows[5]["certainty"] == "UNKNOWN" and rows[5]["evidence_integrity"] is None


def test_gates_of_nothing(spark):
    none = spark.createDataFrame([], "analysis_id long, run_id long, decision string, link_id long, artifact_id long, insight_id long, insight_type string, certainty string, metadata string, evidence_id long")
    assert review.coverage_gates(none, none, none, none, none).count() == 0
    one = spark.createDataFrame([(1, 1, "ACCEPTED")], "analysis_id long, run_id long, decision string")
    gates = review.coverage_gates(one, none, none, none, none)
    assert dict(pairs(gates.where(F.col("status") != "PASS"), "gate", "status")) == {"REPOSITORY_READINESS": "WARN"}
