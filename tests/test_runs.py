"""Reports of test runs: broken ones, limits, fields of other types, digests."""

import json

from impactloom.sources import runs

SHA = "a1" * 20
REPORT = "run_id string, report string, root string, commit_sha string, static_commit string"


def imported(spark, reports, cases=(), **limits):
    rows = spark.createDataFrame([(r, x if isinstance(x, str) or x is None else json.dumps(x), "/w", SHA, c) for r, x, c in reports], REPORT)
    seen, codes = runs.imported(rows, spark.createDataFrame(list(cases), "stable_id string, path string, line long"), **limits)
    told = {(r["run_id"], r["code"]): r["n"] for r in codes.collect()}
    return seen.collect(), told, {r["run_id"]: r for r in runs.traces(rows, seen, codes).collect()}


def suite(*cases, path="/w/a.spec.ts", **more):
    return {"testFilePath": path, "testResults": list(cases), **more}


def case(line=3, status="passed", **more):
    return {"status": status, "location": {"line": line, "column": 5}, "startAt": 10, "duration": 2.5, **more}


def test_cases_meet_the_static_index(spark):
    cases = [("one", "a.spec.ts", 3), ("two", "a.spec.ts", 4), ("three", "a.spec.ts", 4)]
    seen, told, traces = imported(spark, [("r", {"testResults": [suite(case(3), case(4), case(9), case(3, "failed"))]}, SHA.upper()), ("old", {"testResults": [suite(case(3))]}, "b" * 40)], cases)
    assert {(x["run_id"], x["line"], x["outcome"], x["correlation"], x["test_case"]) for x in seen} == {
        ("r", 3, "PASSED", "MATCHED", "one"),
        ("r", 4, "PASSED", "AMBIGUOUS", None),
        ("r", 9, "PASSED", "UNMATCHED", None),
        ("r", 3, "FAILED", "MATCHED", "one"),
        ("old", 3, "PASSED", "SNAPSHOT_MISMATCH", None),
    }
    assert {(x["started"], x["ended"], x["duration"]) for x in seen} == {(10.0, 12.5, 2.5)}
    assert told == {("r", "STATIC_CASE_AMBIGUOUS"): 1, ("r", "STATIC_CASE_UNMATCHED"): 1, ("old", "STATIC_SNAPSHOT_MISMATCH"): 1}
    assert traces["r"]["status"] == "PARTIAL" and traces["r"]["observations"] == 4


def test_what_cannot_be_read_is_counted(spark):
    odd = [case(status=7), case(line="3"), case(line=2.5), case(startAt=-1), case(wouldRun=True), case(wouldRun="true"), "text", None, [1]]
    suites = [suite(*odd), suite(case(), path="/w/../x.ts"), suite(case(), path=5), suite(path="/w"), 17, {"testFilePath": "/w/b.ts"}, suite(testExecError={"m": 1}), suite(testExecError=False)]
    seen, told, _ = imported(spark, [("r", {"testResults": suites}, SHA)])
    codes = {code: n for (_, code), n in told.items()}
    assert len(seen) == 5
    assert codes == {
        "UNSUPPORTED_RESULT_STATUS": 1,
        "SOURCE_LOCATION_MISSING": 2,
        "STATIC_CASE_UNMATCHED": 3,
        "INCOMPLETE_CASE_TIMING": 1,
        "COLLECTION_ONLY_RESULT": 1,
        "MALFORMED_CASE_RESULT": 3,
        "SOURCE_PATH_OUTSIDE_REPOSITORY": 3,
        "MALFORMED_SUITE_RESULT": 2,
        "SUITE_RUNTIME_ERROR": 1,
    }


def test_refused_reports_and_limits(spark):
    two = {"testResults": [suite(case(), case()), suite(case())]}
    reports = [("broken", '{"testResults": [', SHA), ("none", None, SHA), ("list", [1], SHA), ("empty", {"testResults": []}, SHA), ("two", two, SHA), ("bad id!", two, SHA), ("commit", two, "abc")]
    seen, told, traces = imported(spark, reports, max_cases=2)
    assert seen == [] and told == {
        ("broken", "REPORT_UNREADABLE"): 1,
        ("none", "REPORT_UNREADABLE"): 1,
        ("list", "REPORT_UNREADABLE"): 1,
        ("empty", "NO_TEST_CASE_RESULTS"): 1,
        ("two", "JEST_CASE_LIMIT_EXCEEDED"): 1,
        ("bad id!", "RUN_ID_UNSUPPORTED"): 1,
        ("commit", "COMMIT_UNSUPPORTED"): 1,
    }
    assert {t["status"] for t in traces.values()} == {"PARTIAL"}
    assert imported(spark, [("two", two, SHA)], max_suites=1)[1] == {("two", "JEST_SUITE_LIMIT_EXCEEDED"): 1}
    assert imported(spark, [("two", two, SHA)], max_bytes=50)[1] == {("two", "REPORT_TOO_LARGE"): 1}
    assert imported(spark, [])[0] == []


def test_digests_do_not_hang_on_the_order(spark):
    one, other = case(3), case(4, "todo")
    cases = [("one", "a.spec.ts", 3), ("two", "a.spec.ts", 4)]
    traces = [imported(spark, [("r", {"testResults": s}, SHA)], cases) for s in ([suite(one, other, one)], [suite(one), suite(other, one)], [suite(one, other)])]
    first, same, less = (t[2]["r"] for t in traces)
    assert first["digest"] == same["digest"] != less["digest"] and first["status"] == "COMPLETE"
    assert sorted(x["occurrence"] for x in traces[0][0]) == [1, 1, 2]
