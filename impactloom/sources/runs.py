"""Reports of test runs: JSON texts become observations, and what cannot be read is counted by code.

A report is a row (run_id, report, root, commit_sha, static_commit); the static cases are rows (stable_id, path, line).
Reports are parsed once into variants, so that a field of another type than expected is told apart from a missing one; suites
and cases are rows from there on, and a report with many cases is spread like any other rows.

Null, broken and too large reports, and those over a limit, give no observation and one diagnostic.  Repeated cases are
observations of their own, told apart by ``occurrence``.  A path leads from ``root`` to a file below it, or is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import first_match, lookup

# Limits of a report, and the states of cases.
MAX_REPORT_BYTES, MAX_SUITES, MAX_CASES, MAX_PATH = 20 << 20, 10_000, 10_000, 1000
OUTCOMES = {"passed": "PASSED", "failed": "FAILED", "pending": "PENDING", "todo": "TODO"}
#: Whole numbers that doubles hold exactly.
SAFE = (1 << 53) - 1


def _kind(of: str, path: str = "$") -> Column:
    return F.expr(f"coalesce(schema_of_variant(try_variant_get({of}, '{path}', 'variant')), 'VOID')")


def _text(of: str, path: str) -> Column:
    return F.when(_kind(of, path) == "STRING", F.expr(f"try_variant_get({of}, '{path}', 'string')"))


def _number(of: str, path: str) -> Column:
    return F.when(_kind(of, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.expr(f"try_variant_get({of}, '{path}', 'double')"))


def _whole(of: str, path: str, least: int) -> Column:
    x = _number(of, path)
    return F.when((x == F.floor(x)) & x.between(least, SAFE), x.cast("long"))


def _duration(of: str, path: str) -> Column:
    x = _number(of, path)
    return F.when(x >= 0, x)


def _folders(path: Column) -> Column:
    """The segments of a path without empty ones and dots; two dots go one up."""

    def step(done: Column, s: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s.isin("", "."), done).when(s == "..", up).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def relative_path(root: Column, raw: Column) -> Column:
    """Where a file lies under ``root``; null if it does not."""
    base = _folders(root)
    whole = _folders(F.when(raw.startswith("/"), raw).otherwise(F.concat_ws("/", root, raw)))
    under = (F.size(whole) > F.size(base)) & (F.slice(whole, F.lit(1), F.size(base)) == base)
    path = F.replace(F.array_join(F.slice(whole, F.size(base) + 1, F.greatest(F.size(whole), F.lit(1))), "/"), F.lit("\\"), F.lit("/"))
    strict = (F.length(path) <= MAX_PATH) & ~path.rlike("^(?i)[a-z]:") & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return F.when((raw != "") & under & strict, path)


def read(reports: DataFrame, max_bytes: int = MAX_REPORT_BYTES, max_suites: int = MAX_SUITES, max_cases: int = MAX_CASES) -> DataFrame:
    """Reports with ``suites`` (variants) and ``refused``, the code of what keeps a report from being read."""
    small = F.octet_length("report") <= max_bytes
    rows = reports.withColumn("parsed", F.try_parse_json(F.when(small, F.col("report")))).withColumn("suites", F.expr("try_variant_get(parsed, '$.testResults', 'array<variant>')"))
    n_cases = F.expr("aggregate(suites, 0L, (n, s) -> n + coalesce(size(try_variant_get(s, '$.testResults', 'array<variant>')), 0))")
    commit = "^(?:[A-Fa-f0-9]{40}|[A-Fa-f0-9]{64})$"
    refused = first_match(
        [
            (~F.coalesce(F.col("run_id").rlike("^[A-Za-z0-9._:-]{1,128}$"), F.lit(False)), "RUN_ID_UNSUPPORTED"),
            (~F.coalesce(F.col("commit_sha").rlike(commit) & F.col("static_commit").rlike(commit), F.lit(False)), "COMMIT_UNSUPPORTED"),
            (~F.coalesce(small, F.lit(True)), "REPORT_TOO_LARGE"),
            (F.col("suites").isNull(), "REPORT_UNREADABLE"),
            (F.size("suites") > max_suites, "JEST_SUITE_LIMIT_EXCEEDED"),
            (n_cases > max_cases, "JEST_CASE_LIMIT_EXCEEDED"),
        ]
    )
    return rows.withColumn("refused", refused).withColumn("n_cases", n_cases).drop("report", "parsed")


def imported(reports: DataFrame, cases: DataFrame, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(observations, diagnostics): (run_id, path, line, column, outcome, correlation, test_case, started, ended, duration, seed,
    occurrence) and (run_id, code, n)."""
    told = read(reports, **limits)
    fine = told.where("refused is null")
    suites = fine.select("run_id", "root", (F.lower("commit_sha") == F.lower("static_commit")).alias("same"), F.explode("suites").alias("s"))
    suites = suites.withColumn("results", F.expr("try_variant_get(s, '$.testResults', 'array<variant>')")).withColumn("path", relative_path(F.col("root"), _text("s", "$.testFilePath")))
    record = _kind("s").startswith("OBJECT")
    # What a script counts as no error: missing, null, false, zero and the empty text.
    quiet = _kind("s", "$.testExecError").isin("VOID") | F.expr("coalesce(try_variant_get(s, '$.testExecError', 'string'), 'x') in ('false', '0', '')")
    malformed = ~record | F.col("results").isNull()
    each = suites.select(
        "run_id",
        F.explode(F.array_compact(F.array(F.when(record & ~quiet, F.lit("SUITE_RUNTIME_ERROR")), F.when(malformed, F.lit("MALFORMED_SUITE_RESULT")), F.when(~malformed & F.col("path").isNull(), F.lit("SOURCE_PATH_OUTSIDE_REPOSITORY"))))).alias("code"),
    )
    raw = suites.where(~malformed & F.col("path").isNotNull()).select("run_id", "path", "same", F.explode("results").alias("c"))
    line, column = _whole("c", "$.location.line", 1), _whole("c", "$.location.column", 1)
    located = line.isNotNull() & column.isNotNull()
    would_run = (_kind("c", "$.wouldRun") == "BOOLEAN") & F.expr("coalesce(try_variant_get(c, '$.wouldRun', 'boolean'), false)")
    seen = raw.select(
        "run_id",
        "path",
        "same",
        F.when(located, line).alias("line"),
        F.when(located, column).alias("column"),
        lookup(_text("c", "$.status"), OUTCOMES, "UNKNOWN").alias("outcome"),
        _duration("c", "$.startAt").alias("started"),
        _duration("c", "$.duration").alias("duration"),
        first_match([(~_kind("c").startswith("OBJECT"), "MALFORMED_CASE_RESULT"), (would_run, "COLLECTION_ONLY_RESULT")]).alias("dropped"),
    )
    known = cases.groupBy("path", "line").agg(F.count(F.lit(1)).alias("candidates"), F.min("stable_id").alias("stable_id"))
    found = seen.where("dropped is null").drop("dropped").join(known, ["path", "line"], "left")
    # The first that holds: another snapshot cannot tell a case, though it has one at that line.
    why = first_match(
        [
            (F.col("line").isNotNull() & ~F.col("same"), "STATIC_SNAPSHOT_MISMATCH"),
            (F.col("candidates") > 1, "STATIC_CASE_AMBIGUOUS"),
            (F.col("line").isNull(), "SOURCE_LOCATION_MISSING"),
            (F.col("candidates").isNull(), "STATIC_CASE_UNMATCHED"),
        ]
    )
    correlation = lookup(F.col("why"), {"STATIC_SNAPSHOT_MISMATCH": "SNAPSHOT_MISMATCH", "STATIC_CASE_AMBIGUOUS": "AMBIGUOUS"}, "UNMATCHED")
    found = found.withColumn("why", why).withColumn("correlation", F.when(F.col("why").isNull(), "MATCHED").otherwise(correlation))
    found = found.withColumn("test_case", F.when(F.col("why").isNull(), F.col("stable_id")))
    number = lambda c: F.coalesce(F.col(c).cast("decimal(38,3)").cast("string"), F.lit("-"))
    parts = ["run_id", "path", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("line", "column")], number("started"), number("duration"), "outcome", F.coalesce("test_case", F.lit("-")), "correlation"]
    found = found.withColumn("seed", F.sha2(F.concat_ws("|", *parts), 256)).withColumn("ended", F.col("started") + F.col("duration"))
    # Equal seeds are equal observations, so any order numbers them alike.
    found = found.withColumn("occurrence", F.row_number().over(Window.partitionBy("run_id", "seed").orderBy("seed")))
    told_of_case = F.array_compact(
        F.array(F.col("why"), F.when(F.col("outcome") == "UNKNOWN", F.lit("UNSUPPORTED_RESULT_STATUS")), F.when(F.col("started").isNull() | F.col("duration").isNull(), F.lit("INCOMPLETE_CASE_TIMING")))
    )
    codes = (
        told.where("refused is not null").select("run_id", F.col("refused").alias("code"))
        .unionByName(fine.where("n_cases = 0").select("run_id", F.lit("NO_TEST_CASE_RESULTS").alias("code")))
        .unionByName(each)
        .unionByName(seen.where("dropped is not null").select("run_id", F.col("dropped").alias("code")))
        .unionByName(found.select("run_id", F.explode(told_of_case).alias("code")))
    )
    out = found.select("run_id", "path", "line", "column", "outcome", "correlation", "test_case", "started", "ended", "duration", "seed", "occurrence")
    return out, codes.groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("n"))


def traces(reports: DataFrame, observations: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(run_id, status, observations, diagnostics, digest) of each run; the digest is of its observations' numbered seeds, then its
    diagnostics.  A run has no more observations than ``MAX_CASES``, so its list of them is bounded."""
    seeds = observations.groupBy("run_id").agg(F.count(F.lit(1)).alias("observations"), F.sort_array(F.collect_list(F.concat_ws(":", "seed", F.col("occurrence").cast("string")))).alias("seeds"))
    codes = diagnostics.groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "code", F.col("n").cast("string")))), ",").alias("diagnostics"))
    rows = reports.select("run_id").distinct().join(seeds, "run_id", "left").join(codes, "run_id", "left").fillna({"observations": 0, "diagnostics": ""})
    digest = F.sha2(F.concat_ws(";", F.array_join(F.coalesce("seeds", F.array().cast("array<string>")), ","), "diagnostics"), 256)
    return rows.select("run_id", F.when(F.col("diagnostics") == "", "COMPLETE").otherwise("PARTIAL").alias("status"), "observations", "diagnostics", digest.alias("digest"))
