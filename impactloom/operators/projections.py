"""Row-wise classification of artifacts, links, insights, diagnostics and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import all_matches, first_match, lookup

# Artifact type to universal kind.
KINDS = {
    "API_ROUTE": "API_ENDPOINT",
    "HTTP_ENDPOINT": "API_ENDPOINT",
    "SERVICE_METHOD": "DOMAIN_SERVICE",
    "ENTITY": "DATA_MODEL",
    "TEST": "TEST_FILE",
    "SPRING_TEST": "TEST_FILE",
    "JEST_TEST_CASE": "TEST_CASE",
    "SPRING_CONTROLLER_METHOD": "API_ENDPOINT",
    "SPRING_SERVICE_METHOD": "DOMAIN_SERVICE",
    "SPRING_ENTITY": "DATA_MODEL",
}
# Artifact type to chunk type.
CHUNK_TYPES = {"SERVICE_METHOD": "METHOD_BODY", "API_ROUTE": "METHOD_BODY", "ENTITY": "ENTITY_CONTEXT", "TEST": "TEST_CASE", "CLASS": "CLASS_CONTEXT", "SERVICE": "CLASS_CONTEXT"}
# Scanned edge type to stored edge type.
EDGE_TYPES = {"CALLS": "CALLS", "IMPORTS": "IMPORTS", "TESTS": "TESTS", "USES": "REFERENCES", "REFERENCES": "REFERENCES"}
# Universal kind to display group.
GROUPS = {"API_ENDPOINT": "primary", "DOMAIN_SERVICE": "secondary", "DATA_MODEL": "config", "TEST_CASE": "test", "TEST_FILE": "test", "UNKNOWN": "unknown"}
# Artifact type, else universal kind, to graph node type.
NODE_BY_TYPE = {"CONTROLLER": "CONTROLLER", "API_ROUTE": "API_ROUTE", "SERVICE_METHOD": "SERVICE_METHOD", "ENTITY": "ENTITY", "TEST": "TEST", "JEST_TEST_CASE": "TEST"}
NODE_BY_KIND = {"API_ENDPOINT": "API_ROUTE", "DOMAIN_SERVICE": "SERVICE_METHOD", "DATA_MODEL": "ENTITY", "TEST_FILE": "TEST", "TEST_CASE": "TEST"}
# Job errors that a retry cannot mend.
UNRECOVERABLE = [
    "AI_JSON_PARSE_FAILED",
    "AI_OUTPUT_SCHEMA_INVALID",
    "AI_OUTPUT_SCHEMA_VALIDATION_FAILED",
    "AI_OUTPUT_TRUNCATED",
    "AI_EMPTY_RESPONSE",
    "AI_PROVIDER_AUTH_FAILED",
    "IMPACT_ANALYSIS_NOT_FOUND",
    "SCAN_JOB_NOT_FOUND",
    "SNAPSHOT_NOT_FOUND",
    "UNSUPPORTED_FRAMEWORK",
    "UNSUPPORTED_DOMAIN",
    "UNSUPPORTED_DOMAIN_PACK",
    "UNSUPPORTED_DOMAIN_PACK_VERSION",
]
# Parts of diagnostic codes that concern the scan as a whole, and those that concern named terms.
CONTEXT_CODES = ["_NOT_EXTRACTED", "_BOUNDARY", "DI_BOUNDARY", "FILE_LIMIT", "REPO_LIMIT", "TOO_LARGE", "SKIPPED"]
CONTEXT_CATEGORIES = ["LIMIT", "FILE_SYSTEM", "SECURITY"]
LEXICAL_CODES = ["UNKNOWN_ROUTER_PATTERN", "UNSUPPORTED"]
# Generic terms that never make a diagnostic relevant.
GENERIC_TERMS = ["api", "v1", "v2", "admin", "web", "app", "core", "public"]
# What looks like a secret.
SECRETS = ["AKIA[0-9A-Z]{16}", "-----BEGIN\\s+PRIVATE\\s+KEY-----", "(?i)password\\s*="]


def universal_kind(artifact_type: Column) -> Column:
    return lookup(artifact_type, KINDS, "UNKNOWN")


def chunk_type(artifact_type: Column) -> Column:
    return lookup(artifact_type, CHUNK_TYPES, "ARTIFACT_SUMMARY")


def stored_edges(edges: DataFrame, type: str = "type") -> DataFrame:
    """Edges with stored types; those of other types are dropped."""
    return edges.withColumn(type, lookup(F.col(type), EDGE_TYPES)).where(F.col(type).isNotNull())


def display_group(kind: Column) -> Column:
    return lookup(kind, GROUPS, "unknown")


def node_type(artifact_type: Column, kind: Column, default: str | None = "SERVICE") -> Column:
    return F.coalesce(lookup(artifact_type, NODE_BY_TYPE), lookup(kind, NODE_BY_KIND), F.lit(default))


def searched(artifacts: DataFrame, text: str, types: list[str] | None = None, columns: tuple[str, ...] = ("name", "file_path", "artifact_key")) -> DataFrame:
    """Artifacts that hold ``text`` in any of the columns, in any case, and are of one of the types."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(text.lower())
    return artifacts.where(hit & F.col("artifact_type").isin(types) if types else hit)


def like_any(artifacts: DataFrame, keywords: list[str], columns: tuple[str, ...] = ("name", "file_path", "artifact_key")) -> DataFrame:
    """Artifacts whose columns match ILIKE %keyword%; % and _ in a keyword are wildcards."""
    hit = F.lit(False)
    for c in columns:
        for k in keywords:
            hit = hit | F.col(c).ilike(f"%{k}%")
    return artifacts.where(hit)


def normal_term(term: Column) -> Column:
    """A term in lower case without its architectural suffix and plural ending."""
    t = F.lower(term)
    for suffix in ("controller", "service", "route", "handler", "_id", "id"):
        t = F.regexp_replace(t, f"{suffix}$", "")
    plural = t.endswith("s") & ~t.rlike("(ss|us|is|as|os)$")
    return F.trim(F.when(t.endswith("ies"), F.regexp_replace(t, "ies$", "y")).when(plural, F.regexp_replace(t, "s$", "")).otherwise(t))


def relevant(text: Column, term: Column) -> Column:
    """Whether the text has the normal form of the term as a word, alone or in the plural."""
    t = normal_term(term)
    words = F.split(F.lower(text), "[^a-z0-9_]+")
    named = F.array_contains(words, t) | F.array_contains(words, F.concat(t, F.lit("s"))) | F.array_contains(words, F.concat(t, F.lit("es")))
    return F.coalesce((t != "") & ~t.isin(GENERIC_TERMS) & named, F.lit(False))


def propagation(code: Column, severity: Column, category: Column, n_terms: Column) -> Column:
    """How a diagnostic reaches analyses: by its terms, as context, or not at all."""

    def any_of(parts: list[str]) -> Column:
        return code.rlike("|".join(parts))

    return first_match(
        [
            ((code == "SCANNER_CAPABILITY_SUMMARY") | (severity == "INFO"), "NONE"),
            (any_of(CONTEXT_CODES) | category.isin(CONTEXT_CATEGORIES), "CONTEXT"),
            ((n_terms > 0) & any_of(LEXICAL_CODES), "LEXICAL"),
        ],
        "NONE",
    )


def suggestion(lexical: Column, graph: Column, vector: Column, final: Column) -> Column:
    return first_match(
        [
            ((lexical >= 0.5) & (graph >= 0.5), "STRONG"),
            ((graph >= 0.8) & (lexical == 0) & (vector > 0.25), "MODERATE"),
            ((vector >= 0.7) & (lexical == 0) & (graph == 0), "MODERATE"),
            ((graph > 0) & (lexical == 0) & (vector == 0), "WEAK"),
            (final < 0.3, "WEAK"),
        ],
        "MODERATE",
    )


def link_basis(method: Column, signals: Column) -> Column:
    return F.when(method.isin("HYBRID", "LEXICAL") | F.array_contains(signals, "LEXICAL"), "EVIDENCED").otherwise("INFERRED")


def link_confidence(score: Column, basis: Column) -> Column:
    """The score within the bounds of its basis; a score that is no finite number counts as 0."""
    finite = F.when(F.isnan(score) | score.isNull() | (F.abs(score) == float("inf")), F.lit(0.0)).otherwise(score)
    return F.when(basis == "EVIDENCED", F.greatest(F.lit(0.5), F.least(finite, F.lit(0.95)))).otherwise(F.greatest(F.lit(0.3), F.least(finite, F.lit(0.75))))


def is_stale(ref_type: Column, latest_sha: Column, commit_sha: Column) -> Column:
    return (ref_type != "COMMIT") & ~latest_sha.eqNullSafe(commit_sha)


def child_block(status: Column, stale: Column, decision: Column) -> Column:
    return first_match(
        [
            (stale, "STALE"),
            (status.isin("FAILED", "CANCELLED"), "FAILED"),
            (decision == "NEEDS_MORE_CLARIFICATION", "NEEDS_MORE_CLARIFICATION"),
            (decision == "REJECTED", "REJECTED"),
            (status == "WAITING_FOR_REVIEW", "WAITING_FOR_REVIEW"),
            (status != "COMPLETED", "NOT_COMPLETED"),
        ],
        "NONE",
    )


def review_decision(status: Column) -> Column:
    return lookup(status, {"CONFIRMED": "accepted", "ACCEPTED": "accepted", "REJECTED": "rejected", "NEEDS_MORE_EVIDENCE": "needs_more_evidence"}, "needs_review")


def freshness(drift: Column, added: Column, changed: Column, removed: Column) -> Column:
    """(status, severity, rerun) from a drift status and its counts; a null status is an unknown one."""
    moved = (changed > 0) | (removed > 0)
    status = lookup(drift, {"NO_DRIFT": "CURRENT", "INCOMPATIBLE": "INCOMPATIBLE", "UNKNOWN": "UNKNOWN", "DRIFTED": "DRIFTED"}, "UNKNOWN")
    severity = first_match([(drift == "NO_DRIFT", "INFO"), (drift == "INCOMPATIBLE", "HIGH"), ((drift == "DRIFTED") & moved, "HIGH")], "WARN")
    return F.struct(status.alias("status"), severity.alias("severity"), F.coalesce((drift == "INCOMPATIBLE") | ((drift == "DRIFTED") & moved), F.lit(False)).alias("rerun"))


def requirement_readiness(text: Column) -> Column:
    secret = F.lit(False)
    for p in SECRETS:
        secret = secret | text.rlike(p)
    return first_match([(F.trim(text) == "", "INVALID"), (secret, "INVALID"), (F.length(F.trim(text)) < 10, "NEEDS_CLARIFICATION")], "READY_FOR_ANALYSIS")


def report_state(job_status: Column, document_status: Column, stale: Column) -> Column:
    """(state, reasons against an export) from the last job and document; both may be null."""
    state = first_match(
        [(job_status == "QUEUED", "queued"), (job_status == "RUNNING", "running"), ((document_status == "APPROVED") | (job_status == "COMPLETED"), "completed"), (job_status == "FAILED", "failed")], "missing"
    )
    reasons = all_matches(
        [(state == "missing", "REPORT_NOT_GENERATED"), (state.isin("queued", "running"), "REPORT_GENERATION_IN_PROGRESS"), (state == "failed", "REPORT_GENERATION_FAILED"), (stale, "REPORT_STALE")]
    )
    return F.struct(state.alias("state"), reasons.alias("reasons"))


def error_class(code: Column) -> Column:
    return F.when(code.isin(UNRECOVERABLE), "UNRECOVERABLE").otherwise("RETRYABLE")


def metadata_kind(metadata: Column) -> Column:
    return F.lower(F.get_json_object(metadata, "$.kind"))


def is_risk(insight_type: Column, certainty: Column, metadata: Column) -> Column:
    return F.coalesce((insight_type == "UNKNOWN") | (certainty == "CONFLICTING") | (metadata_kind(metadata) == "risk"), F.lit(False))


def display_edges(edges: DataFrame) -> DataFrame:
    """Edges as drawn: tests point away from what they test."""
    tests = F.col("type") == "TESTS"
    return edges.select(F.when(tests, F.col("to_id")).otherwise(F.col("from_id")).alias("source"), F.when(tests, F.col("from_id")).otherwise(F.col("to_id")).alias("target"), "type", tests.alias("flipped"))


def provenance(typed: Column, metadata: Column, path: str) -> Column:
    """The typed column, else the value in the JSON metadata, else null."""
    return F.coalesce(typed, F.get_json_object(metadata, path))


def permitted(rows: DataFrame, members: DataFrame, user: int, roles: list[str], on: str = "project_id") -> DataFrame:
    """Rows of projects in which the user has one of the roles; those of other projects are hidden."""
    mine = members.where((F.col("user_id") == user) & F.col("role").isin(roles)).select(on).distinct()
    return rows.join(mine, on, "left_semi")
