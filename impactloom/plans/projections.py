"""Queries over row-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projections as p
from ..registry import query
from .views import oracle, view


def case(key: str, values: dict[str, str], default: str | None) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {'NULL' if default is None else repr(default)} END"


@query("prj_kind", oracle(f"SELECT artifact_id, {case('artifact_type', p.KINDS, 'UNKNOWN')} AS kind FROM v_artifact"))
def prj_kind(spark, sf):
    return view(spark, sf, "v_artifact").select("artifact_id", p.universal_kind(F.col("artifact_type")).alias("kind"))


@query("prj_chunktype", oracle(f"SELECT artifact_id, {case('artifact_type', p.CHUNK_TYPES, 'ARTIFACT_SUMMARY')} AS chunk_type FROM v_artifact"))
def prj_chunktype(spark, sf):
    return view(spark, sf, "v_artifact").select("artifact_id", p.chunk_type(F.col("artifact_type")).alias("chunk_type"))


_SCANNED = "SELECT l_partkey AS from_id, l_suppkey AS to_id, CASE qty % 6 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'USES' WHEN 2 THEN 'IMPORTS' WHEN 3 THEN 'TESTS' WHEN 4 THEN 'REFERENCES' ELSE 'EXTENDS' END AS type FROM v_line"


@query("prj_edge", oracle(f"SELECT from_id, to_id, {case('type', p.EDGE_TYPES, None)} AS type FROM e WHERE type <> 'EXTENDS'", ("e", _SCANNED)))
def prj_edge(spark, sf):
    scanned = spark.sql(_SCANNED.replace("v_line", "{lines}"), lines=view(spark, sf, "v_line"))
    return p.stored_edges(scanned)


@query("prj_group", oracle(f"SELECT artifact_id, {case('universal_kind', p.GROUPS, 'unknown')} AS display_group FROM v_artifact"))
def prj_group(spark, sf):
    return view(spark, sf, "v_artifact").select("artifact_id", p.display_group(F.col("universal_kind")).alias("display_group"))


@query("prj_nodetype", oracle(f"SELECT artifact_id, coalesce({case('artifact_type', p.NODE_BY_TYPE, None)}, {case('universal_kind', p.NODE_BY_KIND, None)}, 'SERVICE') AS node_type FROM v_artifact"))
def prj_nodetype(spark, sf):
    return view(spark, sf, "v_artifact").select("artifact_id", p.node_type(F.col("artifact_type"), F.col("universal_kind")).alias("node_type"))


@query(
    "flt_search",
    oracle("SELECT artifact_id, artifact_key FROM v_artifact WHERE (lower(name) LIKE '%th%' OR lower(file_path) LIKE '%th%' OR lower(artifact_key) LIKE '%th%') AND artifact_type IN ('ENTITY', 'SERVICE') ORDER BY artifact_key LIMIT 50 OFFSET 5"),
)
def flt_search(spark, sf):
    found = p.searched(view(spark, sf, "v_artifact"), "TH", ["ENTITY", "SERVICE"])
    return found.select("artifact_id", "artifact_key").orderBy("artifact_key").offset(5).limit(50)


@query(
    "flt_ilike_any",
    oracle("SELECT artifact_id FROM v_artifact WHERE name ILIKE '%e_s%' OR file_path ILIKE '%e_s%' OR artifact_key ILIKE '%e_s%' OR name ILIKE '%TH%' OR file_path ILIKE '%TH%' OR artifact_key ILIKE '%TH%'"),
)
def flt_ilike_any(spark, sf):
    return p.like_any(view(spark, sf, "v_artifact"), ["e_s", "TH"]).select("artifact_id")


_TERMS = ["Thers", "theService", "entries", "apis", "andController", "the_id", "ins"]


def _normal_sql(t: str) -> str:
    out = f"lower({t})"
    for s in ("controller", "service", "route", "handler", "_id", "id"):
        out = f"regexp_replace({out}, '{s}$', '')"
    return f"(SELECT trim(CASE WHEN x LIKE '%ies' THEN x[:-4] || 'y' WHEN x LIKE '%s' AND NOT regexp_matches(x, '(ss|us|is|as|os)$') THEN x[:-2] ELSE x END) FROM (SELECT {out} AS x))"


_TERM_ROWS = ", ".join(f"('{t}')" for t in _TERMS)


@query(
    "flt_relevance",
    oracle(
        f"""SELECT request_id, term FROM v_request, (SELECT term, {_normal_sql('term')} AS t FROM (VALUES {_TERM_ROWS}) v(term)) n
WHERE t <> '' AND t NOT IN ('api', 'v1', 'v2', 'admin', 'web', 'app', 'core', 'public')
 AND (list_contains(string_split_regex(lower(text), '[^a-z0-9_]+'), t) OR list_contains(string_split_regex(lower(text), '[^a-z0-9_]+'), t || 's') OR list_contains(string_split_regex(lower(text), '[^a-z0-9_]+'), t || 'es'))"""
    ),
)
def flt_relevance(spark, sf):
    each = view(spark, sf, "v_request").select("request_id", "text", F.explode(F.array(*[F.lit(t) for t in _TERMS])).alias("term"))
    return each.where(p.relevant(F.col("text"), F.col("term"))).select("request_id", "term")


_PROPAGATION = """CASE WHEN code = 'SCANNER_CAPABILITY_SUMMARY' OR severity = 'INFO' THEN 'NONE'
 WHEN code LIKE '%\\_BOUNDARY%' ESCAPE '\\' OR code LIKE '%FILE\\_LIMIT%' ESCAPE '\\' OR category IN ('LIMIT', 'FILE_SYSTEM', 'SECURITY') THEN 'CONTEXT'
 WHEN term IS NOT NULL AND code LIKE '%UNSUPPORTED%' THEN 'LEXICAL' ELSE 'NONE' END"""


@query("flt_propagation", oracle(f"SELECT event_id, {_PROPAGATION} AS mode FROM v_diagnostic"))
def flt_propagation(spark, sf):
    d = view(spark, sf, "v_diagnostic")
    return d.select("event_id", p.propagation(F.col("code"), F.col("severity"), F.col("category"), F.col("term").isNotNull().cast("int")).alias("mode"))


_SCORES = "SELECT line_id, (qty % 3) / 2.0 AS lexical, (qty % 5) / 4.0 AS graph, (pct % 6) / 5.0 AS vector, (qty % 10) / 10.0 AS final, CASE qty % 4 WHEN 0 THEN 'HYBRID' WHEN 1 THEN 'LEXICAL' WHEN 2 THEN 'VECTOR' ELSE 'GRAPH_EXPANSION' END AS method, CASE WHEN pct % 2 = 0 THEN 'LEXICAL' ELSE 'GRAPH' END AS signal FROM v_line"


def _scores(spark, sf):
    s = spark.sql(_SCORES.replace("v_line", "{lines}"), lines=view(spark, sf, "v_line"))
    return s.select("line_id", *[F.col(c).cast("double").alias(c) for c in ("lexical", "graph", "vector", "final")], "method", "signal")


@query(
    "prj_suggest",
    oracle(
        """SELECT line_id, CASE WHEN lexical >= 0.5 AND graph >= 0.5 THEN 'STRONG' WHEN graph >= 0.8 AND lexical = 0 AND vector > 0.25 THEN 'MODERATE' WHEN vector >= 0.7 AND lexical = 0 AND graph = 0 THEN 'MODERATE'
 WHEN graph > 0 AND lexical = 0 AND vector = 0 THEN 'WEAK' WHEN final < 0.3 THEN 'WEAK' ELSE 'MODERATE' END AS confidence FROM s""",
        ("s", _SCORES),
    ),
)
def prj_suggest(spark, sf):
    return _scores(spark, sf).select("line_id", p.suggestion(*[F.col(c) for c in ("lexical", "graph", "vector", "final")]).alias("confidence"))


_BASIS = "CASE WHEN method IN ('HYBRID', 'LEXICAL') OR signal = 'LEXICAL' THEN 'EVIDENCED' ELSE 'INFERRED' END"


@query("prj_linkbasis", oracle(f"SELECT line_id, {_BASIS} AS basis FROM s", ("s", _SCORES)))
def prj_linkbasis(spark, sf):
    return _scores(spark, sf).select("line_id", p.link_basis(F.col("method"), F.array("signal")).alias("basis"))


@query("prj_confclamp", oracle(f"SELECT line_id, CASE WHEN {_BASIS} = 'EVIDENCED' THEN greatest(0.5, least(final, 0.95)) ELSE greatest(0.3, least(final, 0.75)) END::DOUBLE AS confidence FROM s", ("s", _SCORES)))
def prj_confclamp(spark, sf):
    return _scores(spark, sf).select("line_id", p.link_confidence(F.col("final"), p.link_basis(F.col("method"), F.array("signal"))).alias("confidence"))


_STALE = "(ref_type <> 'COMMIT' AND latest_sha IS DISTINCT FROM commit_sha)"


@query("prj_stale", oracle(f"SELECT analysis_id, {_STALE} AS stale FROM v_analysis"))
def prj_stale(spark, sf):
    return view(spark, sf, "v_analysis").select("analysis_id", p.is_stale(F.col("ref_type"), F.col("latest_sha"), F.col("commit_sha")).alias("stale"))


_LATEST = "SELECT analysis_id, arg_max(decision, (decided_at, decision_id)) AS decision FROM v_decision GROUP BY analysis_id"
BLOCK_SQL = f"""CASE WHEN {_STALE} THEN 'STALE' WHEN status = 'FAILED' THEN 'FAILED' WHEN decision = 'NEEDS_MORE_CLARIFICATION' THEN 'NEEDS_MORE_CLARIFICATION' WHEN decision = 'REJECTED' THEN 'REJECTED'
 WHEN status = 'WAITING_FOR_REVIEW' THEN 'WAITING_FOR_REVIEW' WHEN status <> 'COMPLETED' THEN 'NOT_COMPLETED' ELSE 'NONE' END"""


def judged(spark, sf):
    """Analyses with their latest decision and whether they are stale."""
    last = view(spark, sf, "v_decision").groupBy("analysis_id").agg(F.max_by("decision", F.struct("decided_at", "decision_id")).alias("decision"))
    return view(spark, sf, "v_analysis").join(last, "analysis_id", "left").withColumn("stale", p.is_stale(F.col("ref_type"), F.col("latest_sha"), F.col("commit_sha")))


JUDGED = f"SELECT a.*, decision, {_STALE} AS stale FROM v_analysis a LEFT JOIN ({_LATEST}) d USING (analysis_id)"


@query("prj_block_child", oracle(f"SELECT analysis_id, {BLOCK_SQL} AS reason FROM j", ("j", JUDGED)))
def prj_block_child(spark, sf):
    return judged(spark, sf).select("analysis_id", p.child_block(F.col("status"), F.col("stale"), F.col("decision")).alias("reason"))


@query("prj_decision", oracle("SELECT link_id, CASE WHEN coalesce(decision, review_status) IN ('CONFIRMED', 'ACCEPTED') THEN 'accepted' WHEN coalesce(decision, review_status) = 'REJECTED' THEN 'rejected' WHEN coalesce(decision, review_status) = 'NEEDS_MORE_EVIDENCE' THEN 'needs_more_evidence' ELSE 'needs_review' END AS current_decision FROM v_link"))
def prj_decision(spark, sf):
    return view(spark, sf, "v_link").select("link_id", p.review_decision(F.coalesce("decision", "review_status")).alias("current_decision"))


_DRIFTS = "SELECT line_id, CASE qty % 5 WHEN 0 THEN 'NO_DRIFT' WHEN 1 THEN 'INCOMPATIBLE' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'DRIFTED' ELSE NULL END AS drift, pct % 2 AS added, qty % 2 AS changed, pct % 3 AS removed FROM v_line"


@query(
    "prj_freshness",
    oracle(
        """SELECT line_id, CASE WHEN drift = 'NO_DRIFT' THEN 'CURRENT' ELSE coalesce(drift, 'UNKNOWN') END AS status,
 CASE WHEN drift = 'NO_DRIFT' THEN 'INFO' WHEN drift = 'INCOMPATIBLE' OR (drift = 'DRIFTED' AND changed + removed > 0) THEN 'HIGH' ELSE 'WARN' END AS severity,
 coalesce(drift = 'INCOMPATIBLE' OR (drift = 'DRIFTED' AND changed + removed > 0), false) AS rerun FROM d""",
        ("d", _DRIFTS),
    ),
)
def prj_freshness(spark, sf):
    d = spark.sql(_DRIFTS.replace("v_line", "{lines}"), lines=view(spark, sf, "v_line"))
    return d.select("line_id", p.freshness(*[F.col(c) for c in ("drift", "added", "changed", "removed")]).alias("f")).select("line_id", "f.*")


@query(
    "prj_reqready",
    oracle("SELECT conv_id, turn, CASE WHEN trim(text) = '' OR regexp_matches(text, 'AKIA[0-9A-Z]{16}') OR regexp_matches(text, '-----BEGIN\\s+PRIVATE\\s+KEY-----') OR regexp_matches(text, '(?i)password\\s*=') THEN 'INVALID' WHEN length(trim(text)) < 10 THEN 'NEEDS_CLARIFICATION' ELSE 'READY_FOR_ANALYSIS' END AS readiness FROM conversations"),
)
def prj_reqready(spark, sf):
    return view(spark, sf, "conversations").select("conv_id", "turn", p.requirement_readiness(F.col("text")).alias("readiness"))


_JOBS = "SELECT line_id, CASE qty % 5 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'FAILED' ELSE NULL END AS job, CASE pct % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'DRAFT' ELSE NULL END AS doc, flag = 'N' AS stale FROM v_line"


@query(
    "prj_reportstate",
    oracle(
        """SELECT line_id, state, concat_ws(',', CASE WHEN state = 'missing' THEN 'REPORT_NOT_GENERATED' END, CASE WHEN state IN ('queued', 'running') THEN 'REPORT_GENERATION_IN_PROGRESS' END,
 CASE WHEN state = 'failed' THEN 'REPORT_GENERATION_FAILED' END, CASE WHEN stale THEN 'REPORT_STALE' END) AS reasons
FROM (SELECT line_id, stale, CASE WHEN job IN ('QUEUED', 'RUNNING') THEN lower(job) WHEN doc = 'APPROVED' OR job = 'COMPLETED' THEN 'completed' WHEN job = 'FAILED' THEN 'failed' ELSE 'missing' END AS state FROM j) x""",
        ("j", _JOBS),
    ),
)
def prj_reportstate(spark, sf):
    j = spark.sql(_JOBS.replace("v_line", "{lines}"), lines=view(spark, sf, "v_line"))
    return j.select("line_id", p.report_state(F.col("job"), F.col("doc"), F.col("stale")).alias("r")).select("line_id", "r.state", F.array_join("r.reasons", ",").alias("reasons"))


_ERRORS = "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'SNAPSHOT_NOT_FOUND' WHEN 1 THEN 'AI_OUTPUT_TRUNCATED' WHEN 2 THEN 'RATE_LIMITED' ELSE NULL END AS code FROM events"


@query("prj_worker_err", oracle("SELECT event_id, CASE WHEN code IN ('SNAPSHOT_NOT_FOUND', 'AI_OUTPUT_TRUNCATED') THEN 'UNRECOVERABLE' ELSE 'RETRYABLE' END AS class FROM e", ("e", _ERRORS)))
def prj_worker_err(spark, sf):
    return spark.sql(_ERRORS.replace("events", "{events}"), events=view(spark, sf, "events")).select("event_id", p.error_class(F.col("code")).alias("class"))


RISK_SQL = "coalesce(insight_type = 'UNKNOWN' OR certainty = 'CONFLICTING' OR lower(metadata ->> '$.kind') = 'risk', false)"


@query("flt_risk", oracle(f"SELECT insight_id, analysis_id FROM v_insight WHERE {RISK_SQL}"))
def flt_risk(spark, sf):
    i = view(spark, sf, "v_insight")
    return i.where(p.is_risk(F.col("insight_type"), F.col("certainty"), F.col("metadata"))).select("insight_id", "analysis_id")


@query("prj_edge_flip", oracle("SELECT CASE WHEN type = 'TESTS' THEN to_id ELSE from_id END AS source, CASE WHEN type = 'TESTS' THEN from_id ELSE to_id END AS target, type, type = 'TESTS' AS flipped FROM v_edge"))
def prj_edge_flip(spark, sf):
    return p.display_edges(view(spark, sf, "v_edge"))


@query("prj_provenance", oracle("SELECT insight_id, coalesce(CASE WHEN certainty = 'EVIDENCED' THEN 'typed' END, metadata ->> '$.severity') AS severity FROM v_insight"))
def prj_provenance(spark, sf):
    i = view(spark, sf, "v_insight")
    return i.select("insight_id", p.provenance(F.when(F.col("certainty") == "EVIDENCED", "typed"), F.col("metadata"), "$.severity").alias("severity"))


@query(
    "prj_meta",
    oracle("SELECT analysis_id, (count(*) FILTER (link_basis = 'EVIDENCED'))::BIGINT AS evidenced, count(*) AS links, list_sort(list_distinct(list(universal_kind)))::VARCHAR[] AS kinds, len(list_distinct(list(universal_kind)))::INT AS n_kinds FROM v_link GROUP BY analysis_id"),
)
def prj_meta(spark, sf):
    kinds = F.sort_array(F.collect_set("universal_kind"))
    run = view(spark, sf, "v_link").groupBy("analysis_id").agg(F.struct(F.count(F.when(F.col("link_basis") == "EVIDENCED", 1)).alias("evidenced"), F.count("link_id").alias("links"), kinds.alias("kinds")).alias("run"))
    return run.select("analysis_id", "run.*", F.size("run.kinds").alias("n_kinds"))


@query("prj_translate", oracle("SELECT insight_id, insight_key, concat('[de] ', statement) AS statement FROM v_insight"))
def prj_translate(spark, sf):
    """Identifiers as they are, texts through a translation (here a mark in front)."""
    return view(spark, sf, "v_insight").select("insight_id", "insight_key", F.concat(F.lit("[de] "), "statement").alias("statement"))


_MEMBERS = "SELECT DISTINCT o_custkey % 40 AS project_id, o_custkey % 7 AS user_id, CASE (o_custkey % 40 + o_custkey % 7) % 3 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'EDITOR' ELSE 'VIEWER' END AS role FROM orders"


def members(spark, sf):
    return spark.sql(_MEMBERS.replace("FROM orders", "FROM {orders}"), orders=view(spark, sf, "orders"))


@query("flt_permission", oracle("SELECT analysis_id FROM v_analysis WHERE project_id IN (SELECT project_id FROM m WHERE user_id = 3 AND role IN ('OWNER', 'EDITOR'))", ("m", _MEMBERS)))
def flt_permission(spark, sf):
    return p.permitted(view(spark, sf, "v_analysis"), members(spark, sf), 3, ["OWNER", "EDITOR"]).select("analysis_id")


@query(
    "prj_gate_item",
    oracle("""SELECT 'INSIGHT' AS item_type, insight_id AS item_id, insight_type = 'CLAIM' OR certainty = 'CONFLICTING' AS critical, false AS inferred FROM v_insight
UNION ALL SELECT 'TRACEABILITY_LINK', link_id, link_type = 'AFFECTED' AND link_basis = 'EVIDENCED', link_type = 'AFFECTED' AND link_basis = 'INFERRED' FROM v_link"""),
)
def prj_gate_item(spark, sf):
    from ..operators.review import gate_items

    return gate_items(view(spark, sf, "v_insight").withColumn("quality", F.lit("x")), view(spark, sf, "v_link").withColumn("quality", F.lit("x"))).select("item_type", "item_id", "critical", "inferred")
