"""Queries over aggregations and review read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookup import all_matches, count_if, first_match, ratio
from ..functions.text import normal_text
from ..operators import projections as p
from ..operators import review as r
from ..operators.measures import first_samples, scorecard, share
from ..registry import query
from .projections import BLOCK_SQL, JUDGED, RISK_SQL, judged
from .views import oracle, view

_FACTS = """SELECT x.{k}, count(e.evidence_id) > 0 AS has_evidence, coalesce(bool_or(source_type <> 'DOMAIN_HINT'), false) AS has_source,
 count(e.evidence_id) > 0 AND coalesce(bool_and(source_type = 'DOMAIN_HINT'), false) AS hint_only,
 coalesce(bool_or(source_type <> 'DOMAIN_HINT' AND artifact_id IS NOT NULL), false) AS has_artifact,
 coalesce(bool_or(source_type <> 'DOMAIN_HINT' AND source_path IS NOT NULL), false) AS has_path,
 coalesce(bool_or(source_type <> 'DOMAIN_HINT' AND start_line IS NOT NULL AND end_line IS NOT NULL), false) AS has_lines,
 coalesce(bool_or(source_type <> 'DOMAIN_HINT' AND length(excerpt) >= 20), false) AS has_excerpt
FROM (SELECT {k} FROM {t}) x LEFT JOIN {b} b ON b.{k} = x.{k} LEFT JOIN v_evidence e ON e.evidence_id = b.evidence_id GROUP BY x.{k}"""
LINK_FACTS = _FACTS.format(k="link_id", t="v_link", b="v_link_evidence")
INSIGHT_FACTS = _FACTS.format(k="insight_id", t="v_insight", b="v_insight_evidence")
_STRONG = "WHEN NOT has_evidence OR NOT has_source THEN 'MISSING_EVIDENCE' WHEN has_artifact AND has_path AND has_lines AND has_excerpt THEN 'STRONG_SOURCE_EVIDENCE' ELSE 'WEAK_SOURCE_EVIDENCE' END"
LINK_QUALITY = f"""SELECT l.*, CASE WHEN review_status = 'NEEDS_REVIEW' THEN 'REVIEW_REQUIRED' WHEN link_basis = 'INFERRED' AND (artifact_id % 10 <> 0 OR has_source) THEN 'INFERRED_FROM_STRUCTURE'
 WHEN link_basis = 'INFERRED' THEN 'MISSING_EVIDENCE' WHEN hint_only THEN 'DOMAIN_HINT_ONLY' {_STRONG} AS quality FROM v_link l JOIN lf USING (link_id)"""
INSIGHT_QUALITY = f"""SELECT i.*, CASE WHEN insight_type IN ('QA_SCENARIO', 'ACCEPTANCE_CRITERIA') THEN 'DERIVED_ARTIFACT' WHEN certainty = 'CONFLICTING' THEN 'CONFLICTING_EVIDENCE'
 WHEN review_status = 'NEEDS_REVIEW' AND (certainty = 'EVIDENCED' OR insight_type IN ('CLAIM', 'UNKNOWN')) THEN 'REVIEW_REQUIRED' WHEN hint_only THEN 'DOMAIN_HINT_ONLY'
 WHEN certainty = 'INFERRED' AND has_source THEN 'INFERRED_FROM_STRUCTURE' WHEN certainty IN ('INFERRED', 'UNKNOWN') THEN 'MISSING_EVIDENCE' {_STRONG} AS quality FROM v_insight i JOIN inf USING (insight_id)"""
QUALITY = (("lf", LINK_FACTS), ("inf", INSIGHT_FACTS), ("lq", LINK_QUALITY), ("iq", INSIGHT_QUALITY))
_HAS = ", ".join(r.FACTS)


def link_facts(spark, sf):
    return r.inspect_evidence(view(spark, sf, "v_link"), view(spark, sf, "v_link_evidence"), view(spark, sf, "v_evidence"), "link_id")


def links_graded(spark, sf):
    return r.link_quality(view(spark, sf, "v_link"), link_facts(spark, sf), F.col("artifact_id") % 10 != 0)


def insights_graded(spark, sf):
    facts = r.inspect_evidence(view(spark, sf, "v_insight"), view(spark, sf, "v_insight_evidence"), view(spark, sf, "v_evidence"), "insight_id")
    return r.insight_quality(view(spark, sf, "v_insight"), facts)


@query("agg_inspect", oracle(f"SELECT link_id, {_HAS} FROM lf", ("lf", LINK_FACTS)))
def agg_inspect(spark, sf):
    return link_facts(spark, sf)


@query("prj_quality_link", oracle("SELECT link_id, quality FROM lq", *QUALITY))
def prj_quality_link(spark, sf):
    return links_graded(spark, sf).select("link_id", "quality")


@query("prj_quality_insight", oracle("SELECT insight_id, quality FROM iq", *QUALITY))
def prj_quality_insight(spark, sf):
    return insights_graded(spark, sf).select("insight_id", "quality")


@query("agg_quality", oracle("SELECT analysis_id, " + ", ".join(f"count(*) FILTER (quality = '{x}') AS {x.lower()}" for x in r.LABELS) + " FROM lq GROUP BY analysis_id", *QUALITY))
def agg_quality(spark, sf):
    return r.quality_histogram(links_graded(spark, sf), "analysis_id")


ITEMS = """SELECT 'INSIGHT' AS item_type, insight_id AS item_id, analysis_id, quality, review_status, CAST(NULL AS VARCHAR) AS decision, insight_type = 'CLAIM' OR certainty = 'CONFLICTING' AS critical, false AS inferred FROM iq
UNION ALL SELECT 'TRACEABILITY_LINK', link_id, analysis_id, quality, review_status, decision, link_type = 'AFFECTED' AND link_basis = 'EVIDENCED', link_type = 'AFFECTED' AND link_basis = 'INFERRED' FROM lq"""
_BLOCKS = """SELECT analysis_id, item_type, item_id, unnest(list_filter([CASE WHEN critical AND quality = 'REVIEW_REQUIRED' THEN 'REVIEW_REQUIRED_ITEMS' END,
 CASE WHEN quality = 'CONFLICTING_EVIDENCE' AND NOT coalesce(CASE WHEN item_type = 'INSIGHT' THEN review_status IN ('CONFIRMED', 'REJECTED') ELSE decision IN ('ACCEPTED', 'REJECTED', 'NEEDS_REVIEW', 'NEEDS_MORE_EVIDENCE') END, false) THEN 'CONFLICTING_EVIDENCE_UNREVIEWED' END,
 CASE WHEN critical AND quality = 'MISSING_EVIDENCE' AND NOT coalesce(CASE WHEN item_type = 'INSIGHT' THEN review_status = 'REJECTED' ELSE decision = 'REJECTED' END, false) THEN 'CRITICAL_MISSING_EVIDENCE' END,
 CASE WHEN critical AND item_type = 'INSIGHT' AND review_status = 'NEEDS_REVIEW' THEN 'HIGH_RISK_INSIGHT_UNREVIEWED' END,
 CASE WHEN inferred AND NOT coalesce(decision IN ('ACCEPTED', 'REJECTED'), false) THEN 'INFERRED_LINKS_UNREVIEWED' END], lambda x: x IS NOT NULL)) AS code FROM items"""


@query("agg_gate", oracle("SELECT DISTINCT analysis_id, item_type, item_id, code FROM b", *QUALITY, ("items", ITEMS), ("b", _BLOCKS)))
def agg_gate(spark, sf):
    return r.blocking_items(r.gate_items(insights_graded(spark, sf), links_graded(spark, sf)))


@query(
    "agg_reviewcov",
    oracle(
        """SELECT analysis_id, ci + la AS accepted, ri + lr AS rejected, ni + ln AS needs_review, lm AS needs_more_evidence, i - ci - ri + l - la - lr - ln - lm AS unreviewed, ni + ln + lm + i - ci - ri + l - la - lr - ln - lm AS needs_clarification
FROM (SELECT analysis_id, count(*) FILTER (item_type = 'INSIGHT') AS i, count(*) FILTER (item_type = 'INSIGHT' AND review_status = 'CONFIRMED') AS ci, count(*) FILTER (item_type = 'INSIGHT' AND review_status = 'REJECTED') AS ri,
 count(*) FILTER (item_type = 'INSIGHT' AND review_status = 'NEEDS_REVIEW') AS ni, count(*) FILTER (item_type <> 'INSIGHT') AS l, count(*) FILTER (item_type <> 'INSIGHT' AND decision = 'ACCEPTED') AS la,
 count(*) FILTER (item_type <> 'INSIGHT' AND decision = 'REJECTED') AS lr, count(*) FILTER (item_type <> 'INSIGHT' AND decision = 'NEEDS_REVIEW') AS ln, count(*) FILTER (item_type <> 'INSIGHT' AND decision = 'NEEDS_MORE_EVIDENCE') AS lm FROM items GROUP BY analysis_id) x""",
        *QUALITY,
        ("items", ITEMS),
    ),
)
def agg_reviewcov(spark, sf):
    """Counts of decisions, which do not ask for quality: no evidence is joined."""
    ungraded = [view(spark, sf, n).withColumn("quality", F.lit(None).cast("string")) for n in ("v_insight", "v_link")]
    return r.review_coverage(r.gate_items(*ungraded))


_MATRIX = f"""SELECT j.run_id, j.analysis_id, j.status, j.decision, {', '.join(f"coalesce({k.lower()}, 0) AS {k.lower()}" for k in r.KIND_BUCKETS)}, coalesce(n, 0) AS evidence_count,
 coalesce(u, 0) AS unknown_count, coalesce(c, 0) AS conflicting_count, coalesce(q, 0) AS qa_count, coalesce(u, 0) + coalesce(c, 0) AS risk_count, {BLOCK_SQL} AS blocking_reason
FROM j LEFT JOIN (SELECT analysis_id, {', '.join(f"count(DISTINCT artifact_id) FILTER ((CASE WHEN universal_kind = 'OTHER' THEN 'UNKNOWN' ELSE universal_kind END) = '{k}') AS {k.lower()}" for k in r.KIND_BUCKETS)}, count(*) AS n FROM v_link GROUP BY analysis_id) l USING (analysis_id)
LEFT JOIN (SELECT analysis_id, count(*) FILTER (insight_type = 'UNKNOWN') AS u, count(*) FILTER (insight_type <> 'UNKNOWN' AND certainty = 'CONFLICTING') AS c, count(*) FILTER (insight_type = 'QA_SCENARIO') AS q FROM v_insight GROUP BY analysis_id) i USING (analysis_id)"""


def _matrix(spark, sf):
    return r.matrix(judged(spark, sf), view(spark, sf, "v_link"), view(spark, sf, "v_insight"))


@query("agg_matrix", oracle(_MATRIX, ("j", JUDGED)))
def agg_matrix(spark, sf):
    return _matrix(spark, sf)


@query(
    "agg_matrix_summary",
    oracle(
        f"SELECT run_id, count(*) AS repositories, sum({' + '.join(k.lower() for k in r.KIND_BUCKETS)})::BIGINT AS artifacts, sum(risk_count)::BIGINT AS risks, sum(qa_count)::BIGINT AS qa_scenarios, count(*) FILTER (decision = 'ACCEPTED') AS accepted, count(*) FILTER (blocking_reason <> 'NONE') AS blocked FROM m GROUP BY run_id",
        ("j", JUDGED),
        ("m", _MATRIX),
    ),
)
def agg_matrix_summary(spark, sf):
    return r.matrix_summary(_matrix(spark, sf))


RISKS = f"""SELECT insight_id, analysis_id, insight_id IN (SELECT rb.insight_id FROM v_insight_evidence rb JOIN v_insight ri ON ri.insight_id = rb.insight_id JOIN v_insight_evidence qb ON qb.evidence_id = rb.evidence_id
 JOIN v_insight q ON q.insight_id = qb.insight_id AND q.analysis_id = ri.analysis_id AND q.insight_type = 'QA_SCENARIO') AS covered FROM v_insight WHERE {RISK_SQL}"""
PROVEN = "SELECT analysis_id, artifact_id, bool_or(link_id IN (SELECT link_id FROM v_link_evidence)) AS covered FROM v_link GROUP BY analysis_id, artifact_id"


@query("jn_risk_qa", oracle("SELECT insight_id, analysis_id, covered FROM risks", ("risks", RISKS)))
def jn_risk_qa(spark, sf):
    return r.risk_coverage(view(spark, sf, "v_insight"), view(spark, sf, "v_insight_evidence"))


_EACH = """SELECT j.analysis_id, j.run_id, j.decision, coalesce(a.n, 0) AS artifacts, coalesce(a.c, 0) AS proven, coalesce(r.n, 0) AS risks, coalesce(r.c, 0) AS risks_qa, coalesce(q.n, 0) AS qa FROM j
LEFT JOIN (SELECT analysis_id, count(*) AS n, count(*) FILTER (covered) AS c FROM proven GROUP BY 1) a USING (analysis_id) LEFT JOIN (SELECT analysis_id, count(*) AS n, count(*) FILTER (covered) AS c FROM risks GROUP BY 1) r USING (analysis_id)
LEFT JOIN (SELECT analysis_id, count(*) FILTER (insight_type = 'QA_SCENARIO') AS n FROM v_insight GROUP BY 1) q USING (analysis_id)"""
_RUNS = """SELECT run_id, count(*) AS repositories, count(*) FILTER (decision = 'ACCEPTED') AS accepted, count(*) FILTER (decision IS NULL) AS pending, count(*) FILTER (decision IN ('REJECTED', 'NEEDS_MORE_CLARIFICATION')) AS rejected,
 sum(artifacts)::BIGINT AS artifacts, sum(proven)::BIGINT AS artifacts_with_evidence, sum(artifacts - proven)::BIGINT AS uncovered_artifacts, sum(risks)::BIGINT AS risks, sum(risks_qa)::BIGINT AS risks_with_qa, sum(risks - risks_qa)::BIGINT AS risks_without_qa, sum(qa)::BIGINT AS qa_scenarios,
 coalesce(list_sort(list(analysis_id) FILTER (decision IS DISTINCT FROM 'ACCEPTED')), []) AS not_accepted,
 CASE WHEN count(*) FILTER (decision = 'ACCEPTED') < count(*) THEN 'FAIL' ELSE 'PASS' END AS review_decision, CASE WHEN sum(artifacts - proven) > 0 THEN 'WARN' ELSE 'PASS' END AS evidence_coverage,
 CASE WHEN sum(risks - risks_qa) > 0 THEN 'WARN' ELSE 'PASS' END AS qa_coverage, CASE WHEN count(*) FILTER (risks > 0 AND qa = 0) > 0 THEN 'WARN' ELSE 'PASS' END AS risk_coverage,
 CASE WHEN count(*) FILTER (decision = 'ACCEPTED' AND artifacts = 0) > 0 THEN 'WARN' ELSE 'PASS' END AS repository_readiness FROM each_ GROUP BY run_id"""
_WARNS = " + ".join(f"({g} = 'WARN')::BIGINT" for g in ("evidence_coverage", "qa_coverage", "risk_coverage", "repository_readiness"))


@query(
    "agg_coverage",
    oracle(
        f"SELECT *, (review_decision = 'FAIL')::BIGINT AS blocking_gates, {_WARNS} AS warning_gates, CASE WHEN review_decision = 'FAIL' THEN 'FAIL' WHEN {_WARNS} > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM runs",
        ("j", JUDGED), ("risks", RISKS), ("proven", PROVEN), ("each_", _EACH), ("runs", _RUNS),
    ),
)
def agg_coverage(spark, sf):
    return r.coverage(judged(spark, sf), *[view(spark, sf, f"v_{n}") for n in ("link", "link_evidence", "insight", "insight_evidence")])


_STOPS = """SELECT run_id, 'REVIEW_DECISION' AS gate, analysis_id AS id FROM j WHERE decision IS DISTINCT FROM 'ACCEPTED' UNION SELECT run_id, 'EVIDENCE_COVERAGE', artifact_id FROM proven JOIN j USING (analysis_id) WHERE NOT covered
UNION SELECT run_id, 'QA_COVERAGE', insight_id FROM risks JOIN j USING (analysis_id) WHERE NOT covered UNION SELECT run_id, 'RISK_COVERAGE', analysis_id FROM risks JOIN j USING (analysis_id) WHERE analysis_id NOT IN (SELECT analysis_id FROM v_insight WHERE insight_type = 'QA_SCENARIO')
UNION SELECT run_id, 'REPOSITORY_READINESS', analysis_id FROM j WHERE decision = 'ACCEPTED' AND analysis_id NOT IN (SELECT analysis_id FROM v_link)"""


@query(
    "agg_coverage_gates",
    oracle(
        """SELECT run_id, gate, CASE WHEN ids IS NULL THEN 'PASS' WHEN gate = 'REVIEW_DECISION' THEN 'FAIL' ELSE 'WARN' END AS status, CASE WHEN gate IN ('REVIEW_DECISION', 'RISK_COVERAGE', 'REPOSITORY_READINESS') AND ids IS NOT NULL THEN ids ELSE [] END AS analyses,
 CASE WHEN gate = 'EVIDENCE_COVERAGE' AND ids IS NOT NULL THEN ids ELSE [] END AS artifacts, CASE WHEN gate = 'QA_COVERAGE' AND ids IS NOT NULL THEN ids ELSE [] END AS insights
FROM (SELECT DISTINCT run_id FROM j) r CROSS JOIN (VALUES ('REVIEW_DECISION'), ('EVIDENCE_COVERAGE'), ('QA_COVERAGE'), ('RISK_COVERAGE'), ('REPOSITORY_READINESS')) g(gate) LEFT JOIN (SELECT run_id, gate, list_sort(list(id::BIGINT)) AS ids FROM stops GROUP BY ALL) x USING (run_id, gate)""",
        ("j", JUDGED), ("risks", RISKS), ("proven", PROVEN), ("stops", _STOPS),
    ),
)
def agg_coverage_gates(spark, sf):
    """Each gate of a run with the analyses, artifacts or insights that it stops at."""
    return r.coverage_gates(judged(spark, sf), *[view(spark, sf, f"v_{n}") for n in ("link", "link_evidence", "insight", "insight_evidence")])


@query(
    "agg_completion",
    oracle(
        """SELECT *, needs_review = 0 AND unreviewed = 0 AS complete FROM (SELECT analysis_id, count(*) AS total, count(*) FILTER (d IN ('ACCEPTED', 'CONFIRMED')) AS accepted, count(*) FILTER (d = 'REJECTED') AS rejected,
 count(*) FILTER (d = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (d = 'NEEDS_MORE_EVIDENCE') AS needs_more_evidence, count(*) FILTER (d = 'POSTPONED') AS unreviewed FROM (SELECT analysis_id, coalesce(decision, review_status) AS d FROM v_link) x GROUP BY analysis_id) y"""
    ),
)
def agg_completion(spark, sf):
    return r.completion(view(spark, sf, "v_link"))


READY = """SELECT run_id, count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'WAITING_FOR_REVIEW') AS waiting, bool_and(status = 'COMPLETED') AS all_completed,
 bool_or(status = 'FAILED') AS has_failures, bool_and(status = 'COMPLETED' AND coalesce(decision = 'ACCEPTED', false) AND NOT stale) AS can_start, count(*) FILTER (decision = 'ACCEPTED') AS accepted, count(*) FILTER (decision = 'REJECTED') AS rejected,
 count(*) FILTER (decision = 'NEEDS_MORE_CLARIFICATION') AS needs_more_clarification, count(*) FILTER (decision IS NULL) AS pending_review FROM j GROUP BY run_id"""


@query("agg_readiness", oracle("SELECT * FROM ready", ("j", JUDGED), ("ready", READY)))
def agg_readiness(spark, sf):
    return r.readiness(judged(spark, sf))


_APPROVED = "SELECT DISTINCT o_custkey AS run_id, o_custkey % 3 = 0 AS report_stale FROM orders WHERE o_custkey % 5 < 2"


@query(
    "doc_stale",
    oracle(
        """SELECT run_id, CASE WHEN report_stale THEN 'STALE' WHEN report_stale IS NOT NULL THEN 'CURRENT' WHEN can_start THEN 'NOT_CREATED' ELSE 'BLOCKED' END AS report_status, report_stale IS NULL AND can_start AS can_finalize,
 coalesce(report_stale, false) AND can_start AS can_refresh, coalesce(NOT report_stale, false) AS can_export, report_stale IS NOT NULL AS can_open FROM ready LEFT JOIN ap USING (run_id)""",
        ("j", JUDGED), ("ready", READY), ("ap", _APPROVED),
    ),
)
def doc_stale(spark, sf):
    approved = spark.sql(_APPROVED.replace("FROM orders", "FROM {orders}"), orders=view(spark, sf, "orders"))
    return r.merged_reports(judged(spark, sf), approved)


@query("agg_worksummary", oracle("SELECT analysis_id, count(*) AS total, count(*) FILTER (coalesce(decision, review_status) NOT IN ('ACCEPTED', 'CONFIRMED', 'REJECTED', 'NEEDS_MORE_EVIDENCE')) AS pending, count(DISTINCT artifact_id) AS impacted_artifacts FROM v_link GROUP BY analysis_id"))
def agg_worksummary(spark, sf):
    d = p.review_decision(F.coalesce("decision", "review_status"))
    return view(spark, sf, "v_link").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("total"), count_if(d == "needs_review").alias("pending"), F.countDistinct("artifact_id").alias("impacted_artifacts"))


@query("agg_groups", oracle("SELECT analysis_id, CASE universal_kind WHEN 'API_ENDPOINT' THEN 'primary' WHEN 'DOMAIN_SERVICE' THEN 'secondary' WHEN 'DATA_MODEL' THEN 'config' WHEN 'TEST_CASE' THEN 'test' WHEN 'TEST_FILE' THEN 'test' ELSE 'unknown' END AS display_group, list_sort(list(link_id)) AS link_ids FROM v_link GROUP BY ALL"))
def agg_groups(spark, sf):
    return view(spark, sf, "v_link").groupBy("analysis_id", p.display_group(F.col("universal_kind")).alias("display_group")).agg(F.sort_array(F.collect_list("link_id")).alias("link_ids"))


@query(
    "agg_cards",
    oracle(
        """SELECT evidence_id, coalesce(i, []) AS insight_ids, coalesce(l, []) AS link_ids FROM (SELECT evidence_id, list_sort(list(insight_id)) AS i FROM v_insight_evidence GROUP BY 1) a
FULL JOIN (SELECT evidence_id, list_sort(list(link_id)) AS l FROM v_link_evidence GROUP BY 1) b USING (evidence_id)"""
    ),
)
def agg_cards(spark, sf):
    i = view(spark, sf, "v_insight_evidence").select("evidence_id", "insight_id", F.lit(None).cast("long").alias("link_id"))
    links = view(spark, sf, "v_link_evidence").select("evidence_id", F.lit(None).cast("long").alias("insight_id"), "link_id")
    return i.unionByName(links).groupBy("evidence_id").agg(F.sort_array(F.collect_list("insight_id")).alias("insight_ids"), F.sort_array(F.collect_list("link_id")).alias("link_ids"))


@query("agg_diag", oracle("SELECT code, path, term, sum(n)::BIGINT AS n, list_sort(list(DISTINCT event_id))[1:5] AS samples FROM v_diagnostic GROUP BY code, path, term"))
def agg_diag(spark, sf):
    return first_samples(view(spark, sf, "v_diagnostic"), ["code", "path", "term"], "event_id", 5, F.sum("n").alias("n"))


@query("agg_graphdiag", oracle("SELECT code, severity, path, count(*) AS n, list_sort(list(DISTINCT event_id))[1:5] AS samples FROM v_diagnostic GROUP BY code, severity, path"))
def agg_graphdiag(spark, sf):
    return first_samples(view(spark, sf, "v_diagnostic"), ["code", "severity", "path"], "event_id", 5, F.count(F.lit(1)).alias("n"))


_LOCATED = "SELECT l_suppkey AS from_id, l_partkey % 50 AS to_id, flag AS type, qty AS line FROM v_line"


@query("agg_edge", oracle("SELECT from_id, to_id, type, count(DISTINCT line) AS locations, greatest(count(DISTINCT line) - 20, 0) AS omitted, list_sort(list(DISTINCT line))[1:20] AS samples FROM e GROUP BY ALL", ("e", _LOCATED)))
def agg_edge(spark, sf):
    e = spark.sql(_LOCATED.replace("v_line", "{lines}"), lines=view(spark, sf, "v_line"))
    n = F.countDistinct("line")
    return first_samples(e, ["from_id", "to_id", "type"], "line", 20, n.alias("locations"), F.greatest(n - 20, F.lit(0)).alias("omitted"))


@query("agg_first", oracle("SELECT artifact_id, arg_max(evidence_id, evidence_id) AS evidence_id, arg_max(excerpt, evidence_id) AS excerpt FROM v_evidence WHERE artifact_id IS NOT NULL GROUP BY artifact_id"))
def agg_first(spark, sf):
    """Of an artifact's evidence the last one stays (by identifier)."""
    last = F.max(F.struct("evidence_id", "excerpt")).alias("e")
    return view(spark, sf, "v_evidence").where("artifact_id is not null").groupBy("artifact_id").agg(last).select("artifact_id", "e.*")


_TRUTH = "SELECT DISTINCT l_suppkey % 20 AS repo, l_partkey AS k FROM v_line WHERE qty % 2 = 0 AND l_suppkey % 20 <> 3"
_FOUND = "SELECT DISTINCT l_suppkey % 20 AS repo, l_partkey AS k FROM v_line WHERE qty % 3 = 0 AND l_suppkey % 20 <> 5"
_BOTH = (("t", _TRUTH), ("f", _FOUND), ("u", "SELECT repo, k, max(e) AS e, max(p) AS p FROM (SELECT repo, k, 1 AS e, 0 AS p FROM t UNION ALL SELECT repo, k, 0, 1 FROM f) x GROUP BY repo, k"))
_PRF = "sum(e)::BIGINT AS expected, sum(p)::BIGINT AS predicted, sum(e * p)::BIGINT AS true_positive, sum(p - e * p)::BIGINT AS false_positive, sum(e - e * p)::BIGINT AS false_negative, sum(e * p) / nullif(sum(p), 0) AS precision, sum(e * p) / nullif(sum(e), 0) AS recall, 2 * sum(e * p) / nullif(sum(e) + sum(p), 0) AS f1 FROM u"


def truth(spark, sf):
    lines = view(spark, sf, "v_line")
    return tuple(spark.sql(s.replace("v_line", "{lines}"), lines=lines) for s in (_TRUTH, _FOUND))


@query("agg_prf", oracle(f"SELECT repo, {_PRF} GROUP BY repo", *_BOTH))
def agg_prf(spark, sf):
    return r.prf(*truth(spark, sf), ["repo"], ["k"])


@query("agg_micro", oracle(f"SELECT {_PRF}", *_BOTH))
def agg_micro(spark, sf):
    """All repositories as one set of (repository, key)."""
    return r.prf(*truth(spark, sf), [], ["repo", "k"])


_CASES = """SELECT l_orderkey AS case_id, list_sort(list(DISTINCT l_partkey % 9) FILTER (qty % 2 = 0)) AS want, list_sort(list(DISTINCT l_partkey % 9) FILTER (pct % 2 = 0)) AS got, list_sort(list(DISTINCT l_partkey % 9) FILTER (pct % 3 = 0)) AS proven FROM v_line GROUP BY l_orderkey"""
_CASES = f"SELECT case_id, coalesce(want, []) AS want, coalesce(got, []) AS got, coalesce(proven, []) AS proven FROM ({_CASES}) x"


def cases(spark, sf):
    k, kept = F.col("l_partkey") % 9, lambda c: F.sort_array(F.collect_set(F.when(c, F.col("l_partkey") % 9)))
    return view(spark, sf, "v_line").groupBy(F.col("l_orderkey").alias("case_id")).agg(kept(F.col("qty") % 2 == 0).alias("want"), kept(F.col("pct") % 2 == 0).alias("got"), kept(F.col("pct") % 3 == 0).alias("proven"))


@query("agg_recall", oracle("SELECT case_id, CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_intersect(want, got)) / len(want) END::DOUBLE AS recall FROM c", ("c", _CASES)))
def agg_recall(spark, sf):
    return cases(spark, sf).select("case_id", share("got", "want", 1).alias("recall"))


@query("agg_precision", oracle("SELECT case_id, CASE WHEN len(got) = 0 THEN 1.0 ELSE len(list_intersect(want, got)) / len(got) END::DOUBLE AS precision FROM c", ("c", _CASES)))
def agg_precision(spark, sf):
    return cases(spark, sf).select("case_id", share("want", "got", 1).alias("precision"))


@query("agg_evcov", oracle("SELECT case_id, CASE WHEN len(list_intersect(want, got)) = 0 THEN 0.0 ELSE len(list_intersect(list_intersect(want, got), proven)) / len(list_intersect(want, got)) END::DOUBLE AS evidence_coverage FROM c", ("c", _CASES)))
def agg_evcov(spark, sf):
    right = cases(spark, sf).withColumn("right", F.array_intersect("want", "got"))
    return right.select("case_id", share("proven", "right", 0).alias("evidence_coverage"))


@query("agg_negctl", oracle("SELECT case_id, len(list_intersect(got, proven)) = 0 AS passed, list_sort(list_intersect(got, proven)) AS failed FROM c", ("c", _CASES)))
def agg_negctl(spark, sf):
    failed = F.sort_array(F.array_intersect("got", "proven"))
    return cases(spark, sf).select("case_id", (F.size(failed) == 0).alias("passed"), failed.alias("failed"))


_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[_-]', ' ', 'g'), '[^a-z0-9_ \\t\\n\\r]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
_CONCEPTS = ["the-Re", "er_th", "zzz"]


@query("agg_concept", oracle(f"SELECT request_id, (contains({_NORMAL.format('text')}, 'the re')::INT + contains({_NORMAL.format('text')}, 'er th')::INT + contains({_NORMAL.format('text')}, 'zzz')::INT)::BIGINT AS matched, (contains({_NORMAL.format('text')}, 'the re')::INT + contains({_NORMAL.format('text')}, 'er th')::INT + contains({_NORMAL.format('text')}, 'zzz')::INT) / 3 AS coverage FROM v_request"))
def agg_concept(spark, sf):
    hits = sum(normal_text(F.col("text")).contains(normal_text(F.lit(c))).cast("long") for c in _CONCEPTS)
    return view(spark, sf, "v_request").select("request_id", hits.alias("matched")).withColumn("coverage", ratio(F.col("matched"), F.lit(len(_CONCEPTS)), 1))


_GATE = "SELECT avg(CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_intersect(want, got)) / len(want) END) AS recall, avg(CASE WHEN len(got) = 0 THEN 1.0 ELSE len(list_intersect(want, got)) / len(got) END) AS precision, avg((len(list_intersect(got, proven)) = 0)::INT) AS negative_control FROM c"
# Metric, threshold, baseline; and the tolerance.
GATES, TOLERANCE = {"recall": (0.85, 0.9), "precision": (0.7, 1.0), "negative_control": (1.0, 1.0)}, 0.05


@query("agg_gate_stable", oracle("SELECT metric, round(actual, 9) AS actual, actual < threshold AS below, actual < baseline - 0.05 AS regressed FROM (SELECT unnest(['recall', 'precision', 'negative_control']) AS metric, unnest([recall, precision, negative_control]) AS actual, unnest([0.85, 0.7, 1.0]) AS threshold, unnest([0.9, 1.0, 1.0]) AS baseline FROM g) x", ("c", _CASES), ("g", _GATE)))
def agg_gate_stable(spark, sf):
    c = cases(spark, sf).select(share("got", "want", 1).alias("recall"), share("want", "got", 1).alias("precision"), (F.size(F.array_intersect("got", "proven")) == 0).cast("double").alias("negative_control"))
    means = c.agg(*[F.avg(m).alias(m) for m in GATES])
    each = means.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("actual"), F.lit(t).alias("threshold"), F.lit(b).alias("baseline")) for m, (t, b) in GATES.items()])).alias("x")).select("x.*")
    return each.select("metric", F.round("actual", 9).alias("actual"), (F.col("actual") < F.col("threshold")).alias("below"), (F.col("actual") < F.col("baseline") - TOLERANCE).alias("regressed"))


_STUDY = "SELECT l_orderkey % 40 AS case_id, l_suppkey % 3 AS condition, l_partkey % 5 AS task, qty % 5 + 1 AS confidence, flag = 'A' AS correct, qty AS seconds, pct AS wrong, qty + pct AS reviewed FROM v_line"


def study(spark, sf):
    return spark.sql(_STUDY.replace("v_line", "{lines}"), lines=view(spark, sf, "v_line"))


@query("agg_scorecard", oracle("SELECT case_id % 2 AS tool, count(DISTINCT case_id) AS cases, sum(wrong) / nullif(sum(reviewed), 0) AS burden, sum(correct::INT) / nullif(count(*), 0) AS correct_rate, CASE WHEN count(DISTINCT case_id) < 3 THEN 'INSUFFICIENT_CASES' WHEN sum(reviewed) > 0 THEN 'READY_FOR_PRODUCT_DECISION' ELSE 'INSUFFICIENT_OBSERVATIONS' END AS status FROM s GROUP BY 1", ("s", _STUDY)))
def agg_scorecard(spark, sf):
    """Rates are ratios of sums over all cases, not means of rates."""
    return scorecard(study(spark, sf).withColumn("tool", F.col("case_id") % 2), "tool")


@query("agg_study", oracle("SELECT condition, count(*) AS n, sum(correct::INT) / count(*) AS correct_rate, sum((correct AND task = 2)::INT) / nullif(count(*) FILTER (task = 2), 0) AS task_rate, round(avg(abs(confidence / 5 - correct::INT)), 9) AS calibration_gap, avg(seconds) FILTER (correct) AS seconds_when_correct, count(DISTINCT task) AS cells FROM s GROUP BY condition", ("s", _STUDY)))
def agg_study(spark, sf):
    c = F.col("correct")
    return study(spark, sf).groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), ratio(count_if(c), F.count(F.lit(1))).alias("correct_rate"), ratio(count_if(c & (F.col("task") == 2)), count_if(F.col("task") == 2)).alias("task_rate"),
        F.round(F.avg(F.abs(F.col("confidence") / 5 - c.cast("int"))), 9).alias("calibration_gap"), F.avg(F.when(c, F.col("seconds"))).alias("seconds_when_correct"), F.countDistinct("task").alias("cells"),
    )


_COMPARED = """SELECT m AS metric, a AS candidate, b AS baseline, CASE WHEN a IS NULL OR b IS NULL THEN 'NOT_OBSERVED' WHEN s * (a - b) > 0.001 THEN 'IMPROVED' WHEN s * (a - b) < -0.001 THEN 'REGRESSED' ELSE 'UNCHANGED' END AS outcome FROM
(SELECT unnest(['burden', 'correct_rate']) AS m, unnest([-1, 1]) AS s, unnest([(SELECT sum(wrong) / nullif(sum(reviewed), 0) FROM s WHERE case_id % 2 = 1), (SELECT sum(correct::INT) / count(*) FROM s WHERE case_id % 2 = 1)]) AS a,
 unnest([(SELECT sum(wrong) / nullif(sum(reviewed), 0) FROM s WHERE case_id % 2 = 0), (SELECT sum(correct::INT) / count(*) FROM s WHERE case_id % 2 = 0)]) AS b) x"""


@query("agg_compare", oracle(f"SELECT *, CASE WHEN bool_or(outcome = 'NOT_OBSERVED') OVER () THEN 'INCONCLUSIVE' WHEN bool_or(outcome = 'REGRESSED') OVER () OR NOT bool_or(outcome = 'IMPROVED') OVER () THEN 'DEFER' ELSE 'PROMOTE' END AS verdict FROM ({_COMPARED}) y", ("s", _STUDY)))
def agg_compare(spark, sf):
    cards = scorecard(study(spark, sf).withColumn("tool", F.col("case_id") % 2), "tool")
    one = cards.agg(*[F.max(F.when(F.col("tool") == t, F.col(m))).alias(f"{m}_{t}") for m in ("burden", "correct_rate") for t in (0, 1)])
    each = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_1").alias("candidate"), F.col(f"{m}_0").alias("baseline"), F.lit(s).alias("sign")) for m, s in (("burden", -1), ("correct_rate", 1))])).alias("x")).select("x.*")
    gain = F.col("sign") * (F.col("candidate") - F.col("baseline"))
    told = each.withColumn("outcome", first_match([(gain.isNull(), "NOT_OBSERVED"), (gain > 0.001, "IMPROVED"), (gain < -0.001, "REGRESSED")], "UNCHANGED")).drop("sign")
    some = lambda x: F.bool_or(F.col("outcome") == x)
    verdict = told.agg(first_match([(some("NOT_OBSERVED"), "INCONCLUSIVE"), (some("REGRESSED") | ~some("IMPROVED"), "DEFER")], "PROMOTE").alias("verdict"))
    return told.crossJoin(F.broadcast(verdict))  # one row


@query("agg_pctl", oracle("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type"))
def agg_pctl(spark, sf):
    e = view(spark, sf, "events")
    return e.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("agg_groupby_key", oracle("SELECT DISTINCT from_id FROM v_edge WHERE from_id > 100 ORDER BY from_id LIMIT 50"))
def agg_groupby_key(spark, sf):
    return view(spark, sf, "v_edge").where("from_id > 100").select("from_id").distinct().orderBy("from_id").limit(50)


@query("agg_count_rel", oracle("SELECT o_orderkey AS analysis_id, count(link_id) AS links FROM orders LEFT JOIN v_link ON analysis_id = o_orderkey GROUP BY o_orderkey"))
def agg_count_rel(spark, sf):
    counts = view(spark, sf, "v_link").groupBy("analysis_id").agg(F.count("link_id").alias("links"))
    return view(spark, sf, "v_analysis").select("analysis_id").join(counts, "analysis_id", "left").fillna(0, ["links"])


_QUEUE = "SELECT user_id % 9 AS queue, CASE event_type WHEN 'click' THEN 'waiting' WHEN 'view' THEN 'delayed' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'prioritized' ELSE 'active' END AS state, value < 99 AS up FROM events"


@query("agg_queue", oracle("SELECT queue, count(*) FILTER (state IN ('waiting', 'delayed', 'prioritized')) AS pending, count(*) FILTER (state = 'active') AS running, count(*) FILTER (state = 'failed') AS failed FROM q GROUP BY queue", ("q", _QUEUE)))
def agg_queue(spark, sf):
    q, s = spark.sql(_QUEUE.replace("events", "{events}"), events=view(spark, sf, "events")), F.col("state")
    return q.groupBy("queue").agg(count_if(s.isin("waiting", "delayed", "prioritized")).alias("pending"), count_if(s == "active").alias("running"), count_if(s == "failed").alias("failed"))


@query("agg_rollup", oracle("SELECT queue, CASE WHEN bool_and(up) THEN 'ok' ELSE 'degraded' END AS status FROM q GROUP BY queue", ("q", _QUEUE)))
def agg_rollup(spark, sf):
    q = spark.sql(_QUEUE.replace("events", "{events}"), events=view(spark, sf, "events"))
    return q.groupBy("queue").agg(F.when(F.bool_and("up"), "ok").otherwise("degraded").alias("status"))


@query("agg_owner", oracle("SELECT project_id, count(*) FILTER (role = 'OWNER') <= 1 AS blocks_demotion FROM m GROUP BY project_id", ("m", "SELECT DISTINCT o_custkey % 40 AS project_id, o_custkey % 7 AS user_id, CASE (o_custkey % 40 + o_custkey % 7) % 3 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'EDITOR' ELSE 'VIEWER' END AS role FROM orders")))
def agg_owner(spark, sf):
    from .projections import members

    return members(spark, sf).groupBy("project_id").agg((count_if(F.col("role") == "OWNER") <= 1).alias("blocks_demotion"))


@query("agg_ambig", oracle("SELECT name, count(DISTINCT file_path) AS files FROM v_artifact GROUP BY name HAVING count(DISTINCT file_path) > 1"))
def agg_ambig(spark, sf):
    return view(spark, sf, "v_artifact").groupBy("name").agg(F.countDistinct("file_path").alias("files")).where("files > 1")


@query("agg_health", oracle("SELECT snapshot_id, count(DISTINCT file_path) AS files, count(*) AS artifacts, count(*) FILTER (content_hash IS NULL) AS without_hash, CASE WHEN count(*) FILTER (content_hash IS NULL) > 0 THEN 'PARTIAL' ELSE 'READY' END AS coverage FROM v_artifact GROUP BY snapshot_id"))
def agg_health(spark, sf):
    gaps = count_if(F.col("content_hash").isNull())
    return view(spark, sf, "v_artifact").groupBy("snapshot_id").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("artifacts"), gaps.alias("without_hash"), F.when(gaps > 0, "PARTIAL").otherwise("READY").alias("coverage"))


@query("agg_semantic", oracle("SELECT case_id, concat_ws(',', CASE WHEN len(want) <> 3 THEN 'EXPECTED_CLAIM_UNIVERSE_CHANGED' END, CASE WHEN len(list_intersect(want, got)) < len(got) THEN 'UNEXPECTED_BEHAVIOR_CLAIMS' END, CASE WHEN len(list_intersect(want, got)) < len(want) THEN 'MISSING_BEHAVIOR_CLAIMS' END) AS violations FROM c", ("c", _CASES)))
def agg_semantic(spark, sf):
    hits = F.size(F.array_intersect("want", "got"))
    found = all_matches([(F.size("want") != 3, "EXPECTED_CLAIM_UNIVERSE_CHANGED"), (hits < F.size("got"), "UNEXPECTED_BEHAVIOR_CLAIMS"), (hits < F.size("want"), "MISSING_BEHAVIOR_CLAIMS")])
    return cases(spark, sf).select("case_id", F.array_join(found, ",").alias("violations"))


@query("agg_readiness_gate", oracle("SELECT k AS check_id, coalesce(bool_and(f.k2 IS NOT NULL), false) AS passed FROM (SELECT DISTINCT l_suppkey % 20 AS k, l_partkey % 7 AS need FROM v_line WHERE l_linenumber = 1) x LEFT JOIN (SELECT DISTINCT l_suppkey % 20 AS k2, l_partkey % 7 AS has FROM v_line WHERE l_linenumber = 2 AND qty < 3) f ON k2 = k AND has = need GROUP BY k"))
def agg_readiness_gate(spark, sf):
    """A check passes if every required item is there."""
    lines = view(spark, sf, "v_line").select((F.col("l_suppkey") % 20).alias("check_id"), (F.col("l_partkey") % 7).alias("item"), "l_linenumber", "qty")
    need = lines.where("l_linenumber = 1").select("check_id", "item").distinct()
    has = lines.where("l_linenumber = 2 AND qty < 3").select("check_id", "item").distinct().withColumn("there", F.lit(True))
    return need.join(has, ["check_id", "item"], "left").groupBy("check_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("passed"))


@query("agg_any_lang", oracle("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[éèêç]') THEN 'fr' WHEN regexp_matches(lower(text), '[äöüß]') THEN 'de' WHEN regexp_matches(lower(text), '[ñáíóú]') THEN 'es' ELSE 'en' END AS guess FROM documents"))
def agg_any_lang(spark, sf):
    """Language by its letters with marks."""
    t = F.lower("text")
    return view(spark, sf, "documents").select("doc_id", first_match([(t.rlike("[éèêç]"), "fr"), (t.rlike("[äöüß]"), "de"), (t.rlike("[ñáíóú]"), "es")], "en").alias("guess"))
