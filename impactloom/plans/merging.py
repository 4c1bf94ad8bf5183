"""Queries over merges into tables and rendered reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import tables as t
from .joins import over
from .projections import JUDGED, judged
from .views import oracle, view

_STORED = "SELECT idempotency_key AS k, min(event_id) AS event_id, max(value) AS value FROM v_event WHERE event_id % 3 = 0 GROUP BY idempotency_key"
_NEW = "SELECT idempotency_key AS k, event_id, value FROM v_event WHERE event_id % 3 = 1"
_ONE = "SELECT idempotency_key AS k, min(event_id) AS event_id, max(value) AS value FROM v_event WHERE event_id % 3 = 1 GROUP BY idempotency_key"


def tables(spark, sf, *texts):
    return tuple(over(spark, sf, x, "v_event") for x in texts)


_IGNORE = "SELECT * FROM s UNION ALL SELECT k, arg_min(event_id, event_id), arg_min(value, event_id) FROM n WHERE k NOT IN (SELECT k FROM s) GROUP BY k"


@query("snk_insert_ignore", oracle(_IGNORE, ("s", _STORED), ("n", _NEW)))
def snk_insert_ignore(spark, sf):
    return t.insert_ignore(*tables(spark, sf, _STORED, _NEW), ["k"], ["event_id"])


@query("snk_upsert", oracle("SELECT coalesce(s.k, n.k) AS k, coalesce(s.event_id, n.event_id) AS event_id, coalesce(n.value, s.value) AS value FROM s FULL JOIN n ON s.k = n.k", ("s", _STORED), ("n", _ONE)))
def snk_upsert(spark, sf):
    """The identifier of a stored row stays, its value is replaced."""
    return t.upsert(*tables(spark, sf, _STORED, _ONE), ["k"], keep=["event_id"])


_CHUNKS = "SELECT vec_id AS artifact_id, label AS snapshot_id, vec_id % 7 AS code FROM embeddings"
_PLAN = "SELECT vec_id AS old_id, vec_id + CASE WHEN vec_id % 2 = 0 THEN 10000 ELSE 1 END AS artifact_id, label AS snapshot_id FROM embeddings WHERE vec_id % 5 < 2"


@query("snk_copy", oracle("SELECT * FROM c UNION ALL SELECT p.artifact_id, p.snapshot_id, c.code FROM p JOIN c ON c.artifact_id = old_id WHERE NOT EXISTS (FROM c x WHERE x.artifact_id = p.artifact_id AND x.snapshot_id = p.snapshot_id)", ("c", _CHUNKS), ("p", _PLAN)))
def snk_copy(spark, sf):
    return t.copied(over(spark, sf, _CHUNKS, "embeddings"), over(spark, sf, _PLAN, "embeddings"))


_STATES = "SELECT analysis_id, commit_sha, status FROM v_analysis"
_WANTED = "SELECT analysis_id, CASE WHEN analysis_id % 3 = 0 THEN 'c9' ELSE commit_sha END AS commit_sha, 'FINAL' AS status FROM v_analysis WHERE status = 'COMPLETED'"


@query("snk_cas", oracle("SELECT s.analysis_id, s.commit_sha, CASE WHEN w.commit_sha = s.commit_sha THEN w.status ELSE s.status END AS status, CASE WHEN w.commit_sha = s.commit_sha THEN 'updated' WHEN w.analysis_id IS NOT NULL THEN 'stale' ELSE 'untouched' END AS outcome FROM s LEFT JOIN w ON w.analysis_id = s.analysis_id", ("s", _STATES), ("w", _WANTED)))
def snk_cas(spark, sf):
    return t.conditional_update(over(spark, sf, _STATES, "v_analysis"), over(spark, sf, _WANTED, "v_analysis"), ["analysis_id"], "commit_sha", "status")


@query("snk_delete", oracle("SELECT chunk_id, snapshot_id FROM v_chunk WHERE snapshot_id NOT IN (3, 4)"))
def snk_delete(spark, sf):
    gone = spark.createDataFrame([(3,), (4,)], "snapshot_id int")
    return t.deleted(view(spark, sf, "v_chunk").select("chunk_id", "snapshot_id"), gone, ["snapshot_id"])


@query("snk_event", oracle("SELECT k, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM n GROUP BY k", ("n", _NEW)))
def snk_event(spark, sf):
    """Of events with one key the first is stored."""
    return t.first_wins(tables(spark, sf, _NEW)[0], ["k"], ["event_id"])


@query("snk_verify", oracle("SELECT side, k, event_id FROM (SELECT 'given' AS side, k, event_id FROM n WHERE event_id % 50 = 1 UNION ALL SELECT 'stored', concat(k, 'x'), event_id FROM n WHERE event_id % 50 = 1) y", ("n", _NEW)))
def snk_verify(spark, sf):
    """What a table that was damaged in every fiftieth row differs in from what it was given."""
    given = tables(spark, sf, _NEW)[0].select("k", "event_id")
    stored = given.withColumn("k", F.when(F.col("event_id") % 50 == 1, F.concat("k", F.lit("x"))).otherwise(F.col("k")))
    return t.differences(stored, given)


@query("snk_markdown", oracle("SELECT analysis_id, '# Analysis ' || analysis_id || chr(10) || string_agg(concat('- [', review_status, '] ', link_id, ' ', universal_kind), chr(10) ORDER BY link_id) AS markdown FROM v_link GROUP BY analysis_id"))
def snk_markdown(spark, sf):
    line = F.concat(F.lit("- ["), "review_status", F.lit("] "), "link_id", F.lit(" "), "universal_kind")
    body = t.report(view(spark, sf, "v_link"), "analysis_id", ["link_id"], line)
    return body.select("analysis_id", F.concat(F.lit("# Analysis "), "analysis_id", F.lit("\n"), "markdown").alias("markdown"))


_TOLD = "SELECT i.*, run_id FROM v_insight i JOIN v_analysis USING (analysis_id) WHERE review_status <> 'REJECTED'"
_APPENDIX = """SELECT run_id, evidence_id, min(source) AS source FROM (SELECT run_id, evidence_id, concat('0 Insight: ', statement, ' ', insight_id) AS source FROM told JOIN v_insight_evidence USING (insight_id)
UNION ALL SELECT run_id, evidence_id, concat('1 Traceability: ', link_id) FROM v_link l JOIN v_analysis a ON a.analysis_id = l.analysis_id JOIN v_link_evidence USING (link_id) WHERE review_status <> 'REJECTED') x GROUP BY run_id, evidence_id"""
_LINES = """SELECT run_id, 0 AS part, 0 AS a, 0 AS b, concat('# Merged Report Draft: ', run_id, chr(10), chr(10), '## Run Summary', chr(10), chr(10), '- Child Analyses: ', count(*)) AS line FROM j GROUP BY run_id
UNION ALL SELECT DISTINCT run_id, p, -1, 0, h FROM j CROSS JOIN (VALUES (1, chr(10) || '## Repository Coverage' || chr(10) || chr(10) || '| Repository | Analysis ID | Snapshot ID | Commit | Review |' || chr(10) || '|---|---|---|---|---|'), (2, chr(10) || '## Consolidated Risks' || chr(10)), (3, chr(10) || '## QA Scenarios' || chr(10)), (4, chr(10) || '## Evidence Appendix' || chr(10))) v(p, h)
UNION ALL SELECT run_id, 1, repository_id, analysis_id, concat('| ', repository_id, ' | `', analysis_id, '` | `', snapshot_id, '` | `', commit_sha, '` | ', coalesce(decision, 'PENDING'), ' |') FROM j
UNION ALL SELECT run_id, 2, analysis_id, insight_id, concat('- [', certainty, '] ', statement, ' (', insight_type, ')') FROM told WHERE insight_type IN ('CLAIM', 'UNKNOWN', 'QUESTION')
UNION ALL SELECT run_id, 3, analysis_id, insight_id, concat('- [', certainty, '] ', statement) FROM told WHERE insight_type = 'QA_SCENARIO' UNION ALL SELECT run_id, 4, evidence_id, 0, concat('- ', evidence_id, ' ', source[3:]) FROM ap"""


@query(
    "snk_markdown_run",
    oracle("SELECT run_id, string_agg(line, chr(10) ORDER BY part, a, b) AS markdown FROM (SELECT * FROM ln UNION ALL SELECT DISTINCT j.run_id, p, 0, 0, '- none' FROM j CROSS JOIN (VALUES (2), (3), (4)) v(p) ANTI JOIN ln ON ln.run_id = j.run_id AND ln.part = p AND ln.a >= 0) x GROUP BY run_id", ("j", JUDGED), ("told", _TOLD), ("ap", _APPENDIX), ("ln", _LINES)),
)
def snk_markdown_run(spark, sf):
    """A run's merged report: what is read, what is at risk, how it is tested, and each evidence once, named by its first use."""
    j = judged(spark, sf)
    told = over(spark, sf, _TOLD, "v_insight", "v_analysis")
    links = view(spark, sf, "v_link").where("review_status <> 'REJECTED'").join(view(spark, sf, "v_analysis").select("analysis_id", "run_id"), "analysis_id")
    by_insight = told.join(view(spark, sf, "v_insight_evidence"), "insight_id").select("run_id", "evidence_id", F.concat(F.lit("0 Insight: "), "statement", F.lit(" "), "insight_id").alias("source"))
    by_link = links.join(view(spark, sf, "v_link_evidence"), "link_id").select("run_id", "evidence_id", F.concat(F.lit("1 Traceability: "), "link_id").alias("source"))
    appendix = by_insight.unionByName(by_link).groupBy("run_id", "evidence_id").agg(F.min("source").alias("source"))
    table = [F.lit("\n## Repository Coverage\n"), F.lit("| Repository | Analysis ID | Snapshot ID | Commit | Review |"), F.lit("|---|---|---|---|---|")]
    claim = F.concat(F.lit("- ["), "certainty", F.lit("] "), "statement")
    row = F.concat(F.lit("| "), "repository_id", F.lit(" | `"), "analysis_id", F.lit("` | `"), "snapshot_id", F.lit("` | `"), "commit_sha", F.lit("` | "), F.coalesce("decision", F.lit("PENDING")), F.lit(" |"))
    title = F.concat(F.lit("# Merged Report Draft: "), "run_id", F.lit("\n\n## Run Summary\n\n- Child Analyses: "), "n")
    parts = [
        (F.concat_ws("\n", *table), j.select("run_id", F.col("repository_id").alias("a"), F.col("analysis_id").alias("b"), row.alias("line"))),
        (F.lit("\n## Consolidated Risks\n"), told.where("insight_type IN ('CLAIM', 'UNKNOWN', 'QUESTION')").select("run_id", F.col("analysis_id").alias("a"), F.col("insight_id").alias("b"), F.concat(claim, F.lit(" ("), "insight_type", F.lit(")")).alias("line"))),
        (F.lit("\n## QA Scenarios\n"), told.where("insight_type = 'QA_SCENARIO'").select("run_id", F.col("analysis_id").alias("a"), F.col("insight_id").alias("b"), claim.alias("line"))),
        (F.lit("\n## Evidence Appendix\n"), appendix.select("run_id", F.col("evidence_id").alias("a"), F.lit(0).alias("b"), F.concat(F.lit("- "), "evidence_id", F.lit(" "), F.substr("source", F.lit(3))).alias("line"))),
    ]
    out = j.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select("run_id", title.alias("markdown"))
    for heading, rows in parts:
        body = t.report(rows, "run_id", ["a", "b"], F.col("line")).withColumnRenamed("markdown", "body")
        out = out.join(body, "run_id", "left").select("run_id", F.concat_ws("\n", "markdown", heading, F.coalesce("body", F.lit("- none"))).alias("markdown"))
    return out


@query("loc_validate", oracle("SELECT 'given' AS side, insight_id FROM v_insight WHERE insight_id % 40 = 1 UNION ALL SELECT 'stored', insight_id + 5 FROM v_insight WHERE insight_id % 40 = 1"))
def loc_validate(spark, sf):
    """Identifiers that a translation lost or made up (here every fortieth was changed)."""
    ids = view(spark, sf, "v_insight").select("insight_id")
    translated = ids.select(F.when(F.col("insight_id") % 40 == 1, F.col("insight_id") + 5).otherwise(F.col("insight_id")).alias("insight_id"))
    return t.differences(translated, ids)


@query("loc_hash", oracle("SELECT analysis_id, sha256(string_agg(concat('{\"id\":', insight_id, ',\"key\":\"', insight_key, '\",\"type\":\"', insight_type, '\"}'), ',' ORDER BY insight_id)) AS report_hash FROM v_insight GROUP BY analysis_id"))
def loc_hash(spark, sf):
    """A report's hash over its items as JSON with sorted keys, in the order of identifiers."""
    item = F.to_json(F.struct(F.col("insight_id").alias("id"), F.col("insight_key").alias("key"), F.col("insight_type").alias("type")))
    items = view(spark, sf, "v_insight").groupBy("analysis_id").agg(F.sort_array(F.collect_list(F.struct("insight_id", item.alias("j")))).alias("l"))
    return items.select("analysis_id", F.sha2(F.array_join("l.j", ","), 256).alias("report_hash"))
