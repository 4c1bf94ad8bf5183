"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookup import first_match
from ..operators import joins as j
from ..operators import projections as p
from ..operators.ordering import latest
from ..registry import query
from .projections import BLOCK_SQL, JUDGED, RISK_SQL, judged
from .views import oracle, view


def over(spark, sf, sql: str, *names: str, given=None):
    """SQL over views, as a DataFrame."""
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **{n: view(spark, sf, n, given) for n in names})


CHANGES = """SELECT artifact_key, b.content_hash AS base_value, t.content_hash AS target_value, CASE WHEN b.artifact_id IS NULL THEN 'added' WHEN t.artifact_id IS NULL THEN 'removed'
 WHEN b.content_hash IS NULL OR t.content_hash IS NULL THEN 'unknown' WHEN b.content_hash <> t.content_hash THEN 'changed' ELSE 'unchanged' END AS change FROM v_base b FULL JOIN v_target t USING (artifact_key)"""


def changes(spark, sf):
    return j.compared(view(spark, sf, "v_base"), view(spark, sf, "v_target"))


@query("jn_drift", oracle("SELECT * FROM c", ("c", CHANGES)))
def jn_drift(spark, sf):
    return changes(spark, sf)


_COUNTS = ", ".join(f"count(*) FILTER (change = '{x}') AS {x}" for x in ("added", "removed", "changed", "unchanged", "unknown"))


@query("jn_drift_summary", oracle(f"SELECT *, CASE WHEN added + removed + changed > 0 THEN 'DRIFTED' WHEN unknown > 0 THEN 'UNKNOWN' ELSE 'NO_DRIFT' END AS status FROM (SELECT {_COUNTS} FROM c) x", ("c", CHANGES)))
def jn_drift_summary(spark, sf):
    return j.drift_summary(changes(spark, sf))


@query("jn_incremental", oracle(f"SELECT added, removed, changed, unchanged, unknown AS hash_unavailable, unchanged AS eligible, changed + unknown + added AS ineligible, unchanged / (unchanged + changed + unknown + added) AS eligible_ratio, 'SAFE_FOR_FUTURE_REUSE' AS safety FROM (SELECT {_COUNTS} FROM c) x", ("c", CHANGES)))
def jn_incremental(spark, sf):
    return j.reuse_plan(changes(spark, sf), versions_differ=False)


_SIDES = "SELECT run_id, artifact_id, link_id, universal_kind, a.analysis_id % 2 AS side FROM v_link JOIN v_analysis a ON a.analysis_id = v_link.analysis_id WHERE link_type = 'AFFECTED'"
_DIFF = "SELECT run_id, artifact_id, CASE WHEN max(1 - side) = 0 THEN 'added' WHEN max(side) = 0 THEN 'removed' ELSE 'unchanged' END AS change FROM s GROUP BY run_id, artifact_id"


@query("jn_diff_artifact", oracle(_DIFF, ("s", _SIDES)))
def jn_diff_artifact(spark, sf):
    """Affected artifacts of the odd analyses of a run against those of the even ones."""
    links = view(spark, sf, "v_link").where("link_type = 'AFFECTED'").join(view(spark, sf, "v_analysis").select("analysis_id", "run_id"), "analysis_id")
    new, old = [links.where(F.col("analysis_id") % 2 == k).select("run_id", "artifact_id").distinct().withColumn(n, F.lit(True)) for k, n in ((1, "new"), (0, "old"))]
    change = first_match([(F.col("old").isNull(), "added"), (F.col("new").isNull(), "removed")], "unchanged")
    return new.join(old, ["run_id", "artifact_id"], "full_outer").select("run_id", "artifact_id", change.alias("change"))


_IKEY = "SELECT i.*, a.run_id, i.analysis_id % 2 AS side, concat(insight_type, '::', CASE WHEN insight_type = 'UNKNOWN' THEN lower(trim(statement)) ELSE insight_key END) AS diff_key FROM v_insight i JOIN v_analysis a ON a.analysis_id = i.analysis_id"


@query(
    "jn_diff_insight",
    oracle(
        """SELECT DISTINCT run_id, diff_key, CASE WHEN side = 0 THEN 'removed_unknown' WHEN insight_type = 'UNKNOWN' THEN 'new_unknown' ELSE 'added_qa' END AS change FROM k
WHERE (side = 0 AND insight_type = 'UNKNOWN' AND NOT EXISTS (FROM k o WHERE o.side = 1 AND o.run_id = k.run_id AND o.diff_key = k.diff_key))
 OR (side = 1 AND insight_type IN ('UNKNOWN', 'QA_SCENARIO') AND NOT EXISTS (FROM k o WHERE o.side = 0 AND o.run_id = k.run_id AND o.diff_key = k.diff_key))""",
        ("k", _IKEY),
    ),
)
def jn_diff_insight(spark, sf):
    i = view(spark, sf, "v_insight").join(view(spark, sf, "v_analysis").select("analysis_id", "run_id"), "analysis_id")
    keyed = i.select("run_id", "insight_type", (F.col("analysis_id") % 2).alias("side"), j.insight_key(F.col("insight_type"), F.col("insight_key"), F.lit(""), F.col("statement")).alias("diff_key")).distinct()
    old, new = keyed.where("side = 0"), keyed.where("side = 1")
    gone = old.where("insight_type = 'UNKNOWN'").join(new, ["run_id", "diff_key"], "left_anti").withColumn("change", F.lit("removed_unknown"))
    come = new.where("insight_type IN ('UNKNOWN', 'QA_SCENARIO')").join(old, ["run_id", "diff_key"], "left_anti").withColumn("change", F.when(F.col("insight_type") == "UNKNOWN", "new_unknown").otherwise("added_qa"))
    return gone.unionByName(come).select("run_id", "diff_key", "change").distinct()


@query("jn_fk", oracle("SELECT link_id, l.analysis_id, run_id, e.evidence_id, e.source_path FROM v_link l JOIN v_analysis a ON a.analysis_id = l.analysis_id LEFT JOIN v_link_evidence b USING (link_id) LEFT JOIN v_evidence e ON e.evidence_id = b.evidence_id"))
def jn_fk(spark, sf):
    """A link with its analysis, and its evidence if there is any."""
    links = view(spark, sf, "v_link").select("link_id", "analysis_id").join(view(spark, sf, "v_analysis").select("analysis_id", "run_id"), "analysis_id")
    proof = view(spark, sf, "v_link_evidence").join(view(spark, sf, "v_evidence").select("evidence_id", "source_path"), "evidence_id", "left")
    return links.join(proof, "link_id", "left").select("link_id", "analysis_id", "run_id", "evidence_id", "source_path")


@query("jn_scope", oracle("SELECT evidence_id, project_id FROM v_evidence e JOIN v_analysis a ON a.analysis_id = e.analysis_id"))
def jn_scope(spark, sf):
    return view(spark, sf, "v_evidence").join(view(spark, sf, "v_analysis").select("analysis_id", "project_id"), "analysis_id").select("evidence_id", "project_id")


_KEYED = "SELECT from_id AS f, to_id AS t, type, concat('en:', from_id) AS from_key, concat('en:', to_id) AS to_key FROM v_edge"


@query("jn_edge_resolve", oracle("SELECT f, t, type, a.artifact_id AS from_id, b.artifact_id AS to_id, a.artifact_id IS NULL OR b.artifact_id IS NULL AS dropped FROM k LEFT JOIN v_artifact a ON a.artifact_key = from_key LEFT JOIN v_artifact b ON b.artifact_key = to_key", ("k", _KEYED)))
def jn_edge_resolve(spark, sf):
    return j.resolved_edges(over(spark, sf, _KEYED, "v_edge"), view(spark, sf, "v_artifact")).select("f", "t", "type", "from_id", "to_id", "dropped")


@query("jn_some", oracle("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT artifact_id FROM v_link WHERE link_basis = 'INFERRED')"))
def jn_some(spark, sf):
    return view(spark, sf, "part").select("p_partkey").join(view(spark, sf, "v_link").where("link_basis = 'INFERRED'").select(F.col("artifact_id").alias("p_partkey")), "p_partkey", "left_semi")


@query("jn_in", oracle("SELECT from_id, to_id, type FROM v_edge WHERE from_id IN (SELECT doc_id FROM documents WHERE lang = 'fr') AND to_id IN (SELECT doc_id FROM documents)"))
def jn_in(spark, sf):
    """A snapshot's graph: edges between listed artifacts."""
    d = view(spark, sf, "documents")
    return view(spark, sf, "v_edge").join(d.where("lang = 'fr'").select(F.col("doc_id").alias("from_id")), "from_id", "left_semi").join(d.select(F.col("doc_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", "type")


@query("jn_retrmeta", oracle("SELECT evidence_id, e.analysis_id, link_id, link_basis FROM v_evidence e LEFT JOIN v_link l ON l.analysis_id = e.analysis_id AND l.artifact_id = e.artifact_id"))
def jn_retrmeta(spark, sf):
    e = view(spark, sf, "v_evidence").select("evidence_id", "analysis_id", "artifact_id")
    return e.join(view(spark, sf, "v_link").select("analysis_id", "artifact_id", "link_id", "link_basis"), ["analysis_id", "artifact_id"], "left").drop("artifact_id")


@query(
    "jn_row_detail",
    oracle(
        f"""SELECT l.analysis_id, l.artifact_id, coalesce(list_sort(list_distinct(list(b.evidence_id))), []) AS evidence_ids, coalesce(list_sort(list_distinct(list(i.insight_id) FILTER ({RISK_SQL}))), []) AS risks,
 coalesce(list_sort(list_distinct(list(i.insight_id) FILTER (insight_type = 'QA_SCENARIO'))), []) AS scenarios
FROM v_link l LEFT JOIN v_link_evidence b USING (link_id) LEFT JOIN v_insight_evidence ie ON ie.evidence_id = b.evidence_id LEFT JOIN v_insight i ON i.insight_id = ie.insight_id GROUP BY l.analysis_id, l.artifact_id"""
    ),
)
def jn_row_detail(spark, sf):
    """Artifacts of an analysis with their evidence, and the risks and scenarios that share it."""
    proof = view(spark, sf, "v_link").select("link_id", "analysis_id", "artifact_id").join(view(spark, sf, "v_link_evidence"), "link_id", "left")
    i = view(spark, sf, "v_insight").select("insight_id", p.is_risk(F.col("insight_type"), F.col("certainty"), F.col("metadata")).alias("risk"), (F.col("insight_type") == "QA_SCENARIO").alias("qa"))
    shared = proof.join(view(spark, sf, "v_insight_evidence").join(i, "insight_id"), "evidence_id", "left")

    def ids(c, when=None):
        return F.sort_array(F.collect_set(c if when is None else F.when(F.col(when), F.col(c))))

    return shared.groupBy("analysis_id", "artifact_id").agg(ids("evidence_id").alias("evidence_ids"), ids("insight_id", "risk").alias("risks"), ids("insight_id", "qa").alias("scenarios"))


_OBSERVED = "SELECT event_id AS obs_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id % 30 END AS line, concat('t', user_id % 12) AS path FROM events"
_TESTS = "SELECT vec_id AS case_id, concat('t', vec_id % 12) AS path, vec_id % 29 AS line FROM embeddings"


@query("jn_runtime", oracle("SELECT obs_id, o.path, o.line, CASE WHEN n > 1 THEN 'AMBIGUOUS' WHEN n = 1 THEN 'MATCHED' ELSE 'UNMATCHED' END AS correlation, CASE WHEN n = 1 THEN case_id END AS case_id FROM o LEFT JOIN (SELECT path, line, count(*) AS n, min(case_id) AS case_id FROM t GROUP BY path, line) c ON c.path = o.path AND c.line = o.line", ("o", _OBSERVED), ("t", _TESTS)))
def jn_runtime(spark, sf):
    return j.runtime_matches(over(spark, sf, _OBSERVED, "events"), over(spark, sf, _TESTS, "embeddings"))


_OLDCHUNK = "SELECT artifact_id, CASE WHEN artifact_id % 9 = 1 THEN NULL ELSE 'chunk@2' END AS chunker_version, CASE WHEN artifact_id % 8 = 1 THEN 'm0' ELSE 'm1' END AS model, CASE WHEN artifact_id % 6 = 1 THEN 'x' ELSE md5(artifact_key) END AS chunk_hash FROM v_base WHERE artifact_id % 5 <> 2"
_NOWCHUNK = "SELECT artifact_key, artifact_id, content_hash, md5(artifact_key) AS chunk_hash FROM v_target"
REUSE = """SELECT artifact_key, CASE WHEN b.artifact_id IS NULL THEN 'NEW_ARTIFACT' WHEN NOT coalesce(n.content_hash = b.content_hash, false) THEN 'ARTIFACT_CHANGED' WHEN c.artifact_id IS NULL THEN 'MISSING_PREVIOUS_CHUNK'
 WHEN chunker_version IS DISTINCT FROM 'chunk@2' THEN 'LEGACY_CHUNKER_VERSION' WHEN model <> 'm1' THEN 'MODEL_MISMATCH' WHEN c.chunk_hash <> n.chunk_hash THEN 'CHUNK_HASH_MISMATCH' ELSE 'REUSE' END AS verdict
FROM n LEFT JOIN v_base b USING (artifact_key) LEFT JOIN c ON c.artifact_id = b.artifact_id"""
REUSE_PARTS = (("n", _NOWCHUNK), ("c", _OLDCHUNK))


def reuse(spark, sf):
    return j.chunk_reuse(over(spark, sf, _NOWCHUNK, "v_target"), view(spark, sf, "v_base"), over(spark, sf, _OLDCHUNK, "v_base"), "chunk@2", "m1")


@query("jn_reuse", oracle(REUSE, *REUSE_PARTS))
def jn_reuse(spark, sf):
    return reuse(spark, sf)


@query("em_reuse", oracle("SELECT verdict, count(*) AS n, verdict <> 'REUSE' AS generate FROM r GROUP BY verdict", *REUSE_PARTS, ("r", REUSE)))
def em_reuse(spark, sf):
    return reuse(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).withColumn("generate", F.col("verdict") != "REUSE")


_INNER = "SELECT l_suppkey % 10 AS file, line_id AS inner_id, l_orderkey % 700 AS start, l_orderkey % 700 + qty AS \"end\" FROM v_line WHERE l_linenumber = 1"
_OUTER = "SELECT l_suppkey % 10 AS file, line_id AS outer_id, l_partkey % 700 AS start, l_partkey % 700 + qty * 3 AS \"end\" FROM v_line WHERE l_linenumber = 2 AND pct > 7"


def ranges(spark, sf):
    return tuple(over(spark, sf, s.replace('"', "`"), "v_line") for s in (_INNER, _OUTER))


@query("jn_contains", oracle('SELECT i.file, inner_id, outer_id FROM i JOIN o ON i.file = o.file AND i.start >= o.start AND i."end" <= o."end"', ("i", _INNER), ("o", _OUTER)))
def jn_contains(spark, sf):
    return j.contained(*ranges(spark, sf), ["file"])


@query("jn_claims", oracle('SELECT outer_id, count(inner_id) AS assertions, coalesce(list_sort(list(inner_id) FILTER (inner_id IS NOT NULL))[1:3], []) AS first_assertions FROM o LEFT JOIN i ON i.file = o.file AND i.start >= o.start AND i."end" <= o."end" GROUP BY outer_id', ("i", _INNER), ("o", _OUTER)))
def jn_claims(spark, sf):
    """Expected outcomes with the assertions inside them: how many, and the first three."""
    found = j.contained_sums(*ranges(spark, sf), ["file"], 3)
    return found.select("outer_id", F.col("n").alias("assertions"), F.col("first").alias("first_assertions"))


TERMS = "SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS term FROM part UNION SELECT 'the' UNION SELECT 'Ers'"


@query("jn_keyword", oracle("SELECT request_id, term FROM v_request JOIN t ON contains(lower(text), lower(term))", ("t", TERMS)))
def jn_keyword(spark, sf):
    return j.named_terms(view(spark, sf, "v_request"), over(spark, sf, TERMS, "part")).select("request_id", "term")


_STORED = "SELECT analysis_id, run_id, CASE WHEN analysis_id % 9 = 0 THEN 0 ELSE decision_id END AS decision_id, CASE WHEN analysis_id % 8 = 0 THEN -1 ELSE snapshot_id END AS snapshot_id, commit_sha FROM w WHERE analysis_id % 10 <> 0"
_WITH = "SELECT a.*, (ref_type <> 'COMMIT' AND latest_sha <> commit_sha) AS stale, decision_id FROM v_analysis a LEFT JOIN (SELECT analysis_id, arg_max(decision_id, (decided_at, decision_id)) AS decision_id FROM v_decision GROUP BY analysis_id) d USING (analysis_id)"


@query(
    "jn_staleprov",
    oracle(
        """SELECT run_id, count(reason) > 0 AS stale, arg_min(reason, (o, analysis_id)) FILTER (reason IS NOT NULL) AS reason FROM (SELECT coalesce(s.run_id, w.run_id) AS run_id, coalesce(s.analysis_id, w.analysis_id) AS analysis_id,
 CASE WHEN s.analysis_id IS NULL OR w.analysis_id IS NULL THEN 0 ELSE 1 END AS o, CASE WHEN s.analysis_id IS NULL OR w.analysis_id IS NULL THEN 'CHILD_SET_CHANGED' WHEN w.stale THEN 'CHILD_STALE' WHEN status <> 'COMPLETED' THEN 'CHILD_NOT_COMPLETED'
  WHEN w.decision_id IS DISTINCT FROM s.decision_id THEN 'DECISIONS_CHANGED' WHEN w.snapshot_id <> s.snapshot_id OR w.commit_sha <> s.commit_sha THEN 'SNAPSHOT_CHANGED' END AS reason
 FROM s FULL JOIN w ON s.analysis_id = w.analysis_id AND s.run_id = w.run_id) x GROUP BY run_id""",
        ("w", _WITH), ("s", _STORED),
    ),
)
def jn_staleprov(spark, sf):
    last = latest(view(spark, sf, "v_decision"), ["analysis_id"], ["decided_at", "decision_id"]).select("analysis_id", "decision_id")
    now = view(spark, sf, "v_analysis").join(last, "analysis_id", "left").withColumn("stale", p.is_stale(F.col("ref_type"), F.col("latest_sha"), F.col("commit_sha")))
    return j.provenance_reasons(spark.sql(_STORED.replace("FROM w", "FROM {w}"), w=now), now)


@query("jn_evkeys", oracle("SELECT DISTINCT case_id, k FROM (SELECT l_orderkey AS case_id, unnest([l_partkey, l_partkey + 1, -1]) AS k FROM v_line WHERE l_linenumber = 3) x WHERE k IN (SELECT artifact_id FROM v_evidence)"))
def jn_evkeys(spark, sf):
    """Requested keys for which evidence is stored."""
    asked = view(spark, sf, "v_line").where("l_linenumber = 3").select(F.col("l_orderkey").alias("case_id"), F.explode(F.array("l_partkey", F.col("l_partkey") + 1, F.lit(-1))).alias("k")).distinct()
    return asked.join(view(spark, sf, "v_evidence").select(F.col("artifact_id").alias("k")), "k", "left_semi")


_TARGETS = "SELECT analysis_id AS target_id, repository_id, latest_sha, created_at AS seen_at FROM v_analysis"
_SNAPS = "SELECT analysis_id AS snapshot_key, repository_id, commit_sha, created_at FROM v_analysis"


@query(
    "jn_plan",
    oracle(
        """SELECT t.repository_id, target_id, arg_max(snapshot_key, (created_at, snapshot_key)) AS snapshot_key FROM (SELECT repository_id, arg_max(target_id, (seen_at, target_id)) AS target_id, arg_max(latest_sha, (seen_at, target_id)) AS latest_sha FROM t GROUP BY repository_id) t
JOIN s ON s.repository_id = t.repository_id AND s.commit_sha = t.latest_sha GROUP BY t.repository_id, target_id""",
        ("t", _TARGETS), ("s", _SNAPS),
    ),
)
def jn_plan(spark, sf):
    """Per repository the newest target, and the newest snapshot of exactly its commit."""
    target = latest(over(spark, sf, _TARGETS, "v_analysis"), ["repository_id"], ["seen_at", "target_id"])
    snaps = latest(over(spark, sf, _SNAPS, "v_analysis"), ["repository_id", "commit_sha"], ["created_at", "snapshot_key"])
    return target.join(snaps.withColumnRenamed("commit_sha", "latest_sha"), ["repository_id", "latest_sha"]).select("repository_id", "target_id", "snapshot_key")


@query(
    "jn_reportstale",
    oracle(
        """SELECT analysis_id, (decided_at > created_at) IS TRUE OR (ref_type <> 'COMMIT' AND latest_sha <> commit_sha) AS stale, CASE WHEN decided_at > created_at THEN 'DECISIONS_CHANGED' WHEN ref_type <> 'COMMIT' AND latest_sha <> commit_sha THEN 'TARGET_ADVANCED' END AS reason
FROM v_analysis LEFT JOIN (SELECT analysis_id, max(decided_at) AS decided_at FROM v_decision GROUP BY analysis_id) d USING (analysis_id)"""
    ),
)
def jn_reportstale(spark, sf):
    last = view(spark, sf, "v_decision").groupBy("analysis_id").agg(F.max("decided_at").alias("decided_at"))
    a = view(spark, sf, "v_analysis").join(last, "analysis_id", "left")
    reason = first_match([(F.col("decided_at") > F.col("created_at"), "DECISIONS_CHANGED"), (p.is_stale(F.col("ref_type"), F.col("latest_sha"), F.col("commit_sha")), "TARGET_ADVANCED")])
    return a.select("analysis_id", reason.isNotNull().alias("stale"), reason.alias("reason"))


_TRUE = "SELECT DISTINCT l_suppkey % 20 AS repo, l_partkey AS k FROM v_line WHERE qty % 2 = 0"
_GOT = "SELECT DISTINCT l_suppkey % 20 AS repo, l_partkey AS k FROM v_line WHERE qty % 3 = 0"


@query("jn_truth", oracle("SELECT repo, k, CASE WHEN g.repo IS NULL THEN 'MISSING' WHEN t.repo IS NULL THEN 'UNEXPECTED' ELSE 'MATCHED' END AS outcome FROM t FULL JOIN g USING (repo, k)", ("t", _TRUE), ("g", _GOT)))
def jn_truth(spark, sf):
    t = over(spark, sf, _TRUE, "v_line").withColumn("t", F.lit(True))
    g = over(spark, sf, _GOT, "v_line").withColumn("g", F.lit(True))
    return t.join(g, ["repo", "k"], "full_outer").select("repo", "k", first_match([(F.col("g").isNull(), "MISSING"), (F.col("t").isNull(), "UNEXPECTED")], "MATCHED").alias("outcome"))


_EDGES = "SELECT e.from_id, e.to_id, type, a.snapshot_id, a.artifact_id % 4 AS off FROM v_aedge e JOIN v_artifact a ON a.artifact_id = e.from_id"
_PROOF = "SELECT artifact_id AS evidence_id, artifact_id, CASE WHEN artifact_id % 5 = 0 THEN 'x' ELSE file_path END AS source_path, start_line, end_line FROM v_artifact"


@query(
    "jn_edge_valid",
    oracle(
        """SELECT e.from_id, e.to_id, type, evidence_id FROM e JOIN v_artifact a ON a.artifact_id = from_id JOIN v_artifact b ON b.artifact_id = to_id JOIN p ON p.artifact_id = from_id
WHERE a.snapshot_id = e.snapshot_id AND b.snapshot_id = e.snapshot_id AND type IN ('CALLS', 'TESTS') AND source_path = a.file_path AND a.start_line IS NOT NULL AND a.end_line % 7 + a.start_line + off <= a.end_line""",
        ("e", _EDGES), ("p", _PROOF),
    ),
)
def jn_edge_valid(spark, sf):
    located = over(spark, sf, _EDGES, "v_aedge", "v_artifact").join(view(spark, sf, "v_artifact").select(F.col("artifact_id").alias("from_id"), "start_line", "end_line"), "from_id")
    end = F.col("end_line") % 7 + F.col("start_line") + F.col("off")
    edges = located.select("from_id", "to_id", "type", "snapshot_id", F.array(F.struct(F.col("start_line").alias("start"), end.alias("end"))).alias("locations"))
    return j.valid_edges(edges, view(spark, sf, "v_artifact"), over(spark, sf, _PROOF, "v_artifact"))


@query("jn_audit", oracle("SELECT e.from_id, e.to_id, CASE WHEN e.to_id % 7 + 3 > a.end_line THEN 'LOCATION_OUTSIDE_ARTIFACT_RANGE' WHEN NOT contains(array_to_string(string_split(a.excerpt, chr(10))[e.to_id % 7 + 1 : e.to_id % 7 + 3], chr(10)), split_part(b.name, '_', 2)) THEN 'TARGET_CALL_NOT_AT_REPORTED_LOCATION' END AS reason FROM v_aedge e JOIN v_artifact a ON a.artifact_id = from_id JOIN v_artifact b ON b.artifact_id = to_id"))
def jn_audit(spark, sf):
    """Whether the target is named in the reported lines of the source; an edge reports three lines, from its target's remainder on."""
    a = view(spark, sf, "v_artifact").select(F.col("artifact_id").alias("from_id"), "end_line", F.split("excerpt", "\n").alias("lines"))
    b = view(spark, sf, "v_artifact").select(F.col("artifact_id").alias("to_id"), F.split_part("name", F.lit("_"), F.lit(2)).alias("target"))
    e = view(spark, sf, "v_aedge").withColumn("first", (F.col("to_id") % 7 + 1).cast("int")).join(a, "from_id").join(b, "to_id")
    reported = F.array_join(F.slice("lines", F.col("first"), F.lit(3)), "\n")
    return e.select("from_id", "to_id", first_match([(F.col("end_line") < F.col("first") + 2, "LOCATION_OUTSIDE_ARTIFACT_RANGE"), (~F.contains(reported, F.col("target")), "TARGET_CALL_NOT_AT_REPORTED_LOCATION")]).alias("reason"))


@query("jn_query_vec", oracle("SELECT vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dot FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"))
def jn_query_vec(spark, sf):
    from ..functions.vector import dot

    e = view(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)  # one row
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("dot"))


@query("jn_block_reason", oracle(f"SELECT run_id, list_sort(list_distinct(list({BLOCK_SQL}))) AS reasons FROM j GROUP BY run_id", ("j", JUDGED)))
def jn_block_reason(spark, sf):
    return judged(spark, sf).groupBy("run_id").agg(F.sort_array(F.collect_set(p.child_block(F.col("status"), F.col("stale"), F.col("decision")))).alias("reasons"))
