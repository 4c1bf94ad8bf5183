"""Queries over retrieval, domain packs and evidence for reasoning."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from ..functions.lookup import first_match
from ..functions.text import tokens
from ..functions.vector import unit
from ..operators import projections as p
from ..operators import retrieval as r
from ..operators.ordering import latest, top_per_group
from ..operators.review import catalogue_errors, normalised_claims
from ..registry import query
from .joins import over
from .views import oracle, view

REQUEST = "Refund the booking: rest endpoint must save th_r data of Brand ers and test it"
_INTENTS_SQL = "list_filter([CASE WHEN regexp_matches(lower(text), '(api|endpoint|controller|route|http)') THEN 'API' END, CASE WHEN regexp_matches(lower(text), '(business|logic|service|rule)') THEN 'SERVICE' END, CASE WHEN regexp_matches(lower(text), '(database|save|persist|data|model|schema|table)') THEN 'DATA' END, CASE WHEN regexp_matches(lower(text), '(test|qa|regression|verify|spec)') THEN 'TEST' END], lambda x: x IS NOT NULL)"


@query("rt_intent", oracle(f"SELECT request_id, {_INTENTS_SQL} AS intents FROM v_request"))
def rt_intent(spark, sf):
    return view(spark, sf, "v_request").select("request_id", r.intents(F.col("text")).alias("intents"))


_COS = "list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_KNN = f"SELECT c.artifact_id, {_COS} AS similarity FROM v_chunk c, (SELECT embedding FROM v_chunk WHERE chunk_id = 0) q ORDER BY similarity DESC, artifact_id LIMIT 40"


@query("rt_knn", oracle("SELECT query_id, artifact_id, round(similarity, 6) AS similarity FROM (SELECT q.chunk_id AS query_id, c.artifact_id, " + _COS + " AS similarity, row_number() OVER (PARTITION BY q.chunk_id ORDER BY " + _COS + " DESC, c.artifact_id) AS r FROM v_chunk c JOIN v_chunk q ON q.snapshot_id = c.snapshot_id WHERE q.chunk_id % 20 = 0) x WHERE r <= 10"))
def rt_knn(spark, sf):
    chunks = view(spark, sf, "v_chunk")
    found = r.nearest(chunks, chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "snapshot_id", "embedding"), 10)
    return found.select("query_id", "artifact_id", F.round("similarity", 6).alias("similarity"))


# What a request is searched by: the pack's terms that it holds, and its symbols.
_WORDS = [("rest", True), ("brand", True), ("th_r", False), ("ers", True)]
_KEYWORDS = "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {str(g).lower()})" for w, g in _WORDS) + ") v(keyword, glossary)"
_LEX = f"""SELECT artifact_id, max(CASE WHEN glossary AND contains(lower(name || ' ' || file_path), keyword) THEN CASE WHEN contains(lower('{REQUEST}'), keyword) THEN 1.0 ELSE 0.5 END ELSE 0.0 END)::DOUBLE AS domain
FROM v_artifact JOIN kw ON name ILIKE '%' || keyword || '%' OR file_path ILIKE '%' || keyword || '%' OR artifact_key ILIKE '%' || keyword || '%' GROUP BY artifact_id"""


def keywords(spark):
    return spark.createDataFrame(_WORDS, "keyword string, glossary boolean")


@query("rt_lex", oracle("SELECT * FROM lex", ("kw", _KEYWORDS), ("lex", _LEX)))
def rt_lex(spark, sf):
    return r.lexical_hits(view(spark, sf, "v_artifact"), keywords(spark), F.lit(REQUEST))


_SEEDS = """SELECT artifact_id, max(lexical) AS lexical, max(vector) AS vector, max(domain) AS domain, bool_or(v) AS has_vector FROM (SELECT artifact_id, 1.0 AS lexical, 0.0 AS vector, domain, false AS v FROM lex
UNION ALL SELECT artifact_id, 0.0, similarity, 0.0, similarity <> 0 FROM knn) x GROUP BY artifact_id"""
_CANDS = """SELECT artifact_id, lexical::DOUBLE AS lexical, vector, 1.0::DOUBLE AS graph, domain, 0 AS depth, has_vector FROM seeds UNION ALL
SELECT DISTINCT id, 0.0, 0.0, 0.7, 0.0, 1, false FROM (SELECT to_id AS id FROM v_aedge WHERE from_id IN (SELECT artifact_id FROM seeds) UNION SELECT from_id FROM v_aedge WHERE to_id IN (SELECT artifact_id FROM seeds)) n WHERE id NOT IN (SELECT artifact_id FROM seeds)"""
_PARTS = (("kw", _KEYWORDS), ("lex", _LEX), ("knn", _KNN), ("seeds", _SEEDS), ("cands", _CANDS))


def _vector(spark, sf):
    chunks = view(spark, sf, "v_chunk")
    q = chunks.where("chunk_id = 0").select(F.lit(0).alias("query_id"), F.lit(None).cast("int").alias("snapshot_id"), "embedding")
    return r.nearest(chunks, q, 40).select("artifact_id", "similarity")


def _edges(spark, sf):
    return view(spark, sf, "v_aedge").select("from_id", "to_id", "type")


@query("set_candidates", oracle("SELECT artifact_id, lexical, round(vector, 6) AS vector, graph, domain, depth FROM cands", *_PARTS))
def set_candidates(spark, sf):
    found = r.candidates(r.lexical_hits(view(spark, sf, "v_artifact"), keywords(spark), F.lit(REQUEST)), _vector(spark, sf), _edges(spark, sf))
    return found.select("artifact_id", "lexical", F.round("vector", 6).alias("vector"), "graph", "domain", "depth")


_SCORED = """SELECT *, round(lexical * 0.45 + graph * 0.15 + vector * 0.35 + kind * 0.05 - penalty, 9) AS score, list_filter([CASE WHEN lexical > 0 THEN 'LEXICAL' END, CASE WHEN domain > 0 THEN 'DOMAIN' END, CASE WHEN has_vector THEN 'VECTOR' END, CASE WHEN graph > 0 THEN 'GRAPH' END, CASE WHEN kind > 0 THEN 'KIND' END], lambda x: x IS NOT NULL) AS signals
FROM (SELECT c.*, artifact_key, universal_kind, CASE WHEN regexp_matches(lower(file_path), 'notification|audit|logger|recommendation|discount') THEN 0.15 ELSE 0.0 END AS penalty, CASE WHEN universal_kind IN ('API_ENDPOINT', 'DATA_MODEL', 'TEST_CASE') THEN 1.0 ELSE 0.0 END AS kind
 FROM cands c JOIN v_artifact a ON a.artifact_id = c.artifact_id) y"""
_METHOD = "CASE WHEN len(signals) = 1 OR (len(signals) = 2 AND list_contains(signals, 'DOMAIN')) THEN CASE WHEN list_contains(signals, 'GRAPH') THEN 'GRAPH_EXPANSION' WHEN list_contains(signals, 'VECTOR') THEN 'VECTOR' ELSE 'LEXICAL' END ELSE 'HYBRID' END"
_HYBRID = f"SELECT artifact_id, artifact_key, round(score, 6) AS score, {_METHOD} AS method, signals, lexical, graph, round(vector, 6) AS vector, penalty::DOUBLE AS penalty, kind::DOUBLE AS kind FROM sc WHERE score > 0 ORDER BY sc.score DESC, artifact_key LIMIT 20"


def hybrid(spark, sf, t: r.Tuning = r.Tuning()):
    return r.retrieve(view(spark, sf, "v_artifact"), keywords(spark), _vector(spark, sf), _edges(spark, sf), REQUEST, t)


@query("rt_hybrid", oracle(_HYBRID, *_PARTS, ("sc", _SCORED)))
def rt_hybrid(spark, sf):
    return hybrid(spark, sf).select("artifact_id", "artifact_key", F.round("score", 6).alias("score"), "method", "signals", "lexical", "graph", F.round("vector", 6).alias("vector"), "penalty", "kind")


def _all_scored(spark, sf):
    found = r.candidates(r.lexical_hits(view(spark, sf, "v_artifact"), keywords(spark), F.lit(REQUEST)), _vector(spark, sf), _edges(spark, sf))
    return r.scored(found, view(spark, sf, "v_artifact"), r.intents(F.lit(REQUEST)), F.lit(True))


@query("rt_kind", oracle("SELECT artifact_id, kind::DOUBLE AS kind FROM sc WHERE score > 0", *_PARTS, ("sc", _SCORED)))
def rt_kind(spark, sf):
    return _all_scored(spark, sf).select("artifact_id", "kind")


@query("rt_method", oracle(f"SELECT artifact_id, {_METHOD} AS method FROM sc WHERE score > 0", *_PARTS, ("sc", _SCORED)))
def rt_method(spark, sf):
    return _all_scored(spark, sf).select("artifact_id", "method")


@query("rt_penalty", oracle("SELECT k.artifact_id, (CASE WHEN regexp_matches(lower(file_path), 'notification|audit|logger|recommendation|discount') THEN 0.15 WHEN similarity < 0.72 THEN 0.12 WHEN similarity < 0.75 THEN CASE WHEN artifact_type = 'TEST' OR contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec') THEN 0.05 ELSE 0.1 END ELSE 0.0 END)::DOUBLE AS penalty FROM knn k JOIN v_artifact a ON a.artifact_id = k.artifact_id WHERE similarity * 0.35 > 0.16", ("knn", _KNN)))
def rt_penalty(spark, sf):
    """Vector hits alone, weak ones kept: no graph, no words, no intents."""
    nothing = spark.createDataFrame([], "artifact_id long, domain double")
    found = r.candidates(nothing, _vector(spark, sf), None).where("vector * 0.35 > 0.16")
    return r.scored(found, view(spark, sf, "v_artifact"), F.array().cast("array<string>"), F.lit(False), r.Tuning(keep_weak=True)).select("artifact_id", "penalty")


@query(
    "rt_evidence",
    oracle(
        f"""SELECT artifact_id, evidence_id, CASE WHEN method IN ('HYBRID', 'LEXICAL') OR list_contains(signals, 'LEXICAL') THEN 'EVIDENCED' ELSE 'INFERRED' END AS basis FROM (SELECT * FROM h WHERE method <> 'GRAPH_EXPANSION') t
JOIN (SELECT artifact_id, max(evidence_id) AS evidence_id FROM v_evidence GROUP BY artifact_id) e USING (artifact_id)""",
        *_PARTS, ("sc", _SCORED), ("h", _HYBRID),
    ),
)
def rt_evidence(spark, sf):
    """The best twenty, without those that only the graph names and those without evidence, as links."""
    top = hybrid(spark, sf).where("method <> 'GRAPH_EXPANSION'")
    last = view(spark, sf, "v_evidence").where("artifact_id is not null").groupBy("artifact_id").agg(F.max("evidence_id").alias("evidence_id"))
    return top.join(last, "artifact_id").select("artifact_id", "evidence_id", p.link_basis(F.col("method"), F.col("signals")).alias("basis"))


_TOKENS = "list_filter(string_split(lower(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2{})"
# Words that say nothing, and how many words of an excerpt the baseline reads.
STOPS, EXCERPT_WORDS = ["the", "and", "for", "that", "this", "with", "from", "a", "an"], 50
_STOPPED = " AND w NOT IN (" + ", ".join(f"'{w}'" for w in STOPS) + ")"


@query(
    "rt_lexeval",
    oracle(
        """SELECT request_id, artifact_id, score FROM (SELECT r.request_id, a.artifact_id, a.universal_kind, file_path, name, artifact_key, coalesce(n, 0) + CASE WHEN a.universal_kind = 'API_ENDPOINT' THEN 2 * contains(lower(text), 'api')::INT + 2 * contains(lower(text), 'webhook')::INT
  WHEN a.universal_kind = 'DOMAIN_SERVICE' THEN 2 * contains(lower(text), 'service')::INT WHEN a.universal_kind = 'TEST_CASE' THEN 2 * (contains(lower(text), 'test') OR contains(lower(text), 'qa'))::INT ELSE 0 END AS score
 FROM v_request r CROSS JOIN v_artifact a LEFT JOIN o ON o.request_id = r.request_id AND o.artifact_id = a.artifact_id WHERE a.universal_kind <> 'DOMAIN_SERVICE' OR a.artifact_id IN (SELECT from_id FROM v_aedge UNION SELECT to_id FROM v_aedge)) y
WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, universal_kind, file_path, name, artifact_key, artifact_id) <= 20""",
        ("q", f"SELECT DISTINCT request_id, unnest({_TOKENS.format('text', _STOPPED)}) AS w FROM v_request"),
        ("x", f"SELECT artifact_id, w, min(i) AS i FROM (SELECT artifact_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT artifact_id, {_TOKENS.format('excerpt', _STOPPED)} AS l FROM v_artifact) y) z GROUP BY artifact_id, w"),
        ("w", f"SELECT artifact_id, w FROM x QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY i) <= {EXCERPT_WORDS} UNION SELECT artifact_id, unnest({_TOKENS.format('t', _STOPPED)}) FROM (SELECT artifact_id, concat_ws(' ', artifact_key, name, file_path, artifact_type, universal_kind) AS t FROM v_artifact) y"),
        ("o", "SELECT request_id, artifact_id, count(*) AS n FROM q JOIN w USING (w) GROUP BY request_id, artifact_id"),
    ),
)
def rt_lexeval(spark, sf):
    """The plain baseline: shared words and boosts for wanted kinds; services count only if the graph knows them.

    An artifact without a shared word can only be among a request's best by its kind's boost, so of each kind the first
    twenty are enough.
    """
    known = lambda c: F.filter(tokens(c), lambda w: ~w.isin(STOPS))
    requests, e = view(spark, sf, "v_request"), view(spark, sf, "v_aedge")
    linked = e.select(F.col("from_id").alias("artifact_id")).union(e.select("to_id")).distinct().withColumn("linked", F.lit(True))
    artifacts = view(spark, sf, "v_artifact").join(linked, "artifact_id", "left").where("universal_kind <> 'DOMAIN_SERVICE' OR linked")
    names = F.concat_ws(" ", "artifact_key", "name", "file_path", "artifact_type", "universal_kind")
    words = artifacts.select("artifact_id", F.explode(F.array_union(known(names), F.slice(known(F.col("excerpt")), 1, EXCERPT_WORDS))).alias("w"))
    shared = requests.select("request_id", F.explode(known(F.col("text"))).alias("w")).join(words, "w").groupBy("request_id", "artifact_id").agg(F.count(F.lit(1)).alias("n"))
    low = F.lower("text")
    two = lambda *said: F.when(reduce(or_, [low.contains(x) for x in said]), 2).otherwise(0)
    wanted = F.array(*[F.struct(F.lit(k).alias("universal_kind"), b.alias("boost")) for k, b in (("API_ENDPOINT", two("api") + two("webhook")), ("DOMAIN_SERVICE", two("service")), ("TEST_CASE", two("test", "qa")))])
    boosts = requests.select("request_id", F.explode(wanted).alias("b")).select("request_id", "b.*").where("boost > 0")
    order = ["universal_kind", "file_path", "name", "artifact_key", "artifact_id"]
    firsts = top_per_group(artifacts.select(*order), ["universal_kind"], [F.col(c) for c in order], 20)
    alone = boosts.join(firsts, "universal_kind").select("request_id", "artifact_id", F.lit(0).cast("long").alias("n"))
    rows = shared.unionByName(alone).groupBy("request_id", "artifact_id").agg(F.max("n").alias("n")).join(artifacts.select(*order), "artifact_id").join(boosts, ["request_id", "universal_kind"], "left")
    ranked = top_per_group(rows.withColumn("score", F.col("n") + F.coalesce("boost", F.lit(0))), ["request_id"], [F.col("score").desc(), *[F.col(c) for c in order]], 20)
    return ranked.select("request_id", "artifact_id", "score")


@query(
    "srt_lexscore",
    oracle(
        "SELECT request_id, artifact_id, 10 * n AS score FROM (SELECT request_id, artifact_id, count(*) AS n FROM q JOIN w USING (w) GROUP BY request_id, artifact_id) o QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY n DESC, artifact_id) <= 12",
        ("q", f"SELECT DISTINCT request_id, unnest({_TOKENS.format('text', '')}) AS w FROM v_request"),
        ("w", f"SELECT DISTINCT artifact_id, unnest({_TOKENS.format('t', '')}) AS w FROM (SELECT artifact_id, concat_ws(' ', name, file_path, excerpt) AS t FROM v_artifact) y"),
    ),
)
def srt_lexscore(spark, sf):
    """Ten for each shared word of the whole texts; the best twelve."""
    words = tokens(F.col("text")).alias("words")
    q = view(spark, sf, "v_request").select("request_id", words)
    a = view(spark, sf, "v_artifact").select("artifact_id", F.concat_ws(" ", "name", "file_path", "excerpt").alias("text")).select("artifact_id", words)
    top = r.most_shared(q, a, 12)
    return top.select("request_id", "artifact_id", (10 * F.col("n")).alias("score"))


@query("em_chunk", oracle("SELECT artifact_id, concat(snapshot_id, ':', artifact_key, ':', CASE WHEN artifact_type IN ('SERVICE_METHOD', 'API_ROUTE') THEN 'METHOD_BODY' WHEN artifact_type = 'ENTITY' THEN 'ENTITY_CONTEXT' WHEN artifact_type = 'TEST' THEN 'TEST_CASE' WHEN artifact_type = 'SERVICE' THEN 'CLASS_CONTEXT' ELSE 'ARTIFACT_SUMMARY' END) AS chunk_id, md5(concat_ws(chr(10), 'artifactKey: ' || artifact_key, 'symbol: ' || name, 'type: ' || artifact_type, 'file: ' || file_path, 'excerpt:', excerpt)) AS content_md5 FROM v_artifact"))
def em_chunk(spark, sf):
    a = view(spark, sf, "v_artifact")
    lines = [F.concat(F.lit(f"{n}: "), c) for n, c in (("artifactKey", "artifact_key"), ("symbol", "name"), ("type", "artifact_type"), ("file", "file_path"))]
    excerpt = F.when(F.length("excerpt") > 0, F.concat(F.lit("excerpt:\n"), "excerpt"))
    return a.select("artifact_id", F.concat_ws(":", "snapshot_id", "artifact_key", p.chunk_type(F.col("artifact_type"))).alias("chunk_id"), F.md5(F.concat_ws("\n", *lines, excerpt)).alias("content_md5"))


@query("em_unit", oracle("SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS length2, round(u[3], 6) AS third FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) x) y"))
def em_unit(spark, sf):
    u = view(spark, sf, "embeddings").select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length2"), F.round(F.get("u", F.lit(2)), 6).alias("third"))


@query("ai_pack", oracle("SELECT analysis_id, md5(string_agg(concat('[', evidence_id, '] ', excerpt), chr(10) ORDER BY evidence_id)) AS pack_md5, count(*) AS items FROM (SELECT * FROM v_evidence QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY evidence_id) <= 12) x GROUP BY analysis_id"))
def ai_pack(spark, sf):
    """The text of at most twelve pieces of evidence, in order."""
    top = top_per_group(view(spark, sf, "v_evidence"), ["analysis_id"], [F.col("evidence_id")], 12)
    line = F.struct("evidence_id", F.concat(F.lit("["), "evidence_id", F.lit("] "), "excerpt").alias("line"))
    packs = top.groupBy("analysis_id").agg(F.sort_array(F.collect_list(line)).alias("l"))
    return packs.select("analysis_id", F.md5(F.array_join("l.line", "\n")).alias("pack_md5"), F.size("l").cast("long").alias("items"))


_SAID = """SELECT i.analysis_id, i.insight_id, CASE WHEN i.insight_id % 29 = 0 THEN 'key' ELSE concat('key-', i.insight_id) END AS insight_key, CASE WHEN i.insight_id % 17 = 0 THEN 'QUESTION' ELSE insight_type END AS insight_type, certainty, 50 + i.insight_id % 50 AS confidence,
 CASE i.insight_id % 4 WHEN 0 THEN 'Given: a cart. When: paid. Then: shipped' WHEN 1 THEN 'given: a cart, then: shipped' ELSE statement END AS description, CASE WHEN i.insight_id % 3 > 0 THEN 'a cart' END AS given,
 CASE WHEN i.insight_id % 3 > 1 THEN 'paid' END AS when_, CASE WHEN i.insight_id % 5 > 1 THEN 'shipped' WHEN i.insight_id % 5 = 1 THEN '' END AS then_, coalesce(n, 0) AS n_evidence, CASE WHEN i.insight_id % 7 = 0 THEN 1 ELSE 0 END AS n_related
FROM v_insight i LEFT JOIN (SELECT insight_id, count(DISTINCT evidence_id) * (1 + insight_id % 2) AS n FROM v_insight_evidence GROUP BY insight_id) b ON b.insight_id = i.insight_id"""
_TYPED = """SELECT *, CASE WHEN insight_type = 'QA_SCENARIO' AND NOT (coalesce(given <> '' AND when_ <> '' AND then_ <> '', false) OR (lower(description) LIKE '%given:%' AND lower(description) LIKE '%when:%' AND lower(description) LIKE '%then:%')) THEN 'UNKNOWN' ELSE insight_type END AS t FROM said"""
_HELD = "SELECT *, t IN ('QUESTION', 'UNKNOWN') AS undecided, t IN ('QA_SCENARIO', 'ACCEPTANCE_CRITERIA') AND n_evidence + n_related = 0 AS untraced FROM typed"
_PROVEN = "SELECT *, CASE WHEN undecided OR untraced OR certainty = 'UNKNOWN' THEN NULL WHEN certainty = 'EVIDENCED' AND n_evidence = 0 THEN 'EVIDENCED_DOWNGRADED_NO_PERSISTED_EVIDENCE' WHEN certainty = 'INFERRED' AND n_evidence = 0 THEN 'INFERRED_DOWNGRADED_NO_CONTEXTUAL_EVIDENCE' WHEN certainty = 'CONFLICTING' AND n_evidence < 2 THEN 'CONFLICTING_DOWNGRADED_INSUFFICIENT_EVIDENCE' END AS bare FROM held"


@query(
    "ai_normalise",
    oracle(
        """SELECT insight_id, t AS insight_type, CASE WHEN undecided OR untraced OR bare IS NOT NULL THEN 'UNKNOWN' ELSE certainty END AS certainty, CASE WHEN NOT undecided THEN confidence END AS confidence, CASE WHEN t <> insight_type THEN 'QA_SCENARIO_DOWNGRADED_NOT_TESTABLE' END AS qa_integrity,
 CASE WHEN untraced THEN concat(t, '_DOWNGRADED_NO_TRACEABLE_CONTEXT') END AS traceability_integrity, bare AS evidence_integrity, CASE WHEN untraced OR bare IS NOT NULL THEN certainty END AS original_certainty,
 CASE WHEN row_number() OVER (PARTITION BY analysis_id, insight_key ORDER BY insight_id) > 1 THEN 'AI_OUTPUT_SCHEMA_VALIDATION_FAILED' END AS error FROM proved""",
        ("said", _SAID), ("typed", _TYPED), ("held", _HELD), ("proved", _PROVEN),
    ),
)
def ai_normalise(spark, sf):
    """Claims are held to the evidence that is stored for them; scenarios that cannot be tested become unknowns."""
    return normalised_claims(over(spark, sf, _SAID, "v_insight_evidence", "v_insight"))


@query(
    "ai_diag",
    oracle(
        "SELECT code, path, coalesce(term, '') AS term, min(event_id) AS event_id, concat('diag_risk_', lower(code), '_', substr(sha256(concat(code, '::', path, '::unknown::', coalesce(term, ''))), 1, 8)) AS insight_key FROM v_diagnostic WHERE severity IN ('WARN', 'ERROR') AND (code IN ('FILE_LIMIT_EXCEEDED', 'DI_BOUNDARY') OR category IN ('LIMIT', 'SECURITY') OR (term IS NOT NULL AND code = 'ROUTE_UNSUPPORTED')) AND code <> 'SCANNER_CAPABILITY_SUMMARY' GROUP BY code, path, term"
    ),
)
def ai_diag(spark, sf):
    """Diagnostics that reach analyses, once per structured key, as unknowns."""
    d = view(spark, sf, "v_diagnostic").where(F.col("severity").isin("WARN", "ERROR"))
    mode = p.propagation(F.col("code"), F.col("severity"), F.col("category"), F.col("term").isNotNull().cast("int"))
    rows = d.where(mode != "NONE").withColumn("term", F.coalesce("term", F.lit(""))).groupBy("code", "path", "term").agg(F.min("event_id").alias("event_id"))
    key = F.concat_ws("::", "code", "path", F.lit("unknown"), "term")
    return rows.withColumn("insight_key", F.concat(F.lit("diag_risk_"), F.lower("code"), F.lit("_"), F.substring(F.sha2(key, 256), 1, 8)))


_PACKS = [("booking", "0.1.0", False), ("inventory", "0.2.0", True), ("general", "1.0.0", False)]
_PACK_SQL = "SELECT * FROM (VALUES ('booking', '0.1.0', false), ('inventory', '0.2.0', true), ('general', '1.0.0', false)) v(pack, version, explicit_only)"
_ASKED = "SELECT analysis_id, domain, CASE analysis_id % 6 WHEN 0 THEN 'inventory@0.2.0' WHEN 1 THEN 'booking@9.9.9' WHEN 2 THEN 'nothing' WHEN 3 THEN 'booking' ELSE NULL END AS asked FROM v_analysis"


@query(
    "dp_select",
    oracle(
        """SELECT analysis_id, CASE WHEN asked IS NOT NULL THEN e.pack WHEN d.pack IS NOT NULL AND NOT d.explicit_only THEN d.pack ELSE 'general' END AS pack, CASE WHEN asked IS NOT NULL THEN 'EXPLICIT' WHEN d.pack IS NOT NULL AND NOT d.explicit_only THEN 'REPOSITORY_PROFILE' ELSE 'FALLBACK' END AS selected_by,
 CASE WHEN asked IS NOT NULL AND e.pack IS NULL THEN 'UNSUPPORTED_DOMAIN_PACK' WHEN contains(asked, '@') AND split_part(asked, '@', 2) <> e.version THEN 'UNSUPPORTED_DOMAIN_PACK_VERSION' END AS error FROM a LEFT JOIN pk e ON e.pack = split_part(asked, '@', 1) LEFT JOIN pk d ON d.pack = a.domain""",
        ("pk", _PACK_SQL), ("a", _ASKED),
    ),
)
def dp_select(spark, sf):
    """The domain pack of an analysis: the one asked for, else its repository's, else the general one."""
    packs = spark.createDataFrame(_PACKS, "pack string, version string, explicit_only boolean")
    asked = over(spark, sf, _ASKED, "v_analysis").withColumn("name", F.split_part("asked", F.lit("@"), F.lit(1)))
    e = F.broadcast(packs.toDF("name", "version", "x"))
    d = F.broadcast(packs.where("not explicit_only").select(F.col("pack").alias("domain"), F.col("pack").alias("own")))
    rows = asked.join(e.withColumn("found", F.col("name")), "name", "left").join(d, "domain", "left")
    want = F.col("asked").isNotNull()
    error = first_match([(want & F.col("found").isNull(), "UNSUPPORTED_DOMAIN_PACK"), (F.contains("asked", F.lit("@")) & (F.split_part("asked", F.lit("@"), F.lit(2)) != F.col("version")), "UNSUPPORTED_DOMAIN_PACK_VERSION")])
    return rows.select("analysis_id", F.when(want, F.col("found")).otherwise(F.coalesce("own", F.lit("general"))).alias("pack"), first_match([(want, "EXPLICIT"), (F.col("own").isNotNull(), "REPOSITORY_PROFILE")], "FALLBACK").alias("selected_by"), error.alias("error"))


_CONCEPTS = [("refund", "rest"), ("refund", "ers "), ("stock", "onth"), ("stock", "zzz"), ("pay", "qqq")]
_CONCEPT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in _CONCEPTS) + ") v(concept, alias)"


@query("dp_concepts", oracle("SELECT DISTINCT request_id, concept FROM v_request JOIN c ON contains(lower(text), alias)", ("c", _CONCEPT_SQL)))
def dp_concepts(spark, sf):
    from ..operators.joins import named_terms

    aliases = spark.createDataFrame(_CONCEPTS, "concept string, term string")
    return named_terms(view(spark, sf, "v_request"), aliases).select("request_id", "concept").distinct()


_CATALOGUE = """SELECT c_custkey AS place, concat(CASE WHEN c_custkey % 13 = 0 THEN 'Pack-' ELSE 'pack-' END, c_custkey % 40) AS pack, CASE WHEN c_custkey % 11 = 0 THEN 'v1' WHEN c_custkey % 12 = 0 THEN '1.02.0' ELSE concat('1.', c_custkey % 3, '.0') END AS version,
 CASE c_custkey % 5 WHEN 0 THEN 'PARTIAL' WHEN 1 THEN 'DRAFT' WHEN 2 THEN 'EXPERIMENTAL' ELSE 'STABLE' END AS status, CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN concat('Al', c_custkey, ', al', c_custkey) ELSE concat('name', c_custkey, ',n', c_custkey % 90) END AS alias_list,
 c_custkey % 10 AS limits, c_custkey % 2 = 0 AS explicit_only FROM customer"""


@query(
    "dp_govern",
    oracle(
        """SELECT place, unnest(list_filter([CASE WHEN alias_list IS NULL THEN 'DOMAIN_PACK_ALIASES_REQUIRED' END, CASE WHEN pack LIKE 'P%' THEN 'INVALID_DOMAIN_PACK_ID' END, CASE WHEN version IN ('v1', '1.02.0') THEN 'INVALID_DOMAIN_PACK_VERSION' END, CASE WHEN status = 'DRAFT' THEN 'INVALID_DOMAIN_PACK_STATUS' END,
 CASE WHEN status = 'PARTIAL' AND limits = 0 THEN 'PARTIAL_DOMAIN_PACK_REQUIRES_KNOWN_LIMITS' END, CASE WHEN status = 'PARTIAL' AND NOT explicit_only THEN 'PARTIAL_DOMAIN_PACK_REQUIRES_EXPLICIT_SELECTION' END, CASE WHEN before <> name THEN 'MULTIPLE_ACTIVE_DOMAIN_PACK_VERSIONS_UNSUPPORTED' END, CASE WHEN again THEN 'DUPLICATE_DOMAIN_PACK_VERSION' END], lambda x: x IS NOT NULL)) AS code, NULL AS alias
FROM (SELECT *, lag(name) OVER (PARTITION BY pack ORDER BY place) AS before, row_number() OVER (PARTITION BY name ORDER BY place) > 1 AS again FROM e) y
UNION ALL SELECT u.place, 'DUPLICATE_DOMAIN_PACK_ALIAS', u.alias FROM u WHERE earlier > 0 UNION ALL SELECT u.place, 'DUPLICATE_DOMAIN_PACK_ALIAS', u.alias FROM u JOIN (SELECT alias, arg_min(name, (place, nth)) AS owner FROM u GROUP BY alias) o USING (alias) WHERE owner <> name""",
        ("c", _CATALOGUE), ("e", "SELECT *, concat(pack, '@', version) AS name FROM c"),
        ("u", "SELECT *, row_number() OVER (PARTITION BY place, alias ORDER BY nth) - 1 AS earlier FROM (SELECT place, name, lower(trim(a)) AS alias, nth FROM (SELECT place, name, unnest(string_split(alias_list, ',')) AS a, generate_subscripts(string_split(alias_list, ','), 1) AS nth FROM e WHERE alias_list IS NOT NULL) x) y"),
    ),
)
def dp_govern(spark, sf):
    """What is wrong with a catalogue of domain packs."""
    entries = over(spark, sf, _CATALOGUE, "customer")
    return catalogue_errors(entries.withColumn("aliases", F.coalesce(F.split("alias_list", ","), F.array().cast("array<string>"))))


@query("dp_aliases", oracle("SELECT lower(name) AS alias, count(DISTINCT universal_kind) AS owners FROM v_artifact GROUP BY lower(name) HAVING count(DISTINCT universal_kind) > 1"))
def dp_aliases(spark, sf):
    """Aliases that more than one concept claims."""
    return view(spark, sf, "v_artifact").groupBy(F.lower("name").alias("alias")).agg(F.countDistinct("universal_kind").alias("owners")).where("owners > 1")


@query("doc_dedupe_ev", oracle("SELECT source_path, arg_min(evidence_id, evidence_id) AS evidence_id FROM v_evidence WHERE source_path IS NOT NULL GROUP BY source_path"))
def doc_dedupe_ev(spark, sf):
    """The appendix names each source once, by its first evidence."""
    first = view(spark, sf, "v_evidence").where("source_path is not null").withColumn("o", -F.col("evidence_id"))
    return latest(first.select("source_path", "evidence_id", "o"), ["source_path"], ["o"]).select("source_path", "evidence_id")


@query("doc_consol", oracle("SELECT run_id, insight_id, CASE WHEN insight_type = 'QA_SCENARIO' THEN 'QA' ELSE 'RISK' END AS section FROM v_insight i JOIN v_analysis a ON a.analysis_id = i.analysis_id WHERE review_status <> 'REJECTED' AND (insight_type IN ('QA_SCENARIO', 'UNKNOWN') OR certainty = 'CONFLICTING')"))
def doc_consol(spark, sf):
    """The merged report's risks and scenarios, without rejected ones."""
    i = view(spark, sf, "v_insight").where("review_status <> 'REJECTED' AND (insight_type IN ('QA_SCENARIO', 'UNKNOWN') OR certainty = 'CONFLICTING')")
    section = F.when(F.col("insight_type") == "QA_SCENARIO", "QA").otherwise("RISK")
    return i.join(view(spark, sf, "v_analysis").select("analysis_id", "run_id"), "analysis_id").select("run_id", "insight_id", section.alias("section"))
