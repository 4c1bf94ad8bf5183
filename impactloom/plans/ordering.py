"""Queries over windows, sorts, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookup import first_match, rank_of
from ..operators import ordering as o
from ..registry import query
from .joins import CHANGES, TERMS, changes, over
from .views import oracle, view


@query("win_latest", oracle("SELECT analysis_id, arg_max(decision_id, (decided_at, decision_id)) AS decision_id, arg_max(decision, (decided_at, decision_id)) AS decision, max(decided_at) AS decided_at FROM v_decision GROUP BY analysis_id"))
def win_latest(spark, sf):
    return o.latest(view(spark, sf, "v_decision"), ["analysis_id"], ["decided_at", "decision_id"])


@query("win_occurrence", oracle("SELECT event_id, idempotency_key, row_number() OVER (PARTITION BY idempotency_key ORDER BY ts, event_id) AS occurrence FROM v_event"))
def win_occurrence(spark, sf):
    return o.occurrences(view(spark, sf, "v_event"), ["idempotency_key"], ["ts", "event_id"]).select("event_id", "idempotency_key", "occurrence")


@query("win_unique", oracle("SELECT event_id FROM v_event QUALIFY count(*) OVER (PARTITION BY idempotency_key) = 1"))
def win_unique(spark, sf):
    return o.unique_only(view(spark, sf, "v_event"), ["idempotency_key"]).select("event_id")


_BUDGET = "SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents"


@query("win_budget", oracle("SELECT source, doc_id, length(text) > 30000 - b AS truncated, CASE WHEN length(text) > 30000 - b THEN (30000 - b + 16)::BIGINT ELSE length(text) END AS chars FROM x WHERE r <= 12 AND (length(text) <= 30000 - b OR 30000 - b > 500)", ("x", _BUDGET)))
def win_budget(spark, sf):
    kept = o.within_budget(view(spark, sf, "documents").select("source", "doc_id", "text"), ["source"], [F.col("doc_id")], "text")
    return kept.select("source", "doc_id", "truncated", F.length("text").cast("long").alias("chars"))


_SCORED = "SELECT l_suppkey AS run, line_id, round(qty / 50.0, 2) AS score FROM v_line"


@query(
    "win_cutoff",
    oracle("SELECT run, line_id FROM (SELECT *, max(CASE WHEN r = 20 THEN score END) OVER (PARTITION BY run) AS t FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, line_id) AS r FROM s) y) x WHERE r <= 20 OR (r <= 100 AND score >= t * 0.9)", ("s", _SCORED)),
)
def win_cutoff(spark, sf):
    s = over(spark, sf, _SCORED, "v_line").withColumn("score", F.col("score").cast("double"))
    return o.adaptive_cutoff(s, ["run"], "score", ["line_id"], 20, 0.1).select("run", "line_id")


@query(
    "win_roundrobin",
    oracle(
        """SELECT artifact_key, change, pick FROM (SELECT *, row_number() OVER (ORDER BY turn, l) AS pick FROM (SELECT artifact_key, change, row_number() OVER (PARTITION BY change ORDER BY artifact_key) AS turn, list_position(['added', 'removed', 'changed', 'unknown'], change) AS l FROM c WHERE change <> 'unchanged') y) x WHERE pick <= 10""",
        ("c", CHANGES),
    ),
)
def win_roundrobin(spark, sf):
    picked = o.interleaved(changes(spark, sf), [], ["added", "removed", "changed", "unknown"], "change", ["artifact_key"], 10)
    return picked.select("artifact_key", "change", "pick")


@query("win_repo_limit", oracle("SELECT source, doc_id, count(*) OVER w <= 30 AND sum(n_chars) OVER w <= 60000 AS kept FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def win_repo_limit(spark, sf):
    return o.within_limits(view(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 30, 60_000).select("source", "doc_id", "kept")


_LANGS = "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang"


@query("win_rank2", oracle("SELECT source, lang, n, n - coalesce(nx, 0) AS margin FROM (SELECT *, lead(n) OVER w AS nx, row_number() OVER w AS r FROM x WINDOW w AS (PARTITION BY source ORDER BY n DESC, lang)) y WHERE r = 1", ("x", _LANGS)))
def win_rank2(spark, sf):
    return o.margin(over(spark, sf, _LANGS, "documents"), ["source"], "n", ["lang"])


@query("srt_topk", oracle("SELECT run, line_id, score::DOUBLE AS score FROM s WHERE run = 7 ORDER BY score DESC, line_id LIMIT 20", ("s", _SCORED)))
def srt_topk(spark, sf):
    s = over(spark, sf, _SCORED, "v_line").where("run = 7")
    return s.select("run", "line_id", F.col("score").cast("double").alias("score")).orderBy(F.col("score").desc(), "line_id").limit(20)


@query("srt_sample", oracle("SELECT artifact_key, universal_kind FROM v_artifact ORDER BY universal_kind, file_path, name, artifact_key LIMIT 20"))
def srt_sample(spark, sf):
    return view(spark, sf, "v_artifact").select("artifact_key", "universal_kind", "file_path", "name").orderBy("universal_kind", "file_path", "name", "artifact_key").limit(20).select("artifact_key", "universal_kind")


@query("srt_offset", oracle("SELECT p_partkey, p_name, (SELECT count(*) FROM part) > 75 AS has_more FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50"))
def srt_offset(spark, sf):
    return o.page(view(spark, sf, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 25, 50)


@query("srt_keyset", oracle("SELECT from_id, to_id, type FROM v_edge WHERE (from_id, to_id) > (500, 3) ORDER BY from_id, to_id, type LIMIT 50"))
def srt_keyset(spark, sf):
    after = (F.col("from_id") > 500) | ((F.col("from_id") == 500) & (F.col("to_id") > 3))
    return view(spark, sf, "v_edge").where(after).orderBy("from_id", "to_id", "type").limit(50)


@query(
    "srt_rankmap",
    oracle("SELECT link_id, row_number() OVER (ORDER BY CASE decision WHEN 'REJECTED' THEN 1 WHEN 'ACCEPTED' THEN 2 ELSE 3 END, CASE link_basis WHEN 'INFERRED' THEN 1 ELSE 2 END, link_id) AS place FROM v_link"),
)
def srt_rankmap(spark, sf):
    order = [rank_of(F.coalesce("decision", F.lit("")), ["REJECTED", "ACCEPTED"]), rank_of(F.col("link_basis"), ["INFERRED"]), F.col("link_id")]
    return o.places(view(spark, sf, "v_link"), order, "place").select("link_id", "place")


_QUEUED = """SELECT 'INSIGHT' AS source, insight_id AS item_id, analysis_id, CASE WHEN insight_type = 'UNKNOWN' THEN 90 WHEN certainty = 'EVIDENCED' AND insight_id % 3 = 0 THEN 80 WHEN insight_id % 3 = 1 THEN 70 ELSE 30 END AS rank FROM v_insight WHERE review_status = 'NEEDS_REVIEW'
UNION ALL SELECT 'TRACEABILITY', link_id, analysis_id, CASE link_id % 3 WHEN 0 THEN 80 WHEN 1 THEN 70 ELSE 30 END FROM v_link WHERE review_status = 'NEEDS_REVIEW'"""


@query("srt_queue", oracle("SELECT source, item_id, analysis_id, rank, CASE WHEN rank >= 80 THEN 'HIGH' WHEN rank >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM q", ("q", _QUEUED)))
def srt_queue(spark, sf):
    """What is left to review; the confidence of a retrieval is by identifier here."""
    conf = lambda c: first_match([(F.col(c) % 3 == 0, "STRONG"), (F.col(c) % 3 == 1, "MODERATE")], "UNKNOWN")
    i = view(spark, sf, "v_insight").where("review_status NOT IN ('CONFIRMED', 'REJECTED')").withColumn("c", conf("insight_id"))
    li = view(spark, sf, "v_link").where("review_status NOT IN ('CONFIRMED', 'REJECTED')").withColumn("c", conf("link_id"))
    ri = F.when(F.col("insight_type") == "UNKNOWN", 90).when((F.col("certainty") == "EVIDENCED") & (F.col("c") == "STRONG"), 80).when(F.col("c") == "MODERATE", 70).otherwise(30)
    rl = F.when(F.col("c") == "STRONG", 80).when(F.col("c") == "MODERATE", 70).otherwise(30)
    queue = o.merged([i.select(F.lit("INSIGHT").alias("source"), F.col("insight_id").alias("item_id"), "analysis_id", ri.alias("rank")), li.select(F.lit("TRACEABILITY").alias("source"), F.col("link_id").alias("item_id"), "analysis_id", rl.alias("rank"))])
    return queue.withColumn("priority", first_match([(F.col("rank") >= 80, "HIGH"), (F.col("rank") >= 60, "MEDIUM")], "LOW")).orderBy(F.col("rank").desc(), "source", "item_id")


@query("srt_timeline", oracle("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END, md5(text)) AS place FROM conversations"))
def srt_timeline(spark, sf):
    c = view(spark, sf, "conversations")
    return o.occurrences(c, ["conv_id"], ["turn", rank_of(F.col("role"), ["user", "assistant"]), F.md5("text")], "place").select("conv_id", "turn", "place")


@query("srt_caps", oracle("SELECT from_id, to_id, type FROM v_edge QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY type, to_id) <= 3"))
def srt_caps(spark, sf):
    return o.top_per_group(view(spark, sf, "v_edge"), ["from_id"], [F.col("type"), F.col("to_id")], 3)


@query("set_terms", oracle("SELECT DISTINCT term FROM t", ("t", TERMS)))
def set_terms(spark, sf):
    return over(spark, sf, TERMS, "part").distinct()


@query("set_except", oracle("(SELECT 'missing' AS side, c_nationkey::BIGINT AS k FROM customer EXCEPT SELECT 'missing', s_suppkey FROM supplier) UNION ALL (SELECT 'unexpected', s_suppkey FROM supplier EXCEPT SELECT 'unexpected', c_nationkey FROM customer)"))
def set_except(spark, sf):
    want = view(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("k")).distinct()
    got = view(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).distinct()
    return want.join(got, "k", "left_anti").select(F.lit("missing").alias("side"), "k").unionByName(got.join(want, "k", "left_anti").select(F.lit("unexpected").alias("side"), "k"))


@query("set_union_items", oracle("SELECT 'INSIGHT' AS item_type, insight_id AS item_id FROM v_insight UNION ALL SELECT 'LINK', link_id FROM v_link"))
def set_union_items(spark, sf):
    return o.merged([view(spark, sf, f"v_{n.lower()}").select(F.lit(n).alias("item_type"), F.col(f"{n.lower()}_id").alias("item_id")) for n in ("INSIGHT", "LINK")])


@query("set_cellgap", oracle("SELECT a.c, b.t FROM (SELECT DISTINCT l_suppkey % 30 AS c FROM v_line) a, (SELECT DISTINCT l_partkey % 50 AS t FROM v_line) b WHERE NOT EXISTS (FROM v_line WHERE l_suppkey % 30 = a.c AND l_partkey % 50 = b.t AND qty = 1 AND pct < 5)"))
def set_cellgap(spark, sf):
    """Conditions and tasks that were never observed together; both lists are short by definition (30 and 50)."""
    lines = view(spark, sf, "v_line").select((F.col("l_suppkey") % 30).alias("c"), (F.col("l_partkey") % 50).alias("t"), "qty", "pct")
    seen = lines.where("qty = 1 AND pct < 5").select("c", "t").distinct()
    return lines.select("c").distinct().crossJoin(F.broadcast(lines.select("t").distinct())).join(seen, ["c", "t"], "left_anti")
