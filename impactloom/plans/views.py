"""Views that give the driver tables the shape of impact-analysis relations.

A view is SQL that Spark and DuckDB both read, over driver tables and other views.  Queries read it as
a DataFrame, and its text goes in front of their DuckDB SQL.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

_KIND = """CASE WHEN {t} IN ('API_ROUTE', 'SPRING_CONTROLLER_METHOD') THEN 'API_ENDPOINT' WHEN {t} IN ('SERVICE_METHOD', 'SPRING_SERVICE_METHOD') THEN 'DOMAIN_SERVICE'
 WHEN {t} = 'ENTITY' THEN 'DATA_MODEL' WHEN {t} = 'TEST' THEN 'TEST_FILE' WHEN {t} = 'JEST_TEST_CASE' THEN 'TEST_CASE' ELSE 'UNKNOWN' END"""

VIEWS = {
    # code artifacts: one per document; a snapshot is a source
    "v_artifact0": """SELECT doc_id AS artifact_id, source AS snapshot_id, concat(lang, ':', doc_id) AS artifact_key,
 CASE doc_id % 9 WHEN 0 THEN 'API_ROUTE' WHEN 1 THEN 'SERVICE_METHOD' WHEN 2 THEN 'ENTITY' WHEN 3 THEN 'TEST' WHEN 4 THEN 'JEST_TEST_CASE'
  WHEN 5 THEN 'SPRING_CONTROLLER_METHOD' WHEN 6 THEN 'SPRING_SERVICE_METHOD' WHEN 7 THEN 'CONTROLLER' ELSE 'SERVICE' END AS artifact_type,
 concat(lang, '_', split_part(text, ' ', 1)) AS name,
 concat(source, '/', CASE doc_id % 7 WHEN 0 THEN 'audit' WHEN 1 THEN 'spec' WHEN 2 THEN 'discount' ELSE 'core' END, '/', doc_id % 40, '.ts') AS file_path,
 CASE WHEN doc_id % 11 = 0 THEN NULL ELSE md5(text) END AS content_hash,
 CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id % 100 END AS start_line, doc_id % 100 + n_chars % 50 AS end_line, text AS excerpt, n_chars
FROM documents""",
    "v_artifact": f"SELECT *, {_KIND.format(t='artifact_type')} AS universal_kind FROM v_artifact0",
    "v_base": "SELECT * FROM v_artifact WHERE artifact_id % 10 <> 9",
    "v_target": """SELECT artifact_id, snapshot_id, artifact_key, artifact_type, name, file_path,
 CASE WHEN artifact_id % 7 = 0 AND content_hash IS NOT NULL THEN md5(concat(excerpt, 'x')) ELSE content_hash END AS content_hash,
 start_line, end_line, excerpt, n_chars, universal_kind FROM v_artifact WHERE artifact_id % 10 <> 0""",
    # a dependency graph over parts
    "v_edge": """SELECT DISTINCT l_partkey AS from_id, l_orderkey % (SELECT count(*) FROM part) AS to_id,
 CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'R' THEN 'TESTS' ELSE 'REFERENCES' END AS type
FROM lineitem WHERE l_linenumber = 1 AND l_partkey <> l_orderkey % (SELECT count(*) FROM part)""",
    # the same over artifacts
    "v_aedge": """SELECT DISTINCT from_id, to_id, type FROM (
 SELECT l_partkey % (SELECT count(*) FROM documents) AS from_id, l_orderkey % (SELECT count(*) FROM documents) AS to_id,
  CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'R' THEN 'TESTS' ELSE 'REFERENCES' END AS type
 FROM lineitem WHERE l_linenumber = 1 AND l_quantity <= 10) e WHERE from_id <> to_id""",
    "v_chunk": "SELECT vec_id AS chunk_id, vec_id AS artifact_id, label AS snapshot_id, embedding FROM embeddings",
    # one row per order line
    "v_line": """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, CAST(min(l_quantity) AS INT) AS qty,
 CAST(round(min(l_discount) * 100) AS INT) AS pct, min(l_returnflag) AS flag, min(l_linestatus) AS line_status, min(l_shipdate) AS shipped,
 l_orderkey * 10 + l_linenumber AS line_id
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_analysis": """SELECT o_orderkey AS analysis_id, o_custkey AS run_id, o_custkey % 40 AS project_id, o_orderkey % 20 AS repository_id,
 CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'WAITING_FOR_REVIEW' WHEN o_orderkey % 3 = 0 THEN 'FAILED' WHEN o_orderkey % 3 = 1 THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
 CASE WHEN o_orderkey % 4 = 0 THEN 'COMMIT' ELSE 'BRANCH' END AS ref_type, concat('c', o_orderkey % 5) AS commit_sha,
 concat('c', o_orderkey % 5 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS latest_sha, o_orderdate AS created_at, o_orderkey % 12 AS snapshot_id,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'booking' WHEN '2-HIGH' THEN 'inventory' ELSE 'UNKNOWN' END AS domain
FROM orders""",
    "v_decision": """SELECT line_id AS decision_id, l_orderkey AS analysis_id, shipped AS decided_at,
 CASE flag WHEN 'A' THEN 'ACCEPTED' WHEN 'R' THEN CASE WHEN pct > 5 THEN 'REJECTED' ELSE 'ACCEPTED' END ELSE 'NEEDS_MORE_CLARIFICATION' END AS decision
FROM v_line WHERE l_linenumber IN (2, 5)""",
    "v_link": """SELECT line_id AS link_id, l_orderkey AS analysis_id, l_partkey AS artifact_id, CASE WHEN l_linenumber = 7 THEN 'RELATED' ELSE 'AFFECTED' END AS link_type,
 CASE WHEN flag = 'N' THEN 'INFERRED' ELSE 'EVIDENCED' END AS link_basis,
 CASE WHEN line_status = 'O' AND pct > 3 THEN 'NEEDS_REVIEW' WHEN flag = 'R' THEN 'REJECTED' ELSE 'CONFIRMED' END AS review_status,
 CASE qty % 7 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'NEEDS_MORE_EVIDENCE' WHEN 3 THEN 'POSTPONED' ELSE NULL END AS decision,
 CASE l_partkey % 8 WHEN 0 THEN 'API_ENDPOINT' WHEN 1 THEN 'DOMAIN_SERVICE' WHEN 2 THEN 'DATA_MODEL' WHEN 3 THEN 'TEST_CASE' WHEN 4 THEN 'TEST_FILE' WHEN 5 THEN 'OTHER' ELSE 'UNKNOWN' END AS universal_kind
FROM v_line WHERE l_linenumber <> 4""",
    "v_insight": """SELECT line_id AS insight_id, l_orderkey AS analysis_id,
 CASE qty % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'QA_SCENARIO' WHEN 2 THEN 'ACCEPTANCE_CRITERIA' ELSE 'CLAIM' END AS insight_type,
 CASE pct % 4 WHEN 0 THEN 'EVIDENCED' WHEN 1 THEN 'INFERRED' WHEN 2 THEN 'UNKNOWN' ELSE 'CONFLICTING' END AS certainty,
 CASE WHEN line_status = 'O' AND qty > 20 THEN 'NEEDS_REVIEW' WHEN flag = 'R' THEN 'REJECTED' ELSE 'CONFIRMED' END AS review_status,
 CASE WHEN l_partkey % 9 = 0 THEN '{"kind":"Risk","severity":"low"}' WHEN l_partkey % 9 = 1 THEN '{"kind":"note"}' WHEN l_partkey % 9 = 2 THEN '[1]' ELSE NULL END AS metadata,
 concat('statement ', l_partkey % 50) AS statement, concat('key-', l_suppkey % 30) AS insight_key
FROM v_line WHERE l_linenumber IN (1, 3, 4, 6)""",
    # insights and links with their evidence: lines of one analysis that share a supplier's remainder share evidence
    "v_insight_evidence": "SELECT line_id AS insight_id, l_orderkey * 10 + l_suppkey % 4 AS evidence_id FROM v_line WHERE l_linenumber IN (1, 3, 4, 6) AND qty % 6 <> 0",
    "v_link_evidence": "SELECT line_id AS link_id, l_orderkey * 10 + l_suppkey % 4 AS evidence_id FROM v_line WHERE l_linenumber <> 4 AND pct % 3 <> 0",
    "v_evidence": """SELECT l_orderkey * 10 + l_suppkey % 4 AS evidence_id, min(l_orderkey) AS analysis_id, min(CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_partkey END) AS artifact_id,
 min(CASE qty % 4 WHEN 0 THEN 'DOMAIN_HINT' WHEN 1 THEN 'TEST' ELSE 'CODE' END) AS source_type, min(CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat('src/', l_partkey % 9, '.ts') END) AS source_path,
 min(CASE WHEN qty % 9 = 0 THEN NULL ELSE qty END) AS start_line, max(qty + 5) AS end_line, min(concat('line ', l_partkey, ' calls ', l_suppkey)) AS excerpt
FROM v_line GROUP BY l_orderkey * 10 + l_suppkey % 4""",
    "v_diagnostic": """SELECT event_id, CASE event_type WHEN 'error' THEN 'ROUTE_UNSUPPORTED' WHEN 'click' THEN 'FILE_LIMIT_EXCEEDED' WHEN 'view' THEN 'DI_BOUNDARY' WHEN 'purchase' THEN 'SCANNER_CAPABILITY_SUMMARY' ELSE 'PARSE_NOTE' END AS code,
 CASE user_id % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'ERROR' ELSE 'WARN' END AS severity, CASE user_id % 5 WHEN 0 THEN 'LIMIT' WHEN 1 THEN 'SECURITY' ELSE 'ROUTE' END AS category,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('orders', event_id % 4, 'Controller') END AS term, concat('src/', user_id % 11, '.ts') AS path, event_id % 3 + 1 AS n
FROM events""",
    "v_event": """SELECT event_id, ts, user_id, event_type, value, props, concat(user_id, ':', event_type, ':', extract(DAY FROM ts)) AS idempotency_key FROM events""",
    "v_request": "SELECT item_id AS request_id, text FROM benchmark",
}
_NAMED = re.compile(r"\b(FROM|JOIN) (\w+)")


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view or driver table as a DataFrame; tables that are ``given`` by name are not read."""
    if given and name in given:
        return given[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    known = {n for _, n in _NAMED.findall(text) if n in TABLES or n in VIEWS}
    text = _NAMED.sub(lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in known else m[0], text)
    return spark.sql(text, **{n: view(spark, sf_dir, n, given) for n in known})


def reader(spark: SparkSession, sf_dir: str):
    return partial(view, spark, sf_dir)


def oracle(sql: str, *more: tuple[str, str]) -> str:
    """DuckDB SQL with the views that it names in front, then ``more`` named subqueries."""
    found: list[str] = []

    def need(text: str) -> None:
        for _, n in _NAMED.findall(text):
            if n in VIEWS and n not in found:
                need(VIEWS[n])
                found.append(n)

    for _, text in more:
        need(text)
    need(sql)
    parts = [(n, VIEWS[n]) for n in found] + list(more)
    head = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in parts) + "\n" if parts else ""
    return head + sql.strip()
