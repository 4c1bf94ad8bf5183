"""Queries over graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import label
from ..operators import graph as g
from ..operators import projections as p
from ..operators.ordering import top_per_group
from ..registry import query
from ..sources import extract as x
from .joins import over
from .views import oracle, view

_SEEDS = "SELECT p_partkey AS id, p_size AS score FROM part WHERE p_size = 7"


def seeds(spark, sf):
    return over(spark, sf, _SEEDS, "part")


@query("gr_hop1", oracle("SELECT id FROM s UNION SELECT to_id FROM v_edge WHERE from_id IN (SELECT id FROM s) UNION SELECT from_id FROM v_edge WHERE to_id IN (SELECT id FROM s)", ("s", _SEEDS)))
def gr_hop1(spark, sf):
    return g.hop1(view(spark, sf, "v_edge"), seeds(spark, sf))


@query(
    "gr_hop2score",
    oracle(
        """SELECT s.id, (score + 2 * (SELECT count(*) FROM v_edge WHERE to_id = s.id AND from_id IN (SELECT id FROM s)))::BIGINT AS score FROM s UNION ALL SELECT id, score FROM f
UNION ALL SELECT DISTINCT to_id, 4 FROM v_edge WHERE from_id IN (SELECT id FROM f) AND to_id NOT IN (SELECT id FROM s) AND to_id NOT IN (SELECT id FROM f)""",
        ("s", _SEEDS),
        ("f", "SELECT id, max(score) AS score FROM (SELECT to_id AS id, 8 AS score FROM v_edge WHERE from_id IN (SELECT id FROM s) UNION ALL SELECT from_id, 5 FROM v_edge WHERE type = 'TESTS' AND to_id IN (SELECT id FROM s)) x WHERE id NOT IN (SELECT id FROM s) GROUP BY id"),
    ),
)
def gr_hop2score(spark, sf):
    return g.hop2_scores(view(spark, sf, "v_edge"), seeds(spark, sf))


_UP = "SELECT id AS target, id, 0 AS depth FROM s UNION SELECT u.target, e.from_id, u.depth + 1 FROM up u JOIN v_edge e ON e.to_id = u.id AND e.type = 'CALLS' WHERE u.depth < 4"


@query("gr_upstream", oracle("SELECT target, id, min(depth) AS depth FROM up GROUP BY target, id", ("s", _SEEDS), ("up", _UP)))
def gr_upstream(spark, sf):
    return g.upstream(view(spark, sf, "v_edge"), seeds(spark, sf))


@query("gr_incoming", oracle("SELECT id, min(depth) AS depth FROM up GROUP BY id ORDER BY depth, id LIMIT 80", ("s", _SEEDS), ("up", _UP)))
def gr_incoming(spark, sf):
    return g.closure(view(spark, sf, "v_edge").where("type = 'CALLS'"), seeds(spark, sf), 4, 80)


_TRAILS = "SELECT id AS target, id, [id] AS trail FROM s UNION ALL SELECT t.target, e.from_id, list_append(t.trail, e.from_id) FROM tr t JOIN v_edge e ON e.to_id = t.id AND e.type = 'CALLS' WHERE len(t.trail) <= 4 AND NOT list_contains(t.trail, e.from_id)"
_PATHS = """SELECT target, test, n_edges, list_reverse(trail) AS path FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n_edges, trail) AS r FROM
 (SELECT target, test, min(n_edges) AS n_edges, arg_min(trail, (n_edges, trail)) AS trail FROM (SELECT b.target, e.from_id AS test, len(b.trail) AS n_edges, list_append(b.trail, e.from_id) AS trail FROM
  (SELECT target, id, arg_min(trail, (len(trail), trail)) AS trail FROM tr GROUP BY target, id) b JOIN v_edge e ON e.to_id = b.id AND e.type = 'TESTS') x GROUP BY target, test) y) z WHERE r <= 3"""


@query("gr_rev_bfs", oracle("SELECT target, test, n_edges::INT AS n_edges, path FROM ps", ("s", _SEEDS), ("tr", _TRAILS), ("ps", _PATHS)))
def gr_rev_bfs(spark, sf):
    return g.test_paths(view(spark, sf, "v_edge"), seeds(spark, sf))


@query("win_bestpath", oracle("SELECT target, test, n_edges::INT AS n_edges FROM ps QUALIFY row_number() OVER (PARTITION BY test ORDER BY n_edges, target) = 1", ("s", _SEEDS), ("tr", _TRAILS), ("ps", _PATHS)))
def win_bestpath(spark, sf):
    paths = g.test_paths(view(spark, sf, "v_edge"), seeds(spark, sf))
    return top_per_group(paths, ["test"], [F.col("n_edges"), F.col("target")], 1).select("target", "test", "n_edges")


_TARGETS = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'API_ROUTE' WHEN 1 THEN 'SERVICE' ELSE 'ENTITY' END AS node_type FROM part WHERE p_size = 7"


@query(
    "gr_qacov",
    oracle(
        """SELECT id, node_type, CASE WHEN n = 1 THEN 'COVERED' WHEN n > 1 THEN 'INDIRECT_ONLY' ELSE 'NO_TEST_FOUND' END AS status, CASE node_type WHEN 'API_ROUTE' THEN 'HIGH' WHEN 'SERVICE' THEN 'MEDIUM' ELSE 'LOW' END AS severity, coalesce(c, 0) AS traces
FROM t LEFT JOIN (SELECT target, min(n_edges) AS n, count(*) AS c FROM ps GROUP BY target) x ON target = id""",
        ("s", _SEEDS), ("tr", _TRAILS), ("ps", _PATHS), ("t", _TARGETS),
    ),
)
def gr_qacov(spark, sf):
    return g.qa_coverage(over(spark, sf, _TARGETS, "part"), g.test_paths(view(spark, sf, "v_edge"), seeds(spark, sf)))


_WALK = "SELECT p_partkey AS start, p_partkey AS id, [p_partkey] AS path FROM part UNION ALL SELECT w.start, e.to_id, list_append(w.path, e.to_id) FROM w JOIN v_edge e ON e.from_id = w.id AND e.type = 'CALLS' WHERE len(w.path) <= 4 AND w.id <> 0 AND NOT list_contains(w.path, e.to_id)"


@query("gr_dfs", oracle("SELECT start, min(path) AS path FROM w WHERE id = 0 GROUP BY start", ("w", _WALK)))
def gr_dfs(spark, sf):
    return g.first_path(view(spark, sf, "v_edge"), view(spark, sf, "part").select(F.col("p_partkey").alias("id")), 0)


_NODES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 100 = 50 THEN o_orderkey + 4 ELSE o_orderkey - 1 END AS parent FROM orders"
_CHAIN = "SELECT id AS start, id, [id] AS chain, false AS cycle FROM n UNION ALL SELECT c.start, n.parent, list_append(c.chain, n.parent), list_contains(c.chain, n.parent) FROM ch c JOIN n ON n.id = c.id WHERE NOT c.cycle AND n.parent IS NOT NULL"


@query("gr_lineage", oracle("SELECT start, id, (len(chain) - 1)::INT AS steps, cycle FROM ch", ("n", _NODES), ("ch", _CHAIN)))
def gr_lineage(spark, sf):
    n = over(spark, sf, _NODES, "orders")
    return g.lineage(n, n.select("id"))


_SHOWN = "SELECT artifact_id AS id, name, universal_kind FROM v_artifact QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY universal_kind, artifact_id) <= 20"


@query("gr_mermaid", oracle("SELECT from_id, to_id, type FROM v_aedge WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)", ("n", _SHOWN)))
def gr_mermaid(spark, sf):
    """The edges of a diagram: those between the first twenty artifacts of each snapshot."""
    nodes = top_per_group(view(spark, sf, "v_artifact"), ["snapshot_id"], [F.col("universal_kind"), F.col("artifact_id")], 20)
    return g.induced(view(spark, sf, "v_aedge"), nodes.select(F.col("artifact_id").alias("id")))


_IMPACT = (
    ("sc", "SELECT analysis_id, link_id, artifact_id, link_id * 7919 % 101 AS score FROM v_link"),
    ("im_a", "SELECT analysis_id, artifact_id FROM (SELECT analysis_id, artifact_id, row_number() OVER (PARTITION BY analysis_id ORDER BY s DESC, l) AS r FROM (SELECT analysis_id, artifact_id, max(score) AS s, arg_max(link_id, (score, -link_id)) AS l FROM sc GROUP BY ALL) x) y WHERE r <= 48"),
    ("im_n", "SELECT v.analysis_id, count(a.artifact_id) AS n_a FROM v_analysis v LEFT JOIN im_a a USING (analysis_id) GROUP BY v.analysis_id"),
    ("im_d", "SELECT y.*, n_a FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY from_id, to_id, type) AS r FROM (SELECT analysis_id, e.* FROM im_a JOIN v_edge e ON from_id = artifact_id UNION SELECT analysis_id, e.* FROM im_a JOIN v_edge e ON to_id = artifact_id) x) y JOIN im_n USING (analysis_id) WHERE r <= 79 - n_a"),
    ("im_f", """SELECT analysis_id, id FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY o) AS k FROM (SELECT analysis_id, n_a, id, min(o) AS o FROM (SELECT analysis_id, n_a, from_id AS id, 2 * r AS o FROM im_d UNION ALL SELECT analysis_id, n_a, to_id, 2 * r + 1 FROM im_d) x
 ANTI JOIN im_a a ON a.analysis_id = x.analysis_id AND a.artifact_id = x.id GROUP BY ALL) y) z WHERE k <= 48 - n_a"""),
    ("im_c", "SELECT n.*, coalesce(d, 0) AS n_d, coalesce(f, 0) AS n_f FROM im_n n LEFT JOIN (SELECT analysis_id, count(*) AS d FROM im_d GROUP BY ALL) x USING (analysis_id) LEFT JOIN (SELECT analysis_id, count(*) AS f FROM im_f GROUP BY ALL) y USING (analysis_id)"),
    ("im_i", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY CASE review_status WHEN 'CONFIRMED' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END, insight_id) AS k FROM v_insight) x JOIN im_c USING (analysis_id) WHERE k <= 48 - n_a - n_f"),
    ("im_p", "SELECT i.insight_id, arg_min(e.artifact_id, e.evidence_id) AS shown FROM im_i i JOIN v_insight_evidence b USING (insight_id) JOIN v_evidence e USING (evidence_id) JOIN (SELECT * FROM im_a UNION SELECT * FROM im_f) s ON s.analysis_id = i.analysis_id AND s.artifact_id = e.artifact_id GROUP BY i.insight_id"),
)


_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


def impact(spark, sf):
    # Lines are shuffled once, as lists of an order, which is an analysis: the views that read them, and what is then grouped by analysis, share that.
    # No view here tells when a line was shipped.
    lists = view(spark, sf, "lineitem").where("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(F.collect_list(F.struct(*_LINE)).alias("lines"))
    lines = {"lineitem": lists.select("l_orderkey", F.inline("lines")).withColumn("l_shipdate", F.lit(None).cast("date"))}
    analyses = view(spark, sf, "v_analysis").select("analysis_id", F.col("run_id").alias("requirement_id"))
    proofs = view(spark, sf, "v_insight_evidence", lines).join(view(spark, sf, "v_evidence", lines).select("evidence_id", "artifact_id"), "evidence_id")
    return g.impact_graph(analyses, over(spark, sf, _IMPACT[0][1], "v_link", given=lines), view(spark, sf, "v_edge"), view(spark, sf, "v_insight", lines), proofs)


@query(
    "gr_impact",
    oracle(
        """SELECT x.*, l + i + 2 > 50 AS truncated FROM (SELECT analysis_id, concat('req-', run_id) AS node, 'REQUIREMENT' AS node_type, 'ROOT' AS source, 0 AS rank FROM v_analysis UNION ALL SELECT analysis_id, concat('analysis-', analysis_id), 'ANALYSIS', 'ROOT', 1 FROM v_analysis
UNION ALL SELECT analysis_id, concat('artifact-', artifact_id), 'ARTIFACT', 'TRACEABILITY', 2 FROM im_a UNION ALL SELECT analysis_id, concat('artifact-', id), 'ARTIFACT', 'DEPENDENCY', 4 FROM im_f
UNION ALL SELECT analysis_id, concat('insight-', insight_id), CASE WHEN insight_type IN ('UNKNOWN', 'QA_SCENARIO') THEN insight_type ELSE 'INSIGHT' END, 'INSIGHT', 3 FROM im_i) x
JOIN (SELECT analysis_id, (SELECT count(*) FROM v_link l WHERE l.analysis_id = v.analysis_id) AS l, (SELECT count(*) FROM v_insight i WHERE i.analysis_id = v.analysis_id) AS i FROM v_analysis v) y USING (analysis_id)""",
        *_IMPACT,
    ),
)
def gr_impact(spark, sf):
    """The nodes of an analysis' graph: its requirement, itself, at most fifty with artifacts, their neighbours and insights."""
    return impact(spark, sf)[0]


@query(
    "gr_impact_edges",
    oracle(
        """SELECT analysis_id, concat('req-', run_id) AS source, concat('analysis-', analysis_id) AS target, 'AFFECTS' AS type, 'ROOT_LINK' AS source_kind FROM v_analysis UNION ALL SELECT analysis_id, concat('analysis-', analysis_id), concat('artifact-', artifact_id), 'AFFECTS', 'TRACEABILITY' FROM im_a
UNION ALL SELECT analysis_id, concat('artifact-', CASE type WHEN 'TESTS' THEN to_id ELSE from_id END), concat('artifact-', CASE type WHEN 'TESTS' THEN from_id ELSE to_id END), type, 'DEPENDENCY' FROM im_d
UNION ALL SELECT analysis_id, CASE WHEN shown IS NULL THEN concat('analysis-', analysis_id) ELSE concat('artifact-', shown) END, concat('insight-', insight_id), CASE insight_type WHEN 'UNKNOWN' THEN 'RAISES_UNKNOWN' WHEN 'QA_SCENARIO' THEN 'SUGGESTS_QA' ELSE 'EVIDENCES' END, 'EVIDENCE_LINK'
 FROM im_i LEFT JOIN im_p USING (insight_id) WHERE k <= 79 - n_a - n_d""",
        *_IMPACT,
    ),
)
def gr_impact_edges(spark, sf):
    """The edges of an analysis' graph, at most eighty."""
    return impact(spark, sf)[1]


@query(
    "gr_comprehend",
    oracle(
        """SELECT s.id, (SELECT count(*) FROM v_edge WHERE from_id = s.id AND type = 'CALLS') AS callees, (SELECT count(*) FROM v_edge WHERE to_id = s.id AND type = 'CALLS') AS callers, coalesce(u.n, 0) AS reached, coalesce(t.n, 0) AS tests
FROM s LEFT JOIN (SELECT target, count(DISTINCT id) - 1 AS n FROM up GROUP BY target) u ON u.target = s.id LEFT JOIN (SELECT target, count(*) AS n FROM ps GROUP BY target) t ON t.target = s.id""",
        ("s", _SEEDS), ("up", _UP), ("tr", _TRAILS), ("ps", _PATHS),
    ),
)
def gr_comprehend(spark, sf):
    """What is around an artifact: direct calls in both directions, callers up to four calls away, tests."""
    edges, s = view(spark, sf, "v_edge"), seeds(spark, sf).select("id")
    calls = edges.where("type = 'CALLS'")
    parts = {
        "callees": calls.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("callees")),
        "callers": calls.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("callers")),
        "reached": g.upstream(edges, s).groupBy(F.col("target").alias("id")).agg((F.count("id") - 1).alias("reached")),
        "tests": g.test_paths(edges, s).groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("tests")),
    }
    out = s
    for part in parts.values():
        out = out.join(part, "id", "left")
    return out.fillna(0)


_REACHED = "SELECT DISTINCT u.target AS id, e.from_id AS test FROM up u JOIN v_edge e ON e.to_id = u.id AND e.type = 'TESTS'"


@query(
    "gr_comprehend_page",
    oracle(
        """SELECT s.id, coalesce(list_sort(c[6:15]), []) AS scenarios, coalesce(k[1:50], []) AS static_calls, coalesce(o[1:50], []) AS dependencies, coalesce(len(c), 0) > 15 AS has_more,
 list_filter([CASE WHEN c IS NULL THEN 'NO_SUPPORTED_TEST_REFERENCE' END, CASE WHEN len(c) = 5000 THEN 'SCENARIO_SOURCE_SCAN_LIMIT' END, CASE WHEN coalesce(len(c), 0) > 15 OR coalesce(len(k), 0) > 50 OR coalesce(len(o), 0) > 50 THEN 'COMPREHENSION_LIMIT' END], lambda x: x IS NOT NULL) AS limitations
FROM s LEFT JOIN (SELECT id, list_sort(list(test))[1:5000] AS c FROM t GROUP BY id) x USING (id) LEFT JOIN (SELECT from_id AS id, list_sort(list(DISTINCT to_id)) AS k FROM v_edge WHERE type = 'CALLS' GROUP BY 1) y USING (id) LEFT JOIN (SELECT from_id AS id, list_sort(list(DISTINCT to_id)) AS o FROM v_edge GROUP BY 1) z USING (id)""",
        ("s", _SEEDS), ("up", _UP), ("t", _REACHED),
    ),
)
def gr_comprehend_page(spark, sf):
    """The second part of a comprehension: ten tests from the sixth on, calls, dependencies, and what was left out."""
    return g.scenario_page(view(spark, sf, "v_edge"), seeds(spark, sf), 10, 5)


_CALLS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages"


@query("gr_refs", oracle("SELECT c.page_id AS from_page, target AS symbol, q.page_id AS to_page FROM (SELECT DISTINCT page_id, target FROM c) c LEFT JOIN (SELECT concat('/', split_part(split_part(html, '<title>', 2), ' ', 1)) AS symbol, min(page_id) AS page_id FROM pages GROUP BY 1) q ON q.symbol = c.target", ("c", _CALLS)))
def gr_refs(spark, sf):
    """Edges from references in text: the referenced symbol is looked up among declared ones; without one it stays unresolved."""
    pages = view(spark, sf, "pages")
    refs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("symbol")).distinct()
    title = F.split_part(F.split_part("html", F.lit("<title>"), F.lit(2)), F.lit(" "), F.lit(1))
    declared = pages.groupBy(F.concat(F.lit("/"), title).alias("symbol")).agg(F.min("page_id").alias("to_page"))
    return refs.join(declared, "symbol", "left").select(F.col("page_id").alias("from_page"), "symbol", "to_page")


#: A page gets the text of its remainder by four; @N@ is its number, @M@ the next one, @K@ the last but one.
_CODE = [
    """@Controller('c')
export class C@N@ {
  constructor(private readonly svc: S@M@, private shared: Shared) {}
  async find(id) {
    return this.svc.load(id);
  }
  drop(id) {
    this.svc.gone(id);
    this.shared.note(id);
    this.nobody.call();
  }
}
""",
    """@Injectable()
export class S@N@ {
  constructor(@InjectRepository(E@M@) private readonly rows: Repository<E@M@>) {}
  async load(id) {
    return this.rows.findOne(id);
  }
  make() {
    return new E@M@();
  }
}
@Injectable()
export class Shared {
  note(x) {
    return x;
  }
}
""",
    """@Entity()
export class E@N@ {
  name: string;
}
""",
    """const s = new S@K@();
it('loads', () => { s.load(1); });
it.skip('later', () => { s.make(); });
test('odd', () => { s.gone(); q.run(); });
it('none', () => { expect(1).toBe(1); });
""",
]
#: What a reader finds in them, if the class that is meant is there (S, E) or not: (text, source, meant, target, type, reason without it, reason with it).
_FOUND = [
    (0, "C@N@#find", "S", "load", "CALLS", "UNRESOLVED_RECEIVER", None),
    (0, "C@N@#drop", "S", "gone", "CALLS", "UNRESOLVED_RECEIVER", "METHOD_ARTIFACT_NOT_EXTRACTED"),
    (1, "S@N@#load", "E", "", "USES", "UNRESOLVED_RECEIVER", None),
    (1, "S@N@#make", "E", "", "USES", "", None),
    (3, "p/@N@#loads", "T", "load", "TESTS", "UNRESOLVED_RECEIVER", None),
    (3, "p/@N@#odd", "T", "gone", "TESTS", "UNRESOLVED_RECEIVER", "METHOD_ARTIFACT_NOT_EXTRACTED"),
]
_FOUND_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in _FOUND) + ") v(m, source, meant, method, type, missing, with_it)"


@query(
    "gr_build",
    oracle(
        f"""SELECT replace(source, '@N@', page_id::VARCHAR) AS source, CASE WHEN NOT there THEN CASE meant WHEN 'E' THEN 'rows.findOne' WHEN 'T' THEN concat('s.', method) ELSE concat('svc.', method) END
 WHEN meant = 'E' THEN concat('E', page_id + 1) WHEN with_it IS NOT NULL THEN concat(CASE meant WHEN 'T' THEN 's.' ELSE 'svc.' END, method) ELSE concat('S', page_id + CASE meant WHEN 'T' THEN -2 ELSE 1 END, '#', method) END AS target,
 CASE WHEN NOT there AND meant = 'E' THEN 'CALLS' ELSE type END AS type, CASE WHEN there THEN with_it ELSE missing END AS reason
FROM (SELECT *, page_id + CASE meant WHEN 'T' THEN -2 ELSE 1 END IN (SELECT page_id FROM pages) AS there FROM pages JOIN {_FOUND_SQL} ON m = page_id % 4) x WHERE there OR missing <> ''
UNION ALL SELECT concat('C', page_id, '#drop'), 'nobody.call', 'CALLS', 'UNRESOLVED_RECEIVER' FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT concat('C', page_id, '#drop'), 'shared.note', 'CALLS', 'AMBIGUOUS_SYMBOL' FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT concat('p/', page_id, '#odd'), 'q.run', 'TESTS', 'UNRESOLVED_RECEIVER' FROM pages WHERE page_id % 4 = 3 UNION ALL SELECT concat('p/', page_id, '#none'), NULL, 'TESTS', 'NO_SUPPORTED_DIRECT_REFERENCE' FROM pages WHERE page_id % 4 = 3"""
    ),
)
def gr_build(spark, sf):
    """Edges of source files: calls through injected fields, entities in use, tests of methods; the rest with its reason."""
    content = F.get(F.array(*[F.lit(t) for t in _CODE]), (F.col("page_id") % 4).cast("int"))
    for mark, n in (("@N@", 0), ("@M@", 1), ("@K@", -2)):
        content = F.replace(content, F.lit(mark), (F.col("page_id") + n).cast("string"))
    return x.code_edges(view(spark, sf, "pages").select(F.concat(F.lit("p/"), "page_id").alias("path"), content.alias("content")))


_IMPORTS = "SELECT l_partkey % 60 AS module, l_suppkey % 25 AS symbol, l_orderkey % 90 AS provider FROM v_line WHERE l_linenumber = 1"


@query("gr_receiver", oracle("SELECT e.from_id, e.to_id AS symbol, CASE WHEN n = 1 THEN provider END AS provider, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS outcome FROM (SELECT DISTINCT from_id, to_id % 40 AS to_id FROM v_edge) e LEFT JOIN (SELECT module, symbol, count(DISTINCT provider) AS n, min(provider) AS provider FROM i GROUP BY module, symbol) x ON x.module = e.from_id % 60 AND x.symbol = e.to_id", ("i", _IMPORTS)))
def gr_receiver(spark, sf):
    """Receivers of calls through what their module exports; more than one provider is ambiguous."""
    i = over(spark, sf, _IMPORTS, "v_line").groupBy("module", "symbol").agg(F.countDistinct("provider").alias("n"), F.min("provider").alias("provider"))
    e = view(spark, sf, "v_edge").select("from_id", (F.col("to_id") % 40).alias("symbol")).distinct().withColumn("module", F.col("from_id") % 60)
    outcome = F.when(F.col("n").isNull(), "UNRESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return e.join(i, ["module", "symbol"], "left").select("from_id", "symbol", F.when(F.col("n") == 1, F.col("provider")).alias("provider"), outcome.alias("outcome"))


# Modules by remainders of parts, tokens by suppliers; every line declares, imports, exports or asks.
_PROVIDES = "SELECT l_partkey % 60 AS module, concat('T', l_suppkey % 25) AS token, CASE l_orderkey % 5 WHEN 0 THEN 'EXISTING' WHEN 1 THEN 'FACTORY' ELSE 'CLASS' END AS kind, CASE l_orderkey % 5 WHEN 0 THEN concat('T', l_orderkey % 25) ELSE concat('C', l_orderkey % 90) END AS target FROM v_line WHERE l_linenumber = 1 AND l_orderkey % 9 = 0"
_BROUGHT = "SELECT l_partkey % 60 AS module, l_suppkey % 60 AS imported FROM v_line WHERE l_linenumber = 2 AND l_orderkey % 20 = 0"
_GIVEN = "SELECT l_partkey % 60 AS module, concat('T', l_suppkey % 25) AS token FROM v_line WHERE l_linenumber = 3"
_ASKED = "SELECT l_partkey % 60 AS module, concat('T', l_orderkey % 25) AS token FROM v_line WHERE l_linenumber = 4"
_FOLLOWED = "SELECT DISTINCT module, token, kind, target, 0 AS hop FROM pr UNION SELECT f.module, f.token, coalesce(p.kind, 'MISSING'), p.target, f.hop + 1 FROM fo f LEFT JOIN pr p ON p.module = f.module AND p.token = f.target WHERE f.kind = 'EXISTING' AND f.hop < 3"
_ENDS = "SELECT module, token, CASE kind WHEN 'EXISTING' THEN 'TOO_DEEP' ELSE kind END AS kind, target FROM fo WHERE kind <> 'EXISTING' OR hop = 3"


@query(
    "gr_receiver_modules",
    oracle(
        """SELECT module, token, CASE WHEN NOT f AND NOT d AND n = 1 THEN target END AS provider, CASE WHEN f IS NULL THEN 'UNRESOLVED' WHEN f THEN 'UNSUPPORTED_FACTORY' WHEN d THEN 'UNRESOLVED_ALIAS' WHEN n = 0 THEN 'UNRESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS outcome
FROM (SELECT a.module, a.token, bool_or(kind = 'FACTORY') AS f, bool_or(kind = 'TOO_DEEP') AS d, count(DISTINCT target) AS n, min(target) AS target FROM (SELECT DISTINCT * FROM ak) a LEFT JOIN (SELECT module, token, kind, target FROM en
UNION SELECT i.module, e.token, e.kind, e.target FROM br i JOIN gv x ON x.module = i.imported JOIN en e ON e.module = x.module AND e.token = x.token WHERE (i.module, e.token) NOT IN (SELECT (module, token) FROM en)) v USING (module, token) GROUP BY a.module, a.token) y""",
        ("pr", _PROVIDES), ("br", _BROUGHT), ("gv", _GIVEN), ("ak", _ASKED), ("fo", _FOLLOWED), ("en", _ENDS),
    ),
)
def gr_receiver_modules(spark, sf):
    """The class behind a token through own providers, aliases, imports and exports of modules."""
    return g.resolve_tokens(*[over(spark, sf, text, "v_line") for text in (_ASKED, _PROVIDES, _BROUGHT, _GIVEN)])


@query("gr_label", oracle("SELECT artifact_id, CASE WHEN length(x) > 60 THEN x[1:57] || '...' ELSE x END AS label FROM (SELECT artifact_id, regexp_replace(replace(name, '\"', ''''), '[\\r\\n]+', ' ', 'g') AS x FROM v_artifact) y"))
def gr_label(spark, sf):
    return view(spark, sf, "v_artifact").select("artifact_id", label(F.col("name")).alias("label"))


@query("gr_nodes_qa", oracle("SELECT artifact_id FROM v_artifact WHERE artifact_type NOT IN ('TEST', 'JEST_TEST_CASE') AND NOT (artifact_type = 'SERVICE' AND universal_kind = 'UNKNOWN')"))
def gr_nodes_qa(spark, sf):
    """Artifacts that coverage is asked of: code with a node type of its own."""
    t = p.node_type(F.col("artifact_type"), F.col("universal_kind"), None)
    return view(spark, sf, "v_artifact").where(t.isNotNull() & (t != "TEST")).select("artifact_id")
