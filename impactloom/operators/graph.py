"""Graph operators over an edge table (from_id, to_id, type): neighbourhoods, paths, closures, lineage.

Depths are bounded by parameters, but for lineage, which goes on until no chain does.  Loops write each round, so that
neither plans nor work grow with the rounds before; frontiers stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import merged, top_per_group
from .rounds import cut


def hop1(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): the seeds and their neighbours in either direction."""
    s = seeds.select("id").distinct()
    out = edges.join(s.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id"))
    back = edges.join(s.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id"))
    return s.unionByName(out).unionByName(back).distinct()


def hop2_scores(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, score) from seeds (id, score).

    Defined without an order of visits: a seed gains 2 per edge from a seed that reaches it; others get 8 if a
    seed points at them, else 5 if they test a seed, else 4 if one of these points at them.
    """
    s = seeds.select("id", "score")
    ids = s.select(F.col("id").alias("from_id"))
    out = edges.join(ids, "from_id", "left_semi")
    gain = out.groupBy(F.col("to_id").alias("id")).agg((2 * F.count(F.lit(1))).alias("gain"))
    own = s.join(gain, "id", "left").select("id", (F.col("score") + F.coalesce("gain", F.lit(0))).alias("score"))
    called = out.select(F.col("to_id").alias("id")).withColumn("score", F.lit(8))
    tests = edges.where("type = 'TESTS'").join(s.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id")).withColumn("score", F.lit(5))
    first = called.unionByName(tests).join(s.select("id"), "id", "left_anti").groupBy("id").agg(F.max("score").alias("score"))
    second = edges.join(first.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    second = second.join(s.select("id"), "id", "left_anti").join(first.select("id"), "id", "left_anti").withColumn("score", F.lit(4))
    return own.unionByName(first).unionByName(second)


def upstream(edges: DataFrame, targets: DataFrame, depth: int = 4, types: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """(target, id, depth): what reaches each target over at most ``depth`` edges, at its least depth."""
    back = cut(edges.where(F.col("type").isin(*types)).select("from_id", F.col("to_id").alias("id")).distinct())
    seen = targets.select(F.col("id").alias("target"), "id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(back, "id").select("target", F.col("from_id").alias("id")).distinct()
        front = cut(step.join(seen.select("target", "id"), ["target", "id"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def closure(edges: DataFrame, start: DataFrame, depth: int, cap: int) -> DataFrame:
    """(id, depth) of the callers of all starts together, the nearest ``cap`` of them."""
    one = start.select("id").distinct()
    back = cut(edges.select("from_id", F.col("to_id").alias("id")).distinct())
    seen = front = one.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = cut(front.join(back, "id").select(F.col("from_id").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "id").limit(cap)


def test_paths(edges: DataFrame, targets: DataFrame, depth: int = 4, most: int = 3) -> DataFrame:
    """(target, test, n_edges, path): per target the ``most`` nearest tests, each by one shortest path.

    A path lists node identifiers from the test to the target.  Of paths of one length that with the least list of
    identifiers, read from the target, stays.
    """
    calls = cut(edges.where("type = 'CALLS'").select("from_id", F.col("to_id").alias("id")).distinct())
    tests = edges.where("type = 'TESTS'").select(F.col("from_id").alias("test"), F.col("to_id").alias("id")).distinct()
    best = Window.partitionBy("target", "id").orderBy("trail")
    seen = front = targets.select(F.col("id").alias("target"), "id", F.array("id").alias("trail")).distinct()
    for _ in range(depth):
        step = front.join(calls, "id").select("target", F.col("from_id").alias("id"), F.array_append("trail", F.col("from_id")).alias("trail"))
        step = step.join(seen.select("target", "id"), ["target", "id"], "left_anti")
        front = cut(step.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r"))
        seen = seen.unionByName(front)
    found = seen.join(tests, "id").select("target", "test", F.size("trail").alias("n_edges"), F.array_append("trail", F.col("test")).alias("trail"))
    one = found.groupBy("target", "test").agg(F.min(F.struct("n_edges", "trail")).alias("p")).select("target", "test", "p.*")
    near = one.withColumn("__r", F.row_number().over(Window.partitionBy("target").orderBy("n_edges", "trail"))).where(F.col("__r") <= most)
    return near.select("target", "test", "n_edges", F.reverse("trail").alias("path"))


def qa_coverage(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """Targets (id, node_type) with how they are tested and how grave a gap is."""
    found = paths.groupBy(F.col("target").alias("id")).agg(F.min("n_edges").alias("nearest"), F.count(F.lit(1)).alias("traces"))
    status = F.when(F.col("nearest") == 1, "COVERED").when(F.col("nearest") > 1, "INDIRECT_ONLY").otherwise("NO_TEST_FOUND")
    severity = F.when(F.col("node_type").isin("API_ROUTE", "SERVICE_METHOD"), "HIGH").when(F.col("node_type") == "SERVICE", "MEDIUM").otherwise("LOW")
    return targets.join(found, "id", "left").select("id", "node_type", status.alias("status"), severity.alias("severity"), F.coalesce("traces", F.lit(0)).alias("traces"))


def first_path(edges: DataFrame, starts: DataFrame, goal: int, depth: int = 4) -> DataFrame:
    """(start, path): the path that a depth-first search by target identifier meets first; not always a shortest one."""
    out = cut(edges.where("type = 'CALLS'").select(F.col("from_id").alias("id"), "to_id").distinct())
    # How many edges a node is from the goal: paths go on only through nodes that can still reach it.
    left = step = starts.sparkSession.createDataFrame([(goal, 0)], ["to_id", "left"])
    for d in range(1, depth + 1):
        step = out.join(step.select("to_id"), "to_id", "left_semi").select(F.col("id").alias("to_id")).distinct().join(left.select("to_id"), "to_id", "left_anti").withColumn("left", F.lit(d).cast("long"))
        step = cut(step)
        left = left.unionByName(step)
    front = starts.select(F.col("id").alias("start"), "id", F.array("id").alias("path"))
    done = front.where(F.col("id") == goal)
    for d in range(depth):
        front = front.where(F.col("id") != goal).join(out, "id").where(~F.array_contains("path", F.col("to_id"))).join(left.where(F.col("left") < depth - d).select("to_id"), "to_id", "left_semi")
        front = cut(front.select("start", F.col("to_id").alias("id"), F.array_append("path", F.col("to_id")).alias("path")))
        done = done.unionByName(front.where(F.col("id") == goal))
    # Depth-first order is the order of the lists of identifiers: no path to the goal is the beginning of another.
    return done.groupBy("start").agg(F.min("path").alias("path"))


def lineage(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(start, id, steps, cycle): the chain of parents of each start; ``nodes`` has id, of which none is twice, and parent.

    A chain ends at its root, or with ``cycle`` at the first node that it meets again.  Pointers double: in each round a node
    learns who stands twice as far above it, so rounds go with the logarithm of the longest chain, tail or cycle.

    * Fewer nodes reach farther.  When a round loses none, those left never end: they run into cycles.
    * Of these, the images under longer and longer steps shrink; when they no longer do, they are the nodes on cycles.
    * On a cycle the least node finds itself again, which tells the cycle's length.
    """
    ups = [cut(nodes.where("parent is not null").select("id", F.col("parent").alias("to")))]

    def doubled(up: DataFrame) -> DataFrame:
        return cut(up.join(up.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))

    left = ups[0].count()
    while left:
        ups.append(doubled(ups[-1]))
        before, left = left, ups[-1].count()
        if left == before:
            break
    limits = None
    if left:
        limits = _cycle_limits(ups, doubled)
    front = start.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("steps"))
    if limits is None:
        front = front.withColumn("most", F.lit(None).cast("long"))
    else:
        farthest = limits.agg(F.max("most")).first()[0]
        while 1 << len(ups) <= farthest:
            ups.append(doubled(ups[-1]))
        front = front.join(limits.withColumnRenamed("id", "start"), "start", "left")
    found = cut(front.select("start", "id", "steps", "most"))
    for k, up in enumerate(ups):
        far = F.col("steps") + (1 << k)
        more = found.join(up, "id").where(F.col("most").isNull() | (far <= F.col("most"))).select("start", F.col("to").alias("id"), far.alias("steps"), "most")
        found = cut(found.unionByName(more))
    return found.select("start", "id", F.col("steps").cast("int").alias("steps"), F.coalesce(F.col("steps") == F.col("most"), F.lit(False)).alias("cycle"))


def _cycle_limits(ups: list[DataFrame], doubled: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, most) of nodes that run into cycles: after how many steps one meets a node again.  ``ups`` may get longer."""
    size = ups[-1].select("to").distinct().count()
    while True:
        ups.append(doubled(ups[-1]))
        before, size = size, ups[-1].select("to").distinct().count()
        if size == before:
            break
    looping = ups[-1].select("id")
    ring = cut(ups[-1].select(F.col("to").alias("id")).distinct())
    # The least node met within the steps so far, and when first.
    seen = cut(ups[0].join(ring, "id", "left_semi").select("id", "to", F.struct(F.col("to").alias("least"), F.lit(1).cast("long").alias("after")).alias("best")))
    width = 1
    while True:
        leaders = seen.where("best.least = id").select(F.col("id").alias("leader"), F.col("best.after").alias("length"))
        of = seen.select("id", F.col("best.least").alias("leader")).join(leaders, "leader", "left")
        if not of.where("length IS NULL").limit(1).count():
            break
        ahead = seen.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("best").alias("beyond"))
        beyond = F.struct(F.col("beyond.least").alias("least"), (F.col("beyond.after") + width).alias("after"))
        seen = cut(seen.join(ahead, "to").select("id", F.col("next").alias("to"), F.least("best", beyond).alias("best")))
        width *= 2
    of = cut(of.select("id", "length"))
    # How far the others are from their cycle: pointers stop at its nodes.
    way = ups[0].join(looping, "id", "left_semi").join(of, "id", "left")
    way = cut(way.select("id", F.when(F.col("length").isNull(), F.col("to")).otherwise(F.col("id")).alias("to"), F.when(F.col("length").isNull(), 1).otherwise(0).cast("long").alias("far"), F.col("length").isNotNull().alias("there")))
    while way.where("NOT there").limit(1).count():
        ahead = way.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("there").alias("then"))
        way = cut(way.join(ahead, "to").select("id", F.col("next").alias("to"), F.when(F.col("there"), F.col("far")).otherwise(F.col("far") + F.col("more")).alias("far"), (F.col("there") | F.col("then")).alias("there")))
    return cut(way.join(of.withColumnRenamed("id", "to"), "to").select("id", (F.col("far") + F.col("length")).alias("most")))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def impact_graph(analyses: DataFrame, links: DataFrame, edges: DataFrame, insights: DataFrame, proofs: DataFrame, max_nodes: int = 50, max_edges: int = 80) -> tuple[DataFrame, DataFrame]:
    """Nodes (analysis_id, node, node_type, source, rank, truncated) and edges (analysis_id, source, target, type, source_kind) of analyses.

    ``analyses`` has analysis_id and requirement_id, ``links`` analysis_id, link_id, artifact_id and score, ``insights``
    analysis_id, insight_id, insight_type and review_status, ``proofs`` insight_id, evidence_id and artifact_id.
    Room goes first to the roots, then to artifacts by their best link, to dependencies and the neighbours
    that they bring by (from, to, type), to insights, confirmed ones first.  Of equals the smaller identifier comes first.
    """
    room, by = max_nodes - 2, ["analysis_id"]
    best = links.groupBy("analysis_id", "artifact_id").agg(F.max(F.struct("score", (-F.col("link_id")).alias("l"))).alias("b"))
    artifacts = top_per_group(best, by, [F.col("b").desc()], room).select("analysis_id", "artifact_id")

    def listed(at: str, far: str) -> DataFrame:
        """(artifact_id, ``far``): the other ends of an artifact's edges, by type; only its first can be among the first of an analysis, so hubs do not multiply."""
        first = top_per_group(edges, [at], [F.col(far), F.col("type")], max_edges)
        lists = first.groupBy(F.col(at).alias("artifact_id")).agg(F.sort_array(F.collect_list(F.struct("type", F.col(far).alias("id")))).alias("l"))
        # These lists are shuffled for each analysis of an artifact: types and how many ends they have, and ends as integers where they are small.
        types, ids = F.transform("l", lambda x: x["type"]), F.transform("l", lambda x: x["id"])
        small = F.coalesce(F.forall(ids, lambda i: i.between(-(1 << 31), (1 << 31) - 1)), F.lit(False))
        counts = F.transform(F.array_distinct(types), lambda t: F.size(F.filter(types, lambda x: x.eqNullSafe(t))))
        told = F.struct(F.array_distinct(types).alias("types"), counts.alias("counts"), F.when(small, F.transform(ids, lambda i: i.cast("int"))).alias("ints"), F.when(~small, ids).alias("longs"))
        return lists.select("artifact_id", told.alias(far))

    # An analysis is one row with its bounded lists: its edges are shuffled once, as lists of other ends, and are not written.
    own = artifacts.join(listed("from_id", "to_id"), "artifact_id", "left").join(listed("to_id", "from_id"), "artifact_id", "left")
    own = own.groupBy("analysis_id").agg(F.collect_list(F.struct("artifact_id", "to_id", "from_id")).alias("own"))
    id_type = edges.schema["from_id"].dataType
    no_edges = F.array().cast(f"array<struct<from_id: {id_type.simpleString()}, to_id: {id_type.simpleString()}, type: {edges.schema['type'].dataType.simpleString()}>>")

    def edges_of(far: str):
        def one(a, i, t):
            start, end = (a["artifact_id"], i) if far == "to_id" else (i, a["artifact_id"])
            return F.struct(start.cast(id_type).alias("from_id"), end.cast(id_type).alias("to_id"), t.alias("type"))

        def drawn_from(a):
            l = a[far]  # noqa: E741
            types = F.flatten(F.zip_with(l["types"], l["counts"], F.array_repeat))
            return F.coalesce(F.zip_with(F.coalesce(F.transform(l["ints"], lambda i: i.cast(id_type)), l["longs"]), types, lambda i, t: one(a, i, t)), no_edges)

        return F.flatten(F.transform("own", drawn_from))

    near = F.sort_array(F.concat(edges_of("to_id"), edges_of("from_id")))
    rows = analyses.select("analysis_id", "requirement_id").join(own, "analysis_id", "left").withColumn("own", F.coalesce("own", F.array()))
    rows = rows.select("analysis_id", "requirement_id", F.transform("own", lambda a: a["artifact_id"]).alias("artifacts"), near.alias("near"))
    # Both ends of an edge may be artifacts of the analysis.
    once = F.filter("near", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("near", i - 1)))
    n, n_deps, n_fresh = F.size("artifacts"), F.size("deps"), F.size("fresh")
    rows = rows.withColumn("near", once).withColumn("deps", F.slice("near", F.lit(1), F.greatest(max_edges - 1 - n, F.lit(0)))).drop("near")
    ends = F.flatten(F.transform("deps", lambda d: F.array(d["from_id"], d["to_id"])))
    rows = rows.withColumn("fresh", F.slice(F.array_except(ends, "artifacts"), F.lit(1), room - n))

    state = F.when(F.col("review_status") == "CONFIRMED", 0).when(F.col("review_status") == "NEEDS_REVIEW", 1).otherwise(2)
    told = top_per_group(insights, by, [state, F.col("insight_id")], room)
    told = told.withColumn("place", F.row_number().over(Window.partitionBy("analysis_id").orderBy(state, "insight_id"))).select("analysis_id", "insight_id", "insight_type", "place")
    room_left = F.col("place") <= room - F.col("n") - F.col("f")
    counts = [n.alias("n"), n_deps.alias("d"), n_fresh.alias("f")]

    def name(kind: str, c):
        return F.concat(F.lit(f"{kind}-"), c)

    def node(of, node_type: str, source: str, rank: int):
        return F.struct(of.alias("node"), F.lit(node_type).alias("node_type"), F.lit(source).alias("source"), F.lit(rank).alias("rank"))

    def edge(source, target, kind, source_kind: str):
        return F.struct(source.alias("source"), target.alias("target"), kind.alias("type"), F.lit(source_kind).alias("source_kind"))

    root = name("analysis", F.col("analysis_id"))
    insight_type = F.col("insight_type")
    node_type = F.when(insight_type.isin("UNKNOWN", "QA_SCENARIO"), insight_type).otherwise(F.lit("INSIGHT"))
    told_by = F.when(insight_type == "UNKNOWN", "RAISES_UNKNOWN").when(insight_type == "QA_SCENARIO", "SUGGESTS_QA").otherwise("EVIDENCES")
    size = links.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("l")), insights.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("i"))
    whole = analyses.select("analysis_id").join(size[0], "analysis_id", "left").join(size[1], "analysis_id", "left").fillna(0)
    truncated = whole.select("analysis_id", (F.col("l") + F.col("i") + 2 > max_nodes).alias("truncated"))
    listed_nodes = F.concat(
        F.array(node(name("req", F.col("requirement_id")), "REQUIREMENT", "ROOT", 0), node(root, "ANALYSIS", "ROOT", 1)),
        F.transform("artifacts", lambda a: node(name("artifact", a), "ARTIFACT", "TRACEABILITY", 2)),
        F.transform("fresh", lambda a: node(name("artifact", a), "ARTIFACT", "DEPENDENCY", 4)),
    )
    told_nodes = told.join(rows.select("analysis_id", *counts), "analysis_id").where(room_left).select("analysis_id", name("insight", F.col("insight_id")).alias("node"), node_type.alias("node_type"), F.lit("INSIGHT").alias("source"), F.lit(3).alias("rank"))
    nodes = rows.select("analysis_id", F.explode(listed_nodes).alias("x")).select("analysis_id", "x.*").unionByName(told_nodes).join(truncated, "analysis_id")

    def drawn(d):  # tests are shown from what is tested to its test
        a, b, tests = name("artifact", d["from_id"]), name("artifact", d["to_id"]), d["type"] == "TESTS"
        return edge(F.when(tests, b).otherwise(a), F.when(tests, a).otherwise(b), d["type"], "DEPENDENCY")

    listed_edges = F.concat(
        F.array(edge(name("req", F.col("requirement_id")), root, F.lit("AFFECTS"), "ROOT_LINK")),
        F.transform("artifacts", lambda a: edge(root, name("artifact", a), F.lit("AFFECTS"), "TRACEABILITY")),
        F.transform("deps", drawn),
    )
    # Insights hang on the shown artifact of their first evidence.
    proven = told.join(proofs.select("insight_id", "evidence_id", "artifact_id"), "insight_id", "left").join(rows.select("analysis_id", *counts, F.concat("artifacts", "fresh").alias("shown")), "analysis_id")
    proven = proven.where(room_left & (F.col("place") <= max_edges - 1 - F.col("n") - F.col("d"))).withColumn("on", F.when(F.array_contains("shown", F.col("artifact_id")), F.struct("artifact_id", "evidence_id")))
    proven = proven.groupBy("analysis_id", "insight_id", "insight_type").agg(F.min_by("on.artifact_id", "on.evidence_id").alias("on"))
    told_edges = proven.select("analysis_id", F.coalesce(name("artifact", F.col("on")), root).alias("source"), name("insight", F.col("insight_id")).alias("target"), told_by.alias("type"), F.lit("EVIDENCE_LINK").alias("source_kind"))
    shown_edges = rows.select("analysis_id", F.explode(listed_edges).alias("x")).select("analysis_id", "x.*").unionByName(told_edges)
    return nodes, shown_edges


def scenario_page(edges: DataFrame, targets: DataFrame, limit: int, offset: int, depth: int = 4, most: int = 50, scan: int = 5_000) -> DataFrame:
    """(id, scenarios, static_calls, dependencies, has_more, limitations): what is told of an artifact, a page of its tests at a time.

    Tests are those of the artifact and of its callers, in the order of their identifiers, each once.  ``most`` bounds the
    lists of calls and dependencies, ``scan`` the tests that are looked at; what a bound leaves out is named.
    """
    one = targets.select("id").distinct()
    tests = edges.where("type = 'TESTS'").select(F.col("from_id").alias("test"), F.col("to_id").alias("id"))
    found = upstream(edges, one, depth).select("target", "id").join(tests, "id").select(F.col("target").alias("id"), "test").distinct()
    found = top_per_group(found, ["id"], [F.col("test")], scan)
    place = F.row_number().over(Window.partitionBy("id").orderBy("test"))
    paged = found.withColumn("place", place).groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(F.col("place").between(offset + 1, offset + limit), F.col("test")))).alias("scenarios"),
        F.count(F.lit(1)).alias("n"),
    )
    out = edges.join(one.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("from_id").alias("id"), "to_id", "type").distinct()

    def ends(rows: DataFrame, named: str) -> DataFrame:
        rows = rows.select("id", "to_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("to_id"))).where(F.col("place") <= most + 1)
        return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("place") <= most, F.col("to_id")))).alias(named), (F.count(F.lit(1)) > most).alias(f"{named}_cut"))

    every = one.join(paged, "id", "left").join(ends(out.where("type = 'CALLS'"), "static_calls"), "id", "left").join(ends(out, "dependencies"), "id", "left")
    nothing = F.array().cast("array<bigint>")
    every = every.fillna(0, ["n"]).fillna(False, ["static_calls_cut", "dependencies_cut"])
    more = F.col("n") > offset + limit
    limitations = F.array_compact(F.array(F.when(F.col("n") == 0, "NO_SUPPORTED_TEST_REFERENCE"), F.when(F.col("n") == scan, "SCENARIO_SOURCE_SCAN_LIMIT"), F.when(more | F.col("static_calls_cut") | F.col("dependencies_cut"), "COMPREHENSION_LIMIT")))
    return every.select("id", *[F.coalesce(F.col(c).cast("array<bigint>"), nothing).alias(c) for c in ("scenarios", "static_calls", "dependencies")], more.alias("has_more"), limitations.alias("limitations"))


def resolve_tokens(wanted: DataFrame, provides: DataFrame, imports: DataFrame, exports: DataFrame, hops: int = 3) -> DataFrame:
    """(module, token, provider, outcome): which class a module gets for a token.

    ``provides`` has module, token, kind and target: a class (CLASS), another token of the module (EXISTING), or what no reading
    of declarations resolves (FACTORY).  A module sees what it provides itself and, if that is nothing, what modules that it
    imports provide and export.  More than one class is ambiguous; aliases are followed ``hops`` times.
    """
    ends, left = [], provides.select("module", "token", "kind", "target").distinct()
    step = left.select("module", "token", "kind", "target", F.col("target").alias("at"))
    for _ in range(hops):
        ends.append(step.where("kind <> 'EXISTING'").select("module", "token", "kind", "target"))
        nxt = left.select("module", F.col("token").alias("at"), F.col("kind").alias("k2"), F.col("target").alias("t2"))
        step = step.where("kind = 'EXISTING'").join(nxt, ["module", "at"], "left").select("module", "token", F.coalesce("k2", F.lit("MISSING")).alias("kind"), F.col("t2").alias("target"), F.col("t2").alias("at"))
    ends.append(step.withColumn("kind", F.when(F.col("kind") == "EXISTING", "TOO_DEEP").otherwise(F.col("kind"))).select("module", "token", "kind", "target"))
    own = merged(ends).groupBy("module", "token").agg(F.collect_set("kind").alias("kinds"), F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    given = imports.select("module", F.col("imported").alias("from_module")).distinct().join(exports.select(F.col("module").alias("from_module"), "token").distinct(), "from_module")
    brought = given.join(merged(ends).withColumnRenamed("module", "from_module"), ["from_module", "token"])
    brought = brought.groupBy("module", "token").agg(F.collect_set("kind").alias("kinds"), F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    ask = wanted.select("module", "token").distinct()
    mine = ask.join(own, ["module", "token"])
    rest = ask.join(own, ["module", "token"], "left_anti").join(brought, ["module", "token"], "left")
    every = mine.unionByName(rest)
    outcome = (
        F.when(F.col("kinds").isNull(), "UNRESOLVED")
        .when(F.array_contains("kinds", "FACTORY"), "UNSUPPORTED_FACTORY")
        .when(F.array_contains("kinds", "TOO_DEEP"), "UNRESOLVED_ALIAS")
        .when(F.col("n") == 0, "UNRESOLVED")
        .when(F.col("n") > 1, "AMBIGUOUS")
        .otherwise("RESOLVED")
    )
    return every.select("module", "token", F.when(outcome == "RESOLVED", F.col("target")).alias("provider"), outcome.alias("outcome"))
