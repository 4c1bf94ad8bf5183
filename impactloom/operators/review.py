"""Review read models: evidence quality, approval gates, coverage, matrix, completion, readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import all_matches, count_if, first_match, ratio
from . import projections as p

# Quality labels.
LABELS = ["STRONG_SOURCE_EVIDENCE", "WEAK_SOURCE_EVIDENCE", "INFERRED_FROM_STRUCTURE", "DOMAIN_HINT_ONLY", "MISSING_EVIDENCE", "CONFLICTING_EVIDENCE", "REVIEW_REQUIRED", "DERIVED_ARTIFACT"]
FACTS = ["has_evidence", "has_source", "hint_only", "has_artifact", "has_path", "has_lines", "has_excerpt"]
KIND_BUCKETS = ["API_ENDPOINT", "DOMAIN_SERVICE", "DATA_MODEL", "TEST_CASE", "TEST_FILE", "UNKNOWN"]


def inspect_evidence(items: DataFrame, bridge: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """``key`` of ``items`` and what all or any of its evidence has; an excerpt is specific from 20 characters on."""
    e = evidence.select("evidence_id", "artifact_id", "source_type", "source_path", "start_line", "end_line", "excerpt")
    source = F.coalesce(F.col("source_type") != "DOMAIN_HINT", F.lit(False))

    def some(c: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("evidence_id").isNotNull(), source & c)), F.lit(False))

    return (
        items.select(key)
        .distinct()
        .join(bridge.join(e, "evidence_id"), key, "left")
        .groupBy(key)
        .agg(
            (F.count("evidence_id") > 0).alias("has_evidence"),
            some(F.lit(True)).alias("has_source"),
            F.coalesce(F.min(F.when(F.col("evidence_id").isNotNull(), ~source)), F.lit(False)).alias("hint_only"),
            some(F.col("artifact_id").isNotNull()).alias("has_artifact"),
            some(F.col("source_path").isNotNull()).alias("has_path"),
            some(F.col("start_line").isNotNull() & F.col("end_line").isNotNull()).alias("has_lines"),
            some(F.coalesce(F.length("excerpt") >= 20, F.lit(False))).alias("has_excerpt"),
        )
    )


def _source_quality() -> list[tuple[Column, str]]:
    strong = F.col("has_artifact") & F.col("has_path") & F.col("has_lines") & F.col("has_excerpt")
    return [(~F.col("has_evidence") | ~F.col("has_source"), "MISSING_EVIDENCE"), (strong, "STRONG_SOURCE_EVIDENCE")]


def link_quality(links: DataFrame, facts: DataFrame, structured: Column) -> DataFrame:
    """Links with their quality; ``structured`` says whether the linked artifact itself is usable."""
    inferred = F.col("link_basis") == "INFERRED"
    return links.join(facts, "link_id").withColumn(
        "quality",
        first_match(
            [
                (F.col("review_status") == "NEEDS_REVIEW", "REVIEW_REQUIRED"),
                (inferred & (structured | F.col("has_source")), "INFERRED_FROM_STRUCTURE"),
                (inferred, "MISSING_EVIDENCE"),
                (F.col("hint_only"), "DOMAIN_HINT_ONLY"),
                *_source_quality(),
            ],
            "WEAK_SOURCE_EVIDENCE",
        ),
    )


def insight_quality(insights: DataFrame, facts: DataFrame) -> DataFrame:
    needs = (F.col("review_status") == "NEEDS_REVIEW") & (F.col("certainty").isin("EVIDENCED", "CONFLICTING") | F.col("insight_type").isin("CLAIM", "UNKNOWN"))
    inferred = F.col("certainty") == "INFERRED"
    return insights.join(facts, "insight_id").withColumn(
        "quality",
        first_match(
            [
                (F.col("insight_type").isin("QA_SCENARIO", "ACCEPTANCE_CRITERIA"), "DERIVED_ARTIFACT"),
                (F.col("certainty") == "CONFLICTING", "CONFLICTING_EVIDENCE"),
                (needs, "REVIEW_REQUIRED"),
                (F.col("hint_only"), "DOMAIN_HINT_ONLY"),
                (inferred & F.col("has_source"), "INFERRED_FROM_STRUCTURE"),
                (inferred | (F.col("certainty") == "UNKNOWN"), "MISSING_EVIDENCE"),
                *_source_quality(),
            ],
            "WEAK_SOURCE_EVIDENCE",
        ),
    )


def quality_histogram(items: DataFrame, by: str) -> DataFrame:
    return items.groupBy(by).agg(*[count_if(F.col("quality") == x).alias(x.lower()) for x in LABELS])


def gate_items(insights: DataFrame, links: DataFrame) -> DataFrame:
    """Insights and links as one list: item_type, item_id, analysis_id, quality, review_status, decision, critical, inferred."""
    affected = F.col("link_type") == "AFFECTED"
    a = insights.select(
        F.lit("INSIGHT").alias("item_type"),
        F.col("insight_id").alias("item_id"),
        "analysis_id",
        "quality",
        "review_status",
        F.lit(None).cast("string").alias("decision"),
        ((F.col("insight_type") == "CLAIM") | (F.col("certainty") == "CONFLICTING")).alias("critical"),
        F.lit(False).alias("inferred"),
    )
    b = links.select(
        F.lit("TRACEABILITY_LINK").alias("item_type"),
        F.col("link_id").alias("item_id"),
        "analysis_id",
        "quality",
        "review_status",
        "decision",
        (affected & (F.col("link_basis") == "EVIDENCED")).alias("critical"),
        (affected & (F.col("link_basis") == "INFERRED")).alias("inferred"),
    )
    return a.unionByName(b)


def blocking_items(items: DataFrame) -> DataFrame:
    """(analysis_id, code, item_type, item_id): what stands against an approval, once each."""
    insight = F.col("item_type") == "INSIGHT"
    decided = F.coalesce(F.when(insight, F.col("review_status").isin("CONFIRMED", "REJECTED")).otherwise(F.col("decision").isin("ACCEPTED", "REJECTED", "NEEDS_REVIEW", "NEEDS_MORE_EVIDENCE")), F.lit(False))
    rejected = F.coalesce(F.when(insight, F.col("review_status") == "REJECTED").otherwise(F.col("decision") == "REJECTED"), F.lit(False))
    settled = F.coalesce(F.col("decision").isin("ACCEPTED", "REJECTED"), F.lit(False))
    codes = all_matches(
        [
            (F.col("critical") & (F.col("quality") == "REVIEW_REQUIRED"), "REVIEW_REQUIRED_ITEMS"),
            ((F.col("quality") == "CONFLICTING_EVIDENCE") & ~decided, "CONFLICTING_EVIDENCE_UNREVIEWED"),
            (F.col("critical") & (F.col("quality") == "MISSING_EVIDENCE") & ~rejected, "CRITICAL_MISSING_EVIDENCE"),
            (F.col("critical") & insight & (F.col("review_status") == "NEEDS_REVIEW"), "HIGH_RISK_INSIGHT_UNREVIEWED"),
            (F.col("inferred") & ~insight & ~settled, "INFERRED_LINKS_UNREVIEWED"),
        ]
    )
    return items.select("analysis_id", "item_type", "item_id", F.explode(codes).alias("code")).dropDuplicates(["code", "item_type", "item_id"])


def risk_coverage(insights: DataFrame, bridge: DataFrame) -> DataFrame:
    """(insight_id, analysis_id, covered): risks, covered if a QA scenario of the analysis shares evidence."""
    risks = insights.where(p.is_risk(F.col("insight_type"), F.col("certainty"), F.col("metadata"))).select("insight_id", "analysis_id")
    pairs = bridge.select("insight_id", "evidence_id")
    of_qa = insights.where("insight_type = 'QA_SCENARIO'").select("insight_id", "analysis_id").join(pairs, "insight_id").select("analysis_id", "evidence_id").distinct()
    covered = risks.join(pairs, "insight_id").join(of_qa, ["analysis_id", "evidence_id"], "left_semi").select("insight_id").distinct().withColumn("covered", F.lit(True))
    return risks.join(covered, "insight_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def artifact_evidence(links: DataFrame, bridge: DataFrame) -> DataFrame:
    """(analysis_id, artifact_id, covered): linked artifacts, covered if any of their links has evidence."""
    proven = bridge.select("link_id").distinct().withColumn("proven", F.lit(True))
    return links.select("link_id", "analysis_id", "artifact_id").join(proven, "link_id", "left").groupBy("analysis_id", "artifact_id").agg(F.coalesce(F.max("proven"), F.lit(False)).alias("covered"))


def coverage(judged: DataFrame, links: DataFrame, link_bridge: DataFrame, insights: DataFrame, insight_bridge: DataFrame) -> DataFrame:
    """One row per run: thirteen counters, five gates and the whole status.

    ``judged`` has analysis_id, run_id and the latest decision.
    """
    a = artifact_evidence(links, link_bridge).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("artifacts"), count_if(F.col("covered")).alias("proven"))
    r = risk_coverage(insights, insight_bridge).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("risks"), count_if(F.col("covered")).alias("risks_qa"))
    q = insights.groupBy("analysis_id").agg(count_if(F.col("insight_type") == "QA_SCENARIO").alias("qa"))
    each = reduce(lambda x, y: x.join(y, "analysis_id", "left"), [a, r, q], judged.select("analysis_id", "run_id", "decision")).fillna(0, ["artifacts", "proven", "risks", "risks_qa", "qa"])
    accepted = F.coalesce(F.col("decision") == "ACCEPTED", F.lit(False))
    runs = each.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("repositories"),
        count_if(accepted).alias("accepted"),
        count_if(F.col("decision").isNull()).alias("pending"),
        count_if(F.col("decision").isin("REJECTED", "NEEDS_MORE_CLARIFICATION")).alias("rejected"),
        F.sum("artifacts").alias("artifacts"),
        F.sum("proven").alias("artifacts_with_evidence"),
        F.sum(F.col("artifacts") - F.col("proven")).alias("uncovered_artifacts"),
        F.sum("risks").alias("risks"),
        F.sum("risks_qa").alias("risks_with_qa"),
        F.sum(F.col("risks") - F.col("risks_qa")).alias("risks_without_qa"),
        F.sum("qa").alias("qa_scenarios"),
        count_if((F.col("risks") > 0) & (F.col("qa") == 0)).alias("__no_qa"),
        count_if(accepted & (F.col("artifacts") == 0)).alias("__empty"),
        F.sort_array(F.collect_list(F.when(~accepted, F.col("analysis_id")))).alias("not_accepted"),
    )
    gates = {
        "review_decision": F.when(F.col("accepted") < F.col("repositories"), "FAIL"),
        "evidence_coverage": F.when(F.col("uncovered_artifacts") > 0, "WARN"),
        "qa_coverage": F.when(F.col("risks_without_qa") > 0, "WARN"),
        "risk_coverage": F.when(F.col("__no_qa") > 0, "WARN"),
        "repository_readiness": F.when(F.col("__empty") > 0, "WARN"),
    }
    out = runs.withColumns({k: F.coalesce(v, F.lit("PASS")) for k, v in gates.items()})
    counts = {f"{n}_gates": reduce(Column.__add__, [(F.col(k) == v).cast("long") for k in gates]) for n, v in (("blocking", "FAIL"), ("warning", "WARN"))}
    out = out.withColumns(counts)
    return out.withColumn("status", first_match([(F.col("blocking_gates") > 0, "FAIL"), (F.col("warning_gates") > 0, "WARN")], "PASS")).drop("__no_qa", "__empty")


def matrix(judged: DataFrame, links: DataFrame, insights: DataFrame) -> DataFrame:
    """One row per analysis: distinct artifacts by kind, risks, scenarios, links and the blocking reason."""
    kind = F.when(F.col("universal_kind").isin(KIND_BUCKETS), F.col("universal_kind")).otherwise(F.lit("UNKNOWN"))
    # Each artifact of a kind once, then counts: distinct counts per kind would multiply every link.
    once = links.groupBy("analysis_id", "artifact_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    is_one = F.col("artifact_id").isNotNull()
    counts = once.groupBy("analysis_id").agg(*[count_if(is_one & (F.col("kind") == k)).alias(k.lower()) for k in KIND_BUCKETS], F.sum("n").alias("evidence_count"))
    unknown = F.col("insight_type") == "UNKNOWN"
    found = insights.groupBy("analysis_id").agg(
        count_if(unknown).alias("unknown_count"), count_if(~unknown & (F.col("certainty") == "CONFLICTING")).alias("conflicting_count"), count_if(F.col("insight_type") == "QA_SCENARIO").alias("qa_count")
    )
    numbers = [*[k.lower() for k in KIND_BUCKETS], "evidence_count", "unknown_count", "conflicting_count", "qa_count"]
    rows = judged.join(counts, "analysis_id", "left").join(found, "analysis_id", "left").fillna(0, numbers)
    return rows.select("run_id", "analysis_id", "status", "decision", *numbers, (F.col("unknown_count") + F.col("conflicting_count")).alias("risk_count"), p.child_block(F.col("status"), F.col("stale"), F.col("decision")).alias("blocking_reason"))


def matrix_summary(rows: DataFrame) -> DataFrame:
    artifacts = reduce(Column.__add__, [F.col(k.lower()) for k in KIND_BUCKETS])
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("repositories"),
        F.sum(artifacts).alias("artifacts"),
        F.sum("risk_count").alias("risks"),
        F.sum("qa_count").alias("qa_scenarios"),
        count_if(F.col("decision") == "ACCEPTED").alias("accepted"),
        count_if(F.col("blocking_reason") != "NONE").alias("blocked"),
    )


def completion(links: DataFrame) -> DataFrame:
    """One row per analysis: links by decision, whether all are decided, and that the counts add up."""
    d = F.coalesce("decision", "review_status")
    named = ["ACCEPTED", "CONFIRMED", "REJECTED", "NEEDS_REVIEW", "NEEDS_MORE_EVIDENCE"]
    out = links.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("total"),
        count_if(d.isin("ACCEPTED", "CONFIRMED")).alias("accepted"),
        count_if(d == "REJECTED").alias("rejected"),
        count_if(d == "NEEDS_REVIEW").alias("needs_review"),
        count_if(d == "NEEDS_MORE_EVIDENCE").alias("needs_more_evidence"),
        count_if(~F.coalesce(d.isin(named), F.lit(False))).alias("unreviewed"),
    )
    return out.withColumn("complete", (F.col("needs_review") == 0) & (F.col("unreviewed") == 0))


def readiness(judged: DataFrame, by: str = "run_id") -> DataFrame:
    """One row per run: child analyses by state and decision, and whether a merged report can start."""
    done, fine = F.col("status") == "COMPLETED", F.coalesce(F.col("decision") == "ACCEPTED", F.lit(False))
    return judged.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        count_if(done).alias("completed"),
        count_if(F.col("status") == "FAILED").alias("failed"),
        count_if(F.col("status") == "WAITING_FOR_REVIEW").alias("waiting"),
        F.bool_and(done).alias("all_completed"),
        F.bool_or(F.col("status") == "FAILED").alias("has_failures"),
        F.bool_and(done & fine & ~F.col("stale")).alias("can_start"),
        count_if(fine).alias("accepted"),
        count_if(F.col("decision") == "REJECTED").alias("rejected"),
        count_if(F.col("decision") == "NEEDS_MORE_CLARIFICATION").alias("needs_more_clarification"),
        count_if(F.col("decision").isNull()).alias("pending_review"),
    )


def merged_reports(judged: DataFrame, approved: DataFrame) -> DataFrame:
    """Per run: status and capabilities of the merged report; ``approved`` has run_id and report_stale."""
    runs = readiness(judged).select("run_id", "can_start").join(approved.select("run_id", "report_stale"), "run_id", "left")
    has = F.col("report_stale").isNotNull()
    stale, start = F.coalesce("report_stale", F.lit(False)), F.col("can_start")
    return runs.select(
        "run_id",
        first_match([(has & stale, "STALE"), (has, "CURRENT"), (start, "NOT_CREATED")], "BLOCKED").alias("report_status"),
        (~has & start).alias("can_finalize"),
        (has & stale & start).alias("can_refresh"),
        (has & ~stale).alias("can_export"),
        has.alias("can_open"),
    )


def review_coverage(items: DataFrame, by: str = "analysis_id") -> DataFrame:
    """Reviewed and unreviewed insights and links of a report."""
    i, d = F.col("item_type") == "INSIGHT", F.col("decision")
    out = items.groupBy(by).agg(
        count_if(i).alias("insights"),
        count_if(i & (F.col("review_status") == "CONFIRMED")).alias("confirmed"),
        count_if(i & (F.col("review_status") == "REJECTED")).alias("insights_rejected"),
        count_if(i & (F.col("review_status") == "NEEDS_REVIEW")).alias("insights_need_review"),
        count_if(~i).alias("links"),
        count_if(~i & (d == "ACCEPTED")).alias("links_accepted"),
        count_if(~i & (d == "REJECTED")).alias("links_rejected"),
        count_if(~i & (d == "NEEDS_REVIEW")).alias("links_need_review"),
        count_if(~i & (d == "NEEDS_MORE_EVIDENCE")).alias("needs_more_evidence"),
    )
    insights_left = F.col("insights") - F.col("confirmed") - F.col("insights_rejected")
    links_left = F.col("links") - F.col("links_accepted") - F.col("links_rejected") - F.col("links_need_review") - F.col("needs_more_evidence")
    needs = F.col("insights_need_review") + F.col("links_need_review")
    return out.select(
        by,
        (F.col("confirmed") + F.col("links_accepted")).alias("accepted"),
        (F.col("insights_rejected") + F.col("links_rejected")).alias("rejected"),
        needs.alias("needs_review"),
        "needs_more_evidence",
        (insights_left + links_left).alias("unreviewed"),
        (needs + F.col("needs_more_evidence") + insights_left + links_left).alias("needs_clarification"),
    )


def prf(expected: DataFrame, predicted: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Precision, recall and F1 of two sets, per ``by``; null where a denominator is 0."""
    on = [*by, *key]
    e = expected.select(*on).distinct().withColumn("__e", F.lit(1))
    q = predicted.select(*on).distinct().withColumn("__p", F.lit(1))
    both = e.join(q, on, "full_outer").fillna(0, ["__e", "__p"])
    sums = [F.sum("__e").alias("expected"), F.sum("__p").alias("predicted"), F.sum(F.col("__e") * F.col("__p")).alias("true_positive")]
    out = both.groupBy(*by).agg(*sums)
    return out.select(
        *by, "expected", "predicted", "true_positive",
        (F.col("predicted") - F.col("true_positive")).alias("false_positive"),
        (F.col("expected") - F.col("true_positive")).alias("false_negative"),
        ratio(F.col("true_positive"), F.col("predicted")).alias("precision"),
        ratio(F.col("true_positive"), F.col("expected")).alias("recall"),
        ratio(2 * F.col("true_positive"), F.col("expected") + F.col("predicted")).alias("f1"),
    )


def coverage_gates(judged: DataFrame, links: DataFrame, link_bridge: DataFrame, insights: DataFrame, insight_bridge: DataFrame) -> DataFrame:
    """(run_id, gate, status, analyses, artifacts, insights): the five gates of a run with the identifiers that they stop at."""
    runs = judged.select("analysis_id", "run_id", F.coalesce(F.col("decision") == "ACCEPTED", F.lit(False)).alias("accepted"))
    proven, risks = artifact_evidence(links, link_bridge), risk_coverage(insights, insight_bridge)
    bare = proven.where("not covered").select("analysis_id", F.col("artifact_id").alias("id"))
    loose = risks.where("not covered").select("analysis_id", F.col("insight_id").alias("id"))
    qa = insights.where("insight_type = 'QA_SCENARIO'").select("analysis_id")
    no_qa = risks.select("analysis_id").distinct().join(qa, "analysis_id", "left_anti")
    empty = runs.where("accepted").join(links.select("analysis_id"), "analysis_id", "left_anti")
    found = {
        "REVIEW_DECISION": ("analyses", "FAIL", runs.where("not accepted").select("run_id", F.col("analysis_id").alias("id"))),
        "EVIDENCE_COVERAGE": ("artifacts", "WARN", bare.join(runs, "analysis_id").select("run_id", "id")),
        "QA_COVERAGE": ("insights", "WARN", loose.join(runs, "analysis_id").select("run_id", "id")),
        "RISK_COVERAGE": ("analyses", "WARN", no_qa.join(runs, "analysis_id").select("run_id", F.col("analysis_id").alias("id"))),
        "REPOSITORY_READINESS": ("analyses", "WARN", empty.select("run_id", F.col("analysis_id").alias("id"))),
    }
    rows = reduce(DataFrame.unionByName, [ids.select("run_id", F.lit(gate).alias("gate"), F.col("id").cast("long").alias("id")) for gate, (_, _, ids) in found.items()])
    stopped = rows.groupBy("run_id", "gate").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    every = runs.select("run_id").distinct().withColumn("gate", F.explode(F.array(*[F.lit(g) for g in found])))
    out = every.join(stopped, ["run_id", "gate"], "left")
    nothing = F.array().cast("array<bigint>")
    lists = {kind: F.when(F.col("gate").isin([g for g, (k, _, _) in found.items() if k == kind]) & F.col("ids").isNotNull(), F.col("ids")).otherwise(nothing) for kind in ("analyses", "artifacts", "insights")}
    status = first_match([(F.col("ids").isNull(), "PASS"), (F.col("gate") == "REVIEW_DECISION", "FAIL")], "WARN")
    return out.select("run_id", "gate", status.alias("status"), *[v.alias(k) for k, v in lists.items()])


def normalised_claims(claims: DataFrame) -> DataFrame:
    """Claims held to what is stored for them, with what was taken back and why.

    ``claims`` has analysis_id, insight_id, insight_key, insight_type, certainty, confidence, description, given, when_, then_,
    n_evidence and n_related.  Of claims of an analysis with one key all but that with the least identifier get an error.
    """
    said, c = F.col("insight_type"), F.col("certainty")
    spelled = [F.lower("description").contains(w) for w in ("given:", "when:", "then:")]
    parts = [F.coalesce(F.col(k) != "", F.lit(False)) for k in ("given", "when_", "then_")]
    testable = reduce(Column.__and__, parts) | F.coalesce(reduce(Column.__and__, spelled), F.lit(False))
    vague = (said == "QA_SCENARIO") & ~testable
    open_ = said.isin("QUESTION", "UNKNOWN") | vague
    out = claims.withColumn("new_type", F.when(vague, "UNKNOWN").otherwise(said)).withColumn("c1", F.when(open_, "UNKNOWN").otherwise(c))
    untraced = F.col("new_type").isin("QA_SCENARIO", "ACCEPTANCE_CRITERIA") & (F.col("n_evidence") == 0) & (F.col("n_related") == 0)
    c1 = F.when(untraced, "UNKNOWN").otherwise(F.col("c1"))
    bare = first_match(
        [
            ((c1 == "EVIDENCED") & (F.col("n_evidence") == 0), "EVIDENCED_DOWNGRADED_NO_PERSISTED_EVIDENCE"),
            ((c1 == "INFERRED") & (F.col("n_evidence") == 0), "INFERRED_DOWNGRADED_NO_CONTEXTUAL_EVIDENCE"),
            ((c1 == "CONFLICTING") & (F.col("n_evidence") < 2), "CONFLICTING_DOWNGRADED_INSUFFICIENT_EVIDENCE"),
        ]
    )
    first = F.row_number().over(Window.partitionBy("analysis_id", "insight_key").orderBy("insight_id")) == 1
    return out.select(
        "insight_id",
        F.col("new_type").alias("insight_type"),
        F.when(bare.isNotNull(), "UNKNOWN").otherwise(c1).alias("certainty"),
        F.when(~open_, F.col("confidence")).alias("confidence"),
        F.when(vague, "QA_SCENARIO_DOWNGRADED_NOT_TESTABLE").alias("qa_integrity"),
        F.when(untraced, F.concat("new_type", F.lit("_DOWNGRADED_NO_TRACEABLE_CONTEXT"))).alias("traceability_integrity"),
        bare.alias("evidence_integrity"),
        F.when(untraced | bare.isNotNull(), c).alias("original_certainty"),
        F.when(~first, "AI_OUTPUT_SCHEMA_VALIDATION_FAILED").alias("error"),
    )


# What a domain pack may be called, its versions and states.
PACK_ID = r"^[a-z][a-z0-9-]*$"
SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$"
PACK_STATES = ["STABLE", "PARTIAL", "EXPERIMENTAL"]


def catalogue_errors(entries: DataFrame) -> DataFrame:
    """(place, code, alias): what is wrong with the entries of a catalogue, which are read by place.

    ``entries`` has place, pack, version, status, aliases (an array), limits (how many are told) and explicit_only.  An alias
    belongs to the first pack and version that uses it; every further use in an entry is an error too.
    """
    name = F.concat_ws("@", "pack", "version")
    e = entries.withColumn("name", name)
    before = F.lag("name").over(Window.partitionBy("pack").orderBy("place"))
    again = F.row_number().over(Window.partitionBy("pack", "version").orderBy("place")) > 1
    codes = all_matches(
        [
            (F.size("aliases") == 0, "DOMAIN_PACK_ALIASES_REQUIRED"),
            (~F.col("pack").rlike(PACK_ID), "INVALID_DOMAIN_PACK_ID"),
            (~F.col("version").rlike(SEMVER), "INVALID_DOMAIN_PACK_VERSION"),
            (~F.col("status").isin(PACK_STATES), "INVALID_DOMAIN_PACK_STATUS"),
            ((F.col("status") == "PARTIAL") & (F.col("limits") == 0), "PARTIAL_DOMAIN_PACK_REQUIRES_KNOWN_LIMITS"),
            ((F.col("status") == "PARTIAL") & ~F.col("explicit_only"), "PARTIAL_DOMAIN_PACK_REQUIRES_EXPLICIT_SELECTION"),
            (F.col("before") != F.col("name"), "MULTIPLE_ACTIVE_DOMAIN_PACK_VERSIONS_UNSUPPORTED"),
            (F.col("again"), "DUPLICATE_DOMAIN_PACK_VERSION"),
        ]
    )
    whole = e.withColumn("before", before).withColumn("again", again).select("place", F.explode(codes).alias("code"), F.lit(None).cast("string").alias("alias"))
    used = e.select("place", "name", F.posexplode("aliases").alias("at", "alias")).withColumn("alias", F.lower(F.trim("alias")))
    # The owner by an aggregate that combines before the shuffle: an alias that everybody uses is no hot group.
    owner = used.groupBy("alias").agg(F.min_by("name", F.struct("place", "at")).alias("owner"))
    uses = used.groupBy("place", "name", "alias").agg(F.count(F.lit(1)).alias("n")).join(owner, "alias")
    wrong = uses.withColumn("wrong", F.col("n") - 1 + F.when(F.col("owner") != F.col("name"), F.col("n")).otherwise(0)).where("wrong > 0")
    twice = wrong.select("place", F.lit("DUPLICATE_DOMAIN_PACK_ALIAS").alias("code"), "alias", F.explode(F.array_repeat(F.lit(0), F.col("wrong").cast("int"))).alias("x")).drop("x")
    return whole.unionByName(twice)
