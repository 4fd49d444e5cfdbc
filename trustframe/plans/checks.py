"""Composite checks: several scans and joins folded into one decision per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.functions import fixed, text, truth
from trustframe.functions.session import cut_lineage
from trustframe.operators import ground, guard, knowledge, quality


def claim_check(claims: DataFrame, rules: list[guard.Rule], facts: DataFrame | None = None,
                entries: DataFrame | None = None, searched: DataFrame | None = None,
                evidence: str | None = None) -> DataFrame:
    """Decide claims; the first source with a verdict wins.

    The order is compliance, search, facts, ontology entries, given evidence, none. ``claims`` has
    claim and claim_key (the same for equal texts of one tenant) and, like the sources, tenant_id and
    ontology_id if there are several. ``searched`` is the best (claim_key, score) of a
    search; with a search every claim gets its verdict. ``evidence`` names a column with the mean
    score of evidence given with the claim. Each source is asked only about claims that the sources before it
    left open. Rules, and facts that make one block, are asked in the claim's own row; search, ontology entries
    and more facts are asked about distinct claims.
    """
    if searched is None and entries is None:
        decided = _decided_in_place(claims, rules, facts)
        if decided is not None:
            return _finish(decided, evidence)
    scope = [c for c in ("tenant_id", "ontology_id") if c in claims.columns]
    distinct = claims.select("claim_key", "claim", *scope).distinct()
    scanned = guard.scan(distinct, "claim", rules).select(
        "claim_key", "claim", *scope, guard.blocking(F.col("violations")).alias("blocked"))
    scanned = cut_lineage(scanned)  # scanned once, read by every source below
    blocked = F.col("blocked")
    verdicts = scanned.filter(blocked).select(
        "claim_key", F.lit("compliance").alias("source"), F.lit("FALSE").alias("decision"), F.lit(1.0).alias("confidence"))
    still_open = scanned.filter(~blocked).select("claim_key", "claim", *scope)
    if searched is not None:
        v = truth.search_verdict(F.col("score"))
        found = still_open.join(searched, "claim_key", "left").withColumn("v", v).select(
            "claim_key", F.lit("search").alias("source"),
            F.when(F.col("v.status") == "verified", F.lit("TRUE")).when(F.col("v.status") == "contradicted", F.lit("FALSE"))
            .otherwise(F.lit("UNDECIDABLE")).alias("decision"), F.col("v.confidence").alias("confidence"))
        return _finish(claims.join(verdicts.unionByName(found), "claim_key", "left"), evidence)
    if facts is not None:
        words = still_open.select("claim_key", *scope, text.token_set(F.col("claim"), fixed.OVERLAP_STOPWORDS).alias("words"))
        met = knowledge.relevant_facts(words, facts).filter("decision <> 'UNDECIDABLE'")
        verdicts = verdicts.unionByName(met.select("claim_key", F.lit("ontology").alias("source"), "decision", "confidence"))
        if entries is not None:
            still_open = still_open.join(met, "claim_key", "left_anti")
    if entries is not None:
        met = knowledge.ontology_check(still_open, entries)
        verdicts = verdicts.unionByName(met.select("claim_key", F.lit("entries").alias("source"), "decision", "confidence"))
    return _finish(claims.join(verdicts, "claim_key", "left"), evidence)


def _decided_in_place(claims: DataFrame, rules: list[guard.Rule], facts: DataFrame | None) -> DataFrame | None:
    """Claims with the source, decision and confidence of rules and facts; nothing if the facts are too many.

    No claim is moved or written, so a copy of a claim costs a scan instead of a place in a shuffle.
    """
    keyed = F.col("claim_key").isNotNull()  # a claim without a key has no verdict
    violations, blocked = F.col("_violations"), F.col("_blocked")
    out = guard.scan(claims, "claim", rules, out="_violations").withColumn(
        "_blocked", keyed & guard.blocking(violations)).drop("_violations")
    decision = F.when(blocked, F.lit("FALSE"))
    confidence = F.when(blocked, F.lit(1.0))
    source = F.when(blocked, F.lit("compliance"))
    if facts is not None:
        none = F.array().cast("array<string>")
        words = F.when(keyed & ~blocked, text.token_set(F.col("claim"), fixed.OVERLAP_STOPWORDS))
        out = knowledge.with_relevant_facts(out, F.coalesce(words, none), facts)
        if out is None:
            return None
        against, supports = F.col("_met.against"), F.col("_met.supports")
        decision = decision.when(against.isNotNull(), F.lit("FALSE")).when(supports.isNotNull(), F.lit("TRUE"))
        confidence = confidence.otherwise(F.coalesce(against, supports))
        source = source.when(against.isNotNull() | supports.isNotNull(), F.lit("ontology"))
    rest = [c for c in claims.columns if c != "claim_key"]
    return out.select("claim_key", *rest, source.alias("source"), decision.alias("decision"), confidence.alias("confidence"))


def _finish(out: DataFrame, evidence: str | None) -> DataFrame:
    """Claims with the verdict found, if any, and what holds for those without."""
    given = F.col(evidence).isNotNull() if evidence else F.lit(False)
    score = F.col(evidence) if evidence else F.lit(None).cast("double")
    missing = F.col("source").isNull()
    decision = F.when(missing & given, F.lit("TRUE")).otherwise(F.coalesce("decision", F.lit("UNDECIDABLE")))
    return (out.withColumn("decision", decision)
            .withColumn("confidence", F.when(missing & given, score).otherwise(F.coalesce("confidence", F.lit(0.0))))
            .withColumn("source", F.when(missing & given, F.lit("evidence")).otherwise(F.coalesce("source", F.lit("none"))))
            .withColumn("recommended_action", F.when(F.col("decision") == "TRUE", F.lit("allow"))
                        .when(F.col("decision") == "FALSE", F.lit("block")).otherwise(F.lit("abstain"))))


def answer_check(answers: DataFrame, checked: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    """Fold checked claims (keys, pos, claim, decision, confidence) into one decision per answer.

    Claims of one place in one answer are taken by their text. ``unique`` says that there are none, so that no text
    is moved.
    """
    claim = F.lit(None).cast("string") if unique else F.col("claim")
    labelled = checked.select(
        *keys, "pos", claim.alias("claim"), truth.decision_label(F.col("decision")).alias("label"), "confidence",
        ((F.col("pos") > 0) & text.depends_on_previous(F.col("claim"))).alias("depends"))
    per = ground.propagate_chain(labelled, keys).groupBy(*keys).agg(
        F.count("*").alias("claims"), F.bool_or(F.col("label") == "contradicted").alias("contradicted"),
        F.bool_or(F.col("label") == "unsupported").alias("unsupported"), F.min("confidence").alias("confidence"))
    out = answers.join(per, keys, "left")

    def pick(none: str, false: str, partly: str, true: str):
        return (F.when(F.col("claims").isNull(), F.lit(none)).when(F.col("contradicted"), F.lit(false))
                .when(F.col("unsupported"), F.lit(partly)).otherwise(F.lit(true)))

    return out.select(
        *answers.columns, F.coalesce("claims", F.lit(0)).alias("claims"),
        pick("UNDECIDABLE", "FALSE", "UNDECIDABLE", "TRUE").alias("decision"),
        pick("abstain", "block", "retry", "allow").alias("recommended_action"),
        pick("unsupported", "contradicted", "partially_unsupported", "supported").alias("status"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def full_cycle(pairs: DataFrame, rules: list[guard.Rule], topics: list[str] | None = None) -> DataFrame:
    """Input gate on ``question``, then output validation of ``answer``; both are projections."""
    gated = guard.shield(pairs, "question").select(
        *pairs.columns, F.col("decision").alias("input_decision"), F.col("allowed").alias("input_allowed"),
        F.col("risk").alias("input_risk"))
    out = quality.assess(guard.scan(gated, "answer", rules), "question", "answer", violations="violations",
                         topics=topics)
    passed = F.col("input_allowed")
    return out.select(
        *pairs.columns, "input_decision", "input_risk",
        F.when(~passed, F.lit("input")).when(~F.col("is_valid"), F.lit("output")).otherwise(F.lit("none"))
        .alias("blocked_at"),
        F.when(passed, F.col("decision")).alias("output_decision"),
        F.when(passed, F.col("retry_guidance")).alias("retry_guidance"))
