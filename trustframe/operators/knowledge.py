"""Fact tables: look-ups, matching of claims and actions to facts, consistency and ingestion.

A fact row has tenant_id, subject, relation, object, state (TRUE, FALSE, UNDECIDABLE) and confidence.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import fixed, text, truth
from trustframe.operators import guard, matching
from trustframe.operators.ordered import Running, running

TRIPLE = ["subject", "relation", "object"]


# ---------------------------------------------------------------------------- building facts

def facts_from_entries(entries: DataFrame) -> DataFrame:
    """Expand ontology entries into facts: concept, definition, related, facts, constraints, synonyms."""
    none = F.array().cast("array<string>")

    def fact(relation: str, obj: Column, kind: str, aliases: Column = none) -> Column:
        return text.record(relation=F.lit(relation), object=obj, fact_type=F.lit(kind), aliases=aliases)

    def each(column: str, relation: str, kind: str) -> Column:
        return F.transform(F.coalesce(column, none), lambda o: fact(relation, o, kind))

    head = F.array(fact("is_a", F.lit("concept"), "concept", F.coalesce("synonyms", none)),
                   fact("defined_as", F.col("definition"), "definition"))
    every = F.concat(head, each("related_concepts", "related_to", "fact"), each("facts", "has_fact", "fact"),
                     each("constraints", "constrained_by", "constraint"),
                     each("synonyms", "has_synonym", "synonym"))
    return entries.select(
        "tenant_id", "ontology_id", F.col("concept").alias("subject"), F.explode(every).alias("f"), "source",
        truth.confidence_score(F.col("confidence")).alias("confidence")).select(
        "tenant_id", "ontology_id", "subject", "f.relation", "f.object", "f.fact_type", "f.aliases",
        F.lit("TRUE").alias("state"), "source", "confidence")


def facts_from_search(hits: DataFrame, tenant: str) -> DataFrame:
    """Retrieved passages (content, source, relevance_score, document_id) as facts."""
    return hits.select(
        F.lit(tenant).alias("tenant_id"), F.lit("retrieved_evidence").alias("subject"),
        F.lit("supports").alias("relation"), F.col("content").alias("object"), F.lit("fact").alias("fact_type"),
        F.lit("TRUE").alias("state"), "source", F.col("relevance_score").alias("confidence"), "document_id")


def facts_from_states(triples: DataFrame, tenant: str) -> DataFrame:
    """Triples with a probability state as facts with its most likely value."""
    return triples.select(
        F.lit(tenant).alias("tenant_id"), *TRIPLE, F.lit("fact").alias("fact_type"),
        truth.collapse(F.col("state")).alias("state"), F.lit(1.0).alias("confidence"))


def split_valid(facts: DataFrame, tenant: str, ontology: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine): right tenant and ontology, known state, confidence and validity in order."""
    ok = (F.col("tenant_id") == tenant) & F.col("state").isin("TRUE", "FALSE", "UNDECIDABLE") & F.col(
        "confidence").between(0, 1)
    if ontology:
        ok = ok & (F.coalesce("ontology_id", F.lit(ontology)) == ontology)
    if "valid_from" in facts.columns:
        ok = ok & (F.col("valid_from").isNull() | F.col("valid_until").isNull()
                   | (F.col("valid_until") >= F.col("valid_from")))
    ok = F.coalesce(ok, F.lit(False))
    return facts.filter(ok), facts.filter(~ok)


# ---------------------------------------------------------------------------- look-ups

def find(facts: DataFrame, subject: str | None = None, relation: str | None = None,
         obj: str | None = None, state: str | None = None, fact_type: str | None = None,
         tenant: str | None = None) -> DataFrame:
    """Facts that fit a pattern, of a type and a tenant if given.

    A ``?name`` term becomes a column; a repeated name an equality.
    """
    out, bound = facts, {}
    for column, term in (("subject", subject), ("relation", relation), ("object", obj)):
        if term is None:
            continue
        if not term.startswith("?"):
            out = out.filter(F.col(column) == term)
        elif term in bound:
            out = out.filter(F.col(column) == F.col(bound[term]))
        else:
            bound[term] = column
    for column, value in (("state", state), ("fact_type", fact_type), ("tenant_id", tenant)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out.select("*", *[F.col(c).alias(v[1:]) for v, c in bound.items()]) if bound else out


def neighbourhood(facts: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """Facts that touch any of ``nodes`` (node); 'both' is the union of in and out."""
    out = facts.join(nodes.select(F.col("node").alias("subject")), "subject", "left_semi").withColumn(
        "direction", F.lit("out"))
    into = facts.join(nodes.select(F.col("node").alias("object")), "object", "left_semi").withColumn(
        "direction", F.lit("in"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def contradictory(states: DataFrame) -> DataFrame:
    """Facts whose probability state collapses to UNDECIDABLE."""
    return states.filter(truth.collapse(F.col("state")) == "UNDECIDABLE")


def statistics(facts: DataFrame) -> DataFrame:
    """Counts of facts, nodes, edges, states and relations as (metric, name, value)."""
    grouped = (facts.groupingSets([[], ["state"], ["relation"]], "state", "relation")
               .agg(F.count("*").alias("value"), F.grouping_id().alias("level")))
    rows = grouped.select(
        F.when(F.col("state").isNotNull(), F.lit("state")).when(F.col("relation").isNotNull(), F.lit("relation"))
        .otherwise(F.lit("facts")).alias("metric"),
        F.coalesce("state", "relation", F.lit("all")).alias("name"), "value")
    nodes = (facts.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
             .agg(F.count("*").alias("value")).select(F.lit("nodes").alias("metric"), F.lit("all").alias("name"), "value"))
    edges = (facts.select("subject", "object").distinct().agg(F.count("*").alias("value"))
             .select(F.lit("edges").alias("metric"), F.lit("all").alias("name"), "value"))
    return rows.unionByName(nodes).unionByName(edges)


# ---------------------------------------------------------------------------- claims against facts

def scope_of(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that two tables must agree on: the tenant, and the ontology where both name one.

    If only one of them names its tenants, a join could cross tenants, so that is an error.
    """
    if ("tenant_id" in left.columns) != ("tenant_id" in right.columns):
        raise ValueError("both tables or neither must have a tenant_id")
    return [c for c in ("tenant_id", "ontology_id") if c in left.columns and c in right.columns]


def scoped(words: Column, scope: list[str]) -> Column:
    """Words marked with their scope, so that equal words of different scopes never meet."""
    marks = [F.coalesce(F.col(c), F.lit("\x00")) for c in scope]
    return F.transform(words, lambda w: F.concat_ws("\x1f", *marks, w)) if scope else words


def fact_words(facts: DataFrame) -> Column:
    parts = [*TRIPLE] + (["aliases"] if "aliases" in facts.columns else [])
    joined = [F.array_join(c, " ") if c == "aliases" else F.col(c) for c in parts]
    return text.token_set(F.concat_ws(" ", *joined), fixed.OVERLAP_STOPWORDS)


def relevant_facts(claims: DataFrame, facts: DataFrame, share: float = 0.35) -> DataFrame:
    """Verdict of the facts that cover at least ``share`` of a claim's words, per ``claim_key``.

    ``claims`` has claim_key and words; only facts of the claim's tenant and ontology count. Facts are
    reduced to distinct word sets first, each with what its copies say, so copies neither multiply
    pairs nor lose a verdict.
    """
    scope = scope_of(claims, facts)
    claims = claims.withColumn("words", scoped(F.col("words"), scope))
    says = _said(facts, scope)
    lefts = claims.select(matching.set_key(F.col("words")).alias("key"), "words")
    pairs = matching.match_sets(lefts, says, matching.share_needed(share))
    met = (pairs.join(says.select(F.col("key").alias("right_key"), "against", "supports"), "right_key")
           .groupBy("left_key").agg(F.max("against").alias("against"), F.max("supports").alias("supports"),
                                    F.count("*").alias("facts")))
    keyed = claims.select("claim_key", matching.set_key(F.col("words")).alias("left_key"))
    out = keyed.join(met, "left_key")
    return out.select(
        "claim_key", "facts",
        F.when(F.col("against").isNotNull(), F.lit("FALSE")).when(F.col("supports").isNotNull(), F.lit("TRUE"))
        .otherwise(F.lit("UNDECIDABLE")).alias("decision"),
        F.coalesce("against", "supports", F.lit(0.0)).alias("confidence"))


def _said(facts: DataFrame, scope: list[str]) -> DataFrame:
    """What the copies of each word set of facts say against and for it."""
    sides = facts.withColumn("words", scoped(fact_words(facts), scope)).withColumn("key", matching.set_key(F.col("words")))
    return sides.groupBy("key").agg(
        F.any_value("words").alias("words"),
        F.max(F.when(F.col("state") == "FALSE", F.col("confidence"))).alias("against"),
        F.max(F.when(F.col("state") == "TRUE", F.col("confidence"))).alias("supports"))


def with_relevant_facts(claims: DataFrame, words: Column, facts: DataFrame, share: float = 0.35) -> DataFrame | None:
    """``claims`` with the struct ``_met``: what ``relevant_facts`` finds against and for the ``words`` (not null) of each row.

    The facts go to the claims, so no claim is moved, and copies of a claim are decided each by itself. Nothing is
    returned if the facts make more than one block of ``matching``.
    """
    scope = scope_of(claims, facts)
    said = _said(facts, scope)
    held = matching.held_rights(said.withColumns({c: F.col(c).cast("double") for c in ("against", "supports")}))
    if held is None:
        return None
    met = matching.greatest_met(F.col("_words"), matching.share_needed(share), held, ["against", "supports"])
    return claims.withColumn("_words", scoped(words, scope)).withColumn("_met", met).drop("_words")


def contradicts(claim_negated: Column, constraint_negated: Column, claim_words: Column, constraint_words: Column) -> Column:
    """Two shared words and opposite polarity."""
    return (F.size(F.array_intersect(claim_words, constraint_words)) >= 2) & (claim_negated != constraint_negated)


def ontology_check(claims: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdict of the ontology on each claim that names one of its concepts.

    ``claims`` has claim_key and claim (distinct texts); ``entries`` has concept, synonyms, facts,
    constraints. Claims without a concept have no row: they are UNDECIDABLE with confidence 0. Only
    entries of the claim's tenant and ontology count.
    """
    scope = scope_of(claims, entries)
    texts = claims.select(F.col("claim_key").alias("text_key"), F.lower("claim").alias("body"), *scope)
    terms = entries.select("concept", *scope, F.explode(F.array_distinct(F.transform(
        F.concat(F.array("concept"), F.coalesce("synonyms", F.array().cast("array<string>"))),
        lambda t: F.lower(t)))).alias("term"))
    named = (matching.contained_terms(texts, terms).join(terms, "term")
             .join(texts.select("text_key", *scope), ["text_key", *scope]).select("text_key", "concept", *scope).distinct())
    # the word sets of an entry are made once, not once per pair
    prepared = entries.select(
        "concept", *scope, F.transform("facts", lambda f: text.space_word_set(f, fixed.SIMILARITY_STOPWORDS)).alias("fact_words"),
        F.transform("constraints", lambda c: text.record(
            negated=text.contains_any(F.lower(c), fixed.CONSTRAINT_NEGATIONS),
            words=text.space_word_set(c, fixed.CONSTRAINT_NEGATIONS))).alias("rules"))
    pairs = (named.join(texts, ["text_key", *scope]).join(prepared, ["concept", *scope])
             .withColumn("negated", text.contains_any(F.col("body"), fixed.CONSTRAINT_NEGATIONS))
             .withColumn("words", text.space_word_set(F.col("body"), fixed.SIMILARITY_STOPWORDS))
             .withColumn("plain", text.space_word_set(F.col("body"), fixed.CONSTRAINT_NEGATIONS)))
    similar = F.filter(F.transform("fact_words", lambda w: text.jaccard(F.col("words"), w)), lambda s: s > 0.5)
    against = F.filter("rules", lambda r: contradicts(F.col("negated"), r["negated"], F.col("plain"), r["words"]))
    sums = pairs.select("text_key", "concept", similar.alias("similar"), F.size(against).alias("against"))
    per = sums.groupBy(F.col("text_key").alias("claim_key")).agg(
        F.count("*").alias("concepts"), F.sum(F.size("similar")).alias("supporting"),
        F.sum(F.aggregate("similar", F.lit(0.0), lambda a, x: a + x)).alias("total"),
        F.sum("against").alias("contradicting"))
    average = F.col("total") / F.col("supporting")
    return per.select(
        "claim_key", "concepts", "supporting", "contradicting",
        F.when(F.col("contradicting") > 0, F.lit("FALSE")).when(F.col("supporting") > 0, F.lit("TRUE"))
        .otherwise(F.lit("UNDECIDABLE")).alias("decision"),
        F.when(F.col("contradicting") > 0, F.lit(0.8))
        .when(F.col("supporting") > 0, F.least(F.lit(0.9), average + 0.2)).otherwise(F.lit(0.3)).alias("confidence"))


# ---------------------------------------------------------------------------- actions and policies

def action_check(actions: DataFrame, policies: DataFrame) -> DataFrame:
    """Decide actor/action/resource(/purpose) requests: denied beats allowed beats missing.

    A policy field that is empty or ``*`` accepts any word of the policy's own text. The distinct
    requests are decided once, by an equi-join on tenant, actor and action, and joined back.
    """
    scope = scope_of(actions, policies)
    own = text.token_set(F.concat_ws(" ", *TRIPLE), fixed.OVERLAP_STOPWORDS)

    def accepted(field: str) -> Column:
        open_field = F.coalesce(F.col(field), F.lit("")).isin("", "*")
        return F.when(open_field, own).otherwise(F.array(F.lower(field)))

    rules = (policies.select(
        *scope, "state", "confidence", F.explode(accepted("actor")).alias("k_actor"), accepted("action").alias("actions"),
        accepted("resource").alias("resources"), F.lower("purpose").alias("p_purpose"))
        .select("*", F.explode("actions").alias("k_action")).drop("actions"))
    fields = [*scope, "actor", "action", "resource", "purpose"]
    asked = actions.select(*fields).distinct()
    keyed = asked.select("*", F.lower("actor").alias("k_actor"), F.lower("action").alias("k_action"))
    fits = F.array_contains("resources", F.lower("resource")) & (
        F.coalesce("p_purpose", F.lit("")).isin("", "*") | (F.coalesce("purpose", F.lit("")) == "")
        | (F.lower("purpose") == F.col("p_purpose")))
    met = (keyed.join(rules, [*scope, "k_actor", "k_action"]).filter(fits).groupBy(*fields).agg(
        F.max(F.when(F.col("state") == "FALSE", F.col("confidence"))).alias("denied"),
        F.max(F.when(F.col("state") == "TRUE", F.col("confidence"))).alias("allowed")))
    condition = reduce(operator.and_, [F.col(f"a.{f}").eqNullSafe(F.col(f"m.{f}")) for f in fields])
    out = actions.alias("a").join(met.alias("m"), condition, "left").select("a.*", "m.denied", "m.allowed")
    denied, allowed = F.col("denied").isNotNull(), F.col("allowed").isNotNull()

    def pick(no: str, yes: str, missing: str) -> Column:
        return F.when(denied, F.lit(no)).when(allowed, F.lit(yes)).otherwise(F.lit(missing))

    return out.select(
        *actions.columns, pick("FALSE", "TRUE", "UNDECIDABLE").alias("decision"),
        pick("block", "allow", "escalate").alias("recommended_action"),
        pick("policy_denied", "policy_allowed", "policy_missing").alias("status"),
        F.coalesce("denied", "allowed", F.lit(0.0)).alias("confidence"))


@dataclass
class TextPolicy:
    """A policy on texts: a pattern, or words that a third of the text must share."""

    policy_id: str
    state: str
    confidence: float
    subject: str
    object: str
    pattern: str | None = None
    scope: str | None = None


def policy_check(frame: DataFrame, column: str, policies: list[TextPolicy], rules: list[guard.Rule],
                 scope: str = "output") -> DataFrame:
    """Decide texts by compliance rules and text policies, all as columns of one scan."""
    scanned = guard.scan(frame, column, rules, scope=scope)
    scanned = scanned.withColumn("_words", text.token_set(F.col(column), fixed.OVERLAP_STOPWORDS))
    denies, allows = F.lit(False), F.lit(None).cast("double")
    for p in policies:
        if p.scope and p.scope != scope:
            continue
        own = F.array_distinct(F.array_except(
            text.tokens(F.lit(f"{p.subject} {p.object}")), text.words_array(fixed.OVERLAP_STOPWORDS)))
        hit = text.overlap_share(F.col("_words"), own) >= 0.35
        if p.pattern:
            hit = F.rlike(F.col(column), F.lit("(?i)" + p.pattern)) | hit
        if p.state == "FALSE":
            denies = denies | hit
        elif p.state == "TRUE":
            allows = F.greatest(allows, F.when(hit, F.lit(p.confidence)))
    scanned = scanned.withColumn("_denied", denies | guard.blocking(F.col("violations"))).withColumn("_allows", allows)
    review = F.size("violations") > 0
    return (scanned
            .withColumn("decision", F.when(F.col("_denied"), F.lit("FALSE")).when(review, F.lit("UNDECIDABLE"))
                        .otherwise(F.lit("TRUE")))
            .withColumn("recommended_action", F.when(F.col("_denied"), F.lit("block")).when(review, F.lit("warn"))
                        .otherwise(F.lit("allow")))
            .withColumn("confidence", F.when(F.col("_denied"), F.lit(1.0)).when(review, F.lit(0.5))
                        .otherwise(F.coalesce("_allows", F.lit(1.0))))
            .drop("_words", "_denied", "_allows"))


# ---------------------------------------------------------------------------- consistency

def symbolic_contradictions(hypotheses: DataFrame, facts: DataFrame) -> DataFrame:
    """Hypotheses whose triple is stored as FALSE, with the first such fact."""
    keys = [*scope_of(hypotheses, facts), *TRIPLE]
    false = facts.filter("state = 'FALSE'").groupBy(*keys).agg(F.min("fact_id").alias("fact_id"))
    return hypotheses.join(false, keys)


def non_monotonic(hypotheses: DataFrame, order: list[str], time: str) -> DataFrame:
    """(subject, relation) series whose time steps back, in input order, with the number of steps."""
    ordered = running(hypotheses, ["subject", "relation"], order, {"earlier": Running("previous", F.col(time))})
    return (ordered.groupBy("subject", "relation")
            .agg(F.count_if(F.col("earlier") > F.col(time)).alias("back_steps"), F.count("*").alias("points"))
            .filter("back_steps > 0"))


def missing_inverse(hypotheses: DataFrame, facts: DataFrame) -> DataFrame:
    """Symmetric hypotheses whose inverse is neither a hypothesis nor a TRUE fact."""
    symmetric = F.col("relation").isin(fixed.SYMMETRIC_RELATIONS)
    seen = hypotheses.select(*TRIPLE).filter(symmetric).distinct()
    known = seen.unionByName(facts.filter("state = 'TRUE'").filter(symmetric).select(*TRIPLE)).select(
        F.col("object").alias("subject"), "relation", F.col("subject").alias("object"))
    return seen.join(known, TRIPLE, "left_anti")


def cascade_verdict(hypotheses: DataFrame, facts: DataFrame, order: list[str], time: str, strict: bool = False) -> DataFrame:
    """One row: counts of each kind of issue and the verdict."""
    def count(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))

    joined = (count(symbolic_contradictions(hypotheses, facts), "contradictions")
              .join(count(non_monotonic(hypotheses, order, time), "time_issues"), "one")
              .join(count(missing_inverse(hypotheses, facts), "inverse_issues"), "one").drop("one"))
    warns = (F.col("time_issues") > 0) | (F.col("inverse_issues") > 0)
    return joined.withColumn("verdict", F.when(F.col("contradictions") > 0, F.lit("blocked")).when(
        warns, F.lit("blocked" if strict else "warn")).otherwise(F.lit("ok")))


@dataclass
class Constraint:
    """A forbidden triple pattern. ``condition`` is an extra SQL predicate on the fact."""

    name: str
    kind: str
    severity: str
    action: str
    subject: str
    relation: str
    object: str
    condition: str | None = None


def default_constraints(protected_system: str = "protected_system") -> list[Constraint]:
    conditions = {
        "sensitive_data_protection": "contains(lower(object), 'sensitive')",
        "controlled_self_modification": f"object = '{protected_system}'",
        "misinformation_prevention": "contains(lower(object), 'false') or contains(lower(object), 'misinformation')",
        "personal_data_protection":
            f"rlike(object, r'{fixed.PERSONAL_NUMBERS}') or rlike(lower(object), '{'|'.join(fixed.PERSONAL_TERMS)}')",
    }
    return [Constraint(*row, conditions.get(row[0])) for row in fixed.CONSTRAINTS]


def violates(constraint: Constraint) -> Column:
    """Whether a fact with a ``probability`` state breaks the constraint.

    A critical one already applies from a TRUE probability of 0.3, the others when TRUE leads. Each
    variable matches anything on its own, so a repeated variable is not an equality.
    """
    fits = F.lit(True)
    for column in TRIPLE:
        term = getattr(constraint, column)
        if not term.startswith("?"):
            fits = fits & (F.col(column) == term)
    if constraint.condition:
        fits = fits & F.coalesce(F.expr(constraint.condition), F.lit(False))
    p = F.col("probability")
    return fits & (p["p_true"] >= 0.3 if constraint.severity == "critical" else truth.collapse(p) == "TRUE")


def constraint_violations(facts: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """One row per violated constraint of each fact; facts carry a ``probability`` state."""
    found = F.filter(F.array(*[F.when(violates(c), text.record(
        constraint=F.lit(c.name), kind=F.lit(c.kind), severity=F.lit(c.severity), action=F.lit(c.action)))
        for c in constraints]), lambda v: v.isNotNull())
    return text.each(facts, facts.columns, found, "v").select(*facts.columns, "v.*")


def blocked(constraints: list[Constraint]) -> Column:
    out = F.lit(False)
    for c in constraints:
        if c.action == "block":
            out = out | violates(c)
    return out


# ---------------------------------------------------------------------------- adding facts

def accept_facts(new: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What becomes of new facts: the first of each (triple, state) is added unless it is known.

    Adds ``accepted`` and ``conflict`` (the triple also has another state). One aggregation per
    triple and state, so copies collapse before the shuffle.
    """
    tagged = (new.select(*keys, "state", F.col(order).alias("at"), F.lit(False).alias("known"))
              .unionByName(existing.select(*keys, "state", F.lit(None).cast(new.schema[order].dataType).alias("at"),
                                           F.lit(True).alias("known"))))
    per_state = tagged.groupBy(*keys, "state").agg(F.min("at").alias("first"), F.max("known").alias("known"))
    states = per_state.groupBy(*keys).agg(F.count("*").alias("states"))
    verdict = per_state.join(states, keys).select(
        *keys, "state", F.when(~F.col("known"), F.col("first")).alias("first"), (F.col("states") > 1).alias("conflict"))
    return new.join(verdict, [*keys, "state"]).withColumn(
        "accepted", F.coalesce(F.col(order) == F.col("first"), F.lit(False))).drop("first")


def ingest_counts(entries: DataFrame, existing: DataFrame, source: str) -> DataFrame:
    """Imported, skipped and conflicting entries per source.

    An entry with a missing part, or known with the same state, is skipped; one known with another
    state only is a conflict.
    """
    known = existing.groupBy(*TRIPLE).agg(F.collect_set("state").alias("states"))
    whole = F.lit(True)
    for c in TRIPLE:
        whole = whole & (F.coalesce(c, F.lit("")) != "")
    joined = entries.withColumn("state", F.coalesce("state", F.lit("TRUE"))).join(known, TRIPLE, "left")
    fate = (F.when(~whole, F.lit("skipped")).when(F.col("states").isNull(), F.lit("imported"))
            .when(F.array_contains("states", F.col("state")), F.lit("skipped")).otherwise(F.lit("conflict")))
    return joined.withColumn("fate", fate).groupBy(source).agg(*[
        F.count_if(F.col("fate") == n).alias(n) for n in ("imported", "skipped", "conflict")])
