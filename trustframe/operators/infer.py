"""Rule inference over fact tables: forward chaining to a fixpoint, goals and explanations.

Facts are subject, relation, object and a probability ``state``. Every round joins the facts new in
the last round with all facts, so nothing is derived twice from the same premises; each round is
written to the checkpoint folder, so the plan stays short and a lost executor costs one round.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import truth
from trustframe.functions.session import cut_lineage
from trustframe.operators.knowledge import TRIPLE, Constraint, blocked

Triple = tuple[str, str, str]


@dataclass
class Rule:
    """``head`` follows from ``body``; terms that start with ? are variables."""

    name: str
    head: Triple
    body: list[Triple]
    confidence: float = 1.0


def transitivity(relation: str, confidence: float = 1.0) -> Rule:
    return Rule(f"transitivity_{relation}", ("?x", relation, "?z"),
                [("?x", relation, "?y"), ("?y", relation, "?z")], confidence)


def symmetry(relation: str, confidence: float = 1.0) -> Rule:
    return Rule(f"symmetry_{relation}", ("?y", relation, "?x"), [("?x", relation, "?y")], confidence)


def _premise(facts: DataFrame, pattern: Triple, place: int) -> DataFrame:
    """Facts that fit a pattern, with its variables as columns."""
    out, bound = facts, {}
    for column, term in zip(TRIPLE, pattern):
        if not term.startswith("?"):
            out = out.filter(F.col(column) == term)
        elif term in bound:
            out = out.filter(F.col(column) == F.col(bound[term]))
        else:
            bound[term] = column
    return out.select(*[F.col(c).alias(v) for v, c in bound.items()],
                      F.col("state").alias(f"s{place}"), F.col("steps").alias(f"n{place}"),
                      F.struct(*TRIPLE).alias(f"p{place}"))


def _bindings(rule: Rule, old: DataFrame, fresh: DataFrame, every: DataFrame) -> list[DataFrame]:
    """Joins of the body with at least one fresh premise, each combination once."""
    frames = []
    for at in range(len(rule.body)):
        joined = None
        for place, pattern in enumerate(rule.body):
            side = _premise(old if place < at else fresh if place == at else every, pattern, place)
            if joined is None:
                joined = side
                continue
            shared = [c for c in side.columns if c.startswith("?") and c in joined.columns]
            if not shared:
                raise ValueError(f"rule {rule.name}: order the body so that each premise shares a variable")
            joined = joined.join(side, shared)
        frames.append(joined)
    return frames


def _derive(rule: Rule, old: DataFrame, fresh: DataFrame, every: DataFrame) -> DataFrame:
    size = len(rule.body)
    states = [F.col(f"s{i}") for i in range(size)]
    state = truth.weaken(reduce(truth.conjoin, states), F.lit(rule.confidence))

    def term(t: str) -> Column:
        return F.col(f"`{t}`") if t.startswith("?") else F.lit(t)

    parts = [b.select(
        *[term(t).alias(c) for c, t in zip(TRIPLE, rule.head)], F.lit(rule.name).alias("rule"),
        F.array(*[F.col(f"p{i}") for i in range(size)]).alias("premises"),
        reduce(lambda a, c: a + c, [F.col(f"n{i}") for i in range(size)]).alias("steps"), state.alias("state"))
        for b in _bindings(rule, old, fresh, every)]
    return reduce(DataFrame.unionByName, parts)


def forward_chain(facts: DataFrame, rules: list[Rule], least: float = 0.1,
                  constraints: list[Constraint] | None = None) -> tuple[DataFrame, DataFrame]:
    """(all facts, derivations) at the fixpoint.

    In a round all derivations of a triple are OR-ed together, and into the fact if it is known
    already, once each. A new fact needs a TRUE or UNDECIDABLE probability of ``least`` and must
    not break a blocking constraint. ``steps`` is the fewest base facts a fact rests on. Facts that
    are FALSE are no premises. Of the states that a given triple has, the greatest is the premise;
    the others stay among the facts as they are. New facts are built from the terms of old ones, so
    the rounds end by themselves.
    """
    base = facts.groupBy(*TRIPLE).agg(F.max_by("state", F.struct("state")).alias("state"))
    others = facts.select(*TRIPLE, "state").distinct().join(
        base.withColumnRenamed("state", "best"), TRIPLE).filter("state <> best").select(
        *TRIPLE, "state", F.lit(1).cast("bigint").alias("steps"))
    every = cut_lineage(base.withColumn("steps", F.lit(1).cast("bigint")))
    fresh, old = every, every.limit(0)
    history: list[DataFrame] = []
    for number in itertools.count(1):
        usable = [f.filter(truth.collapse(F.col("state")) != "FALSE") for f in (old, fresh, every)]
        derived = cut_lineage(reduce(DataFrame.unionByName, [_derive(r, *usable) for r in rules]))
        if derived.isEmpty():
            break
        history.append(derived.withColumn("round", F.lit(number)))
        merged = derived.groupBy(*TRIPLE).agg(truth.disjoin_all(F.col("state")).alias("new_state"),
                                              F.min("steps").alias("new_steps"))
        both = cut_lineage(every.join(merged, TRIPLE, "full_outer"))
        known = both.filter(F.col("state").isNotNull()).select(
            *TRIPLE, F.when(F.col("new_state").isNull(), F.col("state"))
            .otherwise(truth.disjoin(F.col("state"), F.col("new_state"))).alias("state"),
            F.least("steps", "new_steps").alias("steps"))
        added = both.filter(F.col("state").isNull()).select(
            *TRIPLE, F.col("new_state").alias("state"), F.col("new_steps").alias("steps"))
        added = added.filter((F.col("state.p_true") >= least) | (F.col("state.p_und") >= least))
        if constraints:
            added = added.withColumn("probability", F.col("state")).filter(~blocked(constraints)).drop("probability")
        fresh, old = added, known
        if fresh.isEmpty():
            every = known
            break
        every = known.unionByName(added)  # both read the rows just written
    empty = every.sparkSession.createDataFrame(
        [], "subject string, relation string, object string, rule string, premises array<struct<subject:string,"
        "relation:string,object:string>>, steps bigint, state struct<p_true:double,p_false:double,p_und:double>, round int")
    return every.unionByName(others), reduce(DataFrame.unionByName, history) if history else empty


def prove(goals: DataFrame, facts: DataFrame) -> DataFrame:
    """Verdict per goal triple: proved, rejected or undecidable, with proof steps and score."""
    known = facts.select(*TRIPLE, truth.collapse(F.col("state")).alias("value"), "steps")
    out = goals.join(known, TRIPLE, "left")
    verdict = (F.when(F.col("value").isNull(), F.lit("undecidable")).when(F.col("value") == "FALSE", F.lit("rejected"))
               .otherwise(F.lit("proved")))
    out = out.withColumn("verdict", verdict)
    proved = F.col("verdict") == "proved"
    return out.select(*goals.columns, "verdict", F.when(proved, F.col("steps")).alias("proof_steps"),
                      F.when(proved, 1.0 / (1 + F.col("steps"))).otherwise(F.lit(0.0)).alias("score"))


def explain(targets: DataFrame, derivations: DataFrame) -> DataFrame:
    """Derivations below each target triple: (target, level, fact, rule, premises).

    A fact is explained where it is first met below its target, so circular derivations end.
    """
    heads = derivations.select(F.struct(*TRIPLE).alias("fact"), "rule", "premises")
    front = targets.select(F.struct(*TRIPLE).alias("target"), F.struct(*TRIPLE).alias("fact")).distinct()
    seen, levels = front, []
    for level in itertools.count():
        found = cut_lineage(front.join(heads, "fact").withColumn("level", F.lit(level)))
        if found.isEmpty():
            break
        levels.append(found)
        below = found.select("target", F.explode("premises").alias("fact")).distinct()
        front = cut_lineage(below.join(seen, ["target", "fact"], "left_anti"))
        seen = seen.unionByName(front)
    if not levels:
        return front.join(heads, "fact").withColumn("level", F.lit(0)).limit(0)
    return reduce(DataFrame.unionByName, levels)


# ---------------------------------------------------------------------------- goals first

def _ordered(rule: Rule, mask: str) -> list[Triple]:
    """The body in an order in which each premise shares a variable with the bound head or an earlier premise."""
    known = {t for t, m in zip(rule.head, mask) if m == "b" and t.startswith("?")}
    left, out = list(rule.body), []
    while left:
        fit = [p for p in left if known & set(p) or _ground(p)] or (left if not known else [])
        if not fit:
            raise ValueError(f"rule {rule.name}: a premise shares no variable with the head or other premises")
        out.append(fit[0])
        left.remove(fit[0])
        known |= {t for t in fit[0] if t.startswith("?")}
    return out


def _uses(rules: list[Rule]) -> tuple[list[tuple[Rule, str]], list[str]]:
    """Rules with the bound terms (b) of the triples they are asked for, starting from whole triples; and all masks."""
    found: list[tuple[str, str | None]] = [("bbb", None)]
    uses: list[tuple[Rule, str]] = []
    for mask, relation in found:  # grows while it is gone through
        for rule in rules:
            if relation is not None and not rule.head[1].startswith("?") and rule.head[1] != relation:
                continue
            if any(u is rule and m == mask for u, m in uses):
                continue
            uses.append((rule, mask))
            known = {t for t, m in zip(rule.head, mask) if m == "b"}
            for pattern in _ordered(rule, mask):
                asked = ("".join("b" if t in known or not t.startswith("?") else "f" for t in pattern),
                         None if pattern[1].startswith("?") else pattern[1])
                if asked not in found:
                    found.append(asked)
                known |= set(pattern)
    return uses, sorted({m for m, _ in found})


def _asked(demands: DataFrame, mask: str) -> DataFrame:
    """Demands that bind just the terms of ``mask``."""
    fits = [F.col(c).isNotNull() if m == "b" else F.col(c).isNull() for c, m in zip(TRIPLE, mask)]
    return demands.filter(reduce(lambda a, c: a & c, fits))


def _answer(rule: Rule, mask: str, demands: DataFrame, facts: DataFrame) -> list[DataFrame]:
    """What a rule asks of its premises for the demands of ``mask``, and the triples it then derives."""
    bound: dict[str, str] = {}
    asked = _asked(demands, mask)
    for column, term, m in zip(TRIPLE, rule.head, mask):
        if m == "b" and not term.startswith("?"):
            asked = asked.filter(F.col(column) == term)
        elif m == "b" and term in bound:
            asked = asked.filter(F.col(column) == F.col(bound[term]))
        elif m == "b":
            bound[term] = column
    joined = asked.select(F.lit(rule.name).alias("rule"), *[F.col(c).alias(v) for v, c in bound.items()]).distinct()

    def row(kind: str, terms: Triple) -> DataFrame:
        parts = [F.lit(t) if not t.startswith("?") else F.col(f"`{t}`") if t in joined.columns else F.lit(None)
                 for t in terms]
        return joined.select(F.lit(kind).alias("kind"), *[p.cast("string").alias(c) for p, c in zip(parts, TRIPLE)])

    out = []
    for pattern in _ordered(rule, mask):
        out.append(row("demand", pattern))
        side = _premise(facts, pattern, 0).withColumn("_met", F.lit(1)).drop("s0", "n0", "p0").distinct().drop("_met")
        shared = [c for c in side.columns if c in joined.columns]
        if shared:
            joined = joined.join(side, shared)
        elif _ground(pattern):
            joined = joined.join(side.limit(1), F.lit(True), "left_semi")
        else:  # nothing is bound yet, so any demand asks for all
            joined = side.join(joined.limit(1), F.lit(True), "left_semi").withColumn("rule", F.lit(rule.name))
    return [*out, row("fact", rule.head)]


def _ground(pattern: Triple) -> bool:
    """Whether a pattern has no variables."""
    return not any(t.startswith("?") for t in pattern)


def relevant(goals: DataFrame, facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``facts`` that any derivation of a goal may rest on.

    Goals are asked for first; a rule whose head fits what is asked asks for its premises in order, with the terms
    that the head and the earlier premises bind. Rounds end when nothing new is asked or found. Facts that nobody asks
    for meet no rule. Goals with a null term ask for nothing.
    """
    uses, masks = _uses(rules)
    base = facts.select(*TRIPLE, "state", F.lit(1).alias("steps"))
    whole = goals.select(*TRIPLE).dropna().select(F.lit("demand").alias("kind"), *TRIPLE, F.lit(0).alias("round"))
    known = cut_lineage(whole.distinct())
    for number in itertools.count(1):
        demands = known.filter("kind = 'demand'")
        derived = known.filter("kind = 'fact'").select(
            *TRIPLE, F.lit(None).cast(facts.schema["state"].dataType).alias("state"), F.lit(1).alias("steps"))
        every = base.unionByName(derived)
        parts = [part for rule, mask in uses for part in _answer(rule, mask, demands, every)]
        found = reduce(DataFrame.unionByName, parts).withColumn("round", F.lit(number))
        known = cut_lineage(known.unionByName(found).groupBy("kind", *TRIPLE).agg(F.min("round").alias("round")))
        if known.filter(F.col("round") == number).isEmpty():
            break
    demands = known.filter("kind = 'demand'")
    kept = []
    for mask in masks:
        names = [c for c, m in zip(TRIPLE, mask) if m == "b"]
        asked = _asked(demands, mask)
        kept.append(facts.join(asked.select(*names), names, "left_semi") if names else
                    facts.join(asked.limit(1), F.lit(True), "left_semi"))
    return reduce(DataFrame.unionByName, [k.select(*facts.columns) for k in kept]).distinct()


def prove_goals(goals: DataFrame, facts: DataFrame, rules: list[Rule], least: float = 0.1,
                constraints: list[Constraint] | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts as of ``prove``, proofs), computed from the facts that the goals need alone.

    A proof is a tree of rows: the goal's triple, ``level`` below it, ``fact``, and the ``rule`` and ``premises`` that
    give the fact; both are null for given facts. Of several derivations of a fact the one of the earliest round counts,
    then of the fewest base facts, then the least rule and premises. A given fact needs no derivation. States and steps
    are those of ``forward_chain`` over all facts, since every premise of what is asked for is asked for too.
    """
    needed = cut_lineage(relevant(goals, facts, rules))
    closure, derivations = forward_chain(needed, rules, least, constraints)
    best_state = closure.groupBy(*TRIPLE).agg(F.max_by(F.struct("state", "steps"), F.struct("state")).alias("best"))
    verdicts = cut_lineage(prove(goals, best_state.select(*TRIPLE, "best.state", "best.steps")))
    chosen = derivations.join(needed.select(*TRIPLE).distinct(), TRIPLE, "left_anti").groupBy(
        F.struct(*TRIPLE).alias("fact")).agg(F.min(F.struct("round", "steps", "rule", "premises")).alias("best"))
    chosen = cut_lineage(chosen.select("fact", "best.rule", "best.premises"))
    front = verdicts.filter("verdict = 'proved'").select(
        F.struct(*TRIPLE).alias("goal"), F.struct(*TRIPLE).alias("fact")).distinct()
    seen, levels = front, []
    for level in itertools.count():
        rows = cut_lineage(front.join(chosen, "fact", "left").withColumn("level", F.lit(level)))
        levels.append(rows)
        below = rows.select("goal", F.explode("premises").alias("fact")).distinct()
        front = cut_lineage(below.join(seen, ["goal", "fact"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return verdicts, reduce(DataFrame.unionByName, levels).select("goal.*", "level", "fact", "rule", "premises")
