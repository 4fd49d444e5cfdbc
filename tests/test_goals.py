"""Goals proved from the facts they need, against the closure of all facts."""

import random

from pyspark.sql import functions as F

from trustframe.functions import truth
from trustframe.operators import infer

RULES = [infer.transitivity("in", 0.9), infer.symmetry("near", 0.8),
         infer.Rule("close", ("?a", "close_to", "?c"), [("?a", "near", "?b"), ("?b", "in", "?c")], 0.9)]


def facts_of(spark, rows):
    frame = spark.createDataFrame(rows, "subject string, relation string, object string, t double")
    return frame.select("subject", "relation", "object", truth.state(F.col("t"), 1 - F.col("t"), F.lit(0.0)).alias("state"))


def plain(rows):
    return {(r.subject, r.relation, r.object): (r.verdict, r.proof_steps, round(r.score, 9)) for r in rows}


def test_verdicts_equal_the_closure_and_proofs_rest_on_facts(spark):
    draw = random.Random(5)
    edges = {(f"e{a}", "in", f"e{b}") for a, b in ((draw.randrange(7), draw.randrange(7)) for _ in range(6)) if a < b}
    edges |= {("h0", "near", "e1"), ("e2", "near", "h1"), ("far", "in", "away"), ("away", "in", "off")}
    given = facts_of(spark, [(*e, 0.95) for e in sorted(edges)] + [("e0", "in", "e6", 0.2)])
    wanted = [("e0", "in", "e6"), ("e0", "in", "e5"), ("h0", "close_to", "e6"), ("h1", "close_to", "e5"), ("h1", "near", "e2"),
              ("e1", "in", "e6"), ("e3", "in", "e0"), ("nobody", "in", "e1")]
    goals = spark.createDataFrame(wanted, "subject string, relation string, object string")
    closure, _ = infer.forward_chain(given, RULES)
    verdicts, proofs = infer.prove_goals(goals, given, RULES)
    assert plain(verdicts.collect()) == plain(infer.prove(goals, closure).collect())
    base = edges | {("e0", "in", "e6")}
    trees: dict = {}
    for r in proofs.collect():
        trees.setdefault((r.subject, r.relation, r.object), {})[tuple(r.fact)] = r
    proved = {(r.subject, r.relation, r.object) for r in verdicts.collect() if r.verdict == "proved"}
    assert set(trees) == proved and ("h1", "near", "e2") in proved
    for goal, rows in trees.items():
        assert rows[goal].level == 0
        for fact, r in rows.items():
            assert (r.rule is None) == (fact in base)
            assert all(tuple(p) in rows for p in r.premises or [])


def test_only_needed_facts_are_read(spark):
    given = facts_of(spark, [("a", "in", "b", 0.9), ("b", "in", "c", 0.9), ("x", "in", "y", 0.9), ("y", "in", "z", 0.9),
                             ("a", "likes", "b", 0.9)])
    goals = spark.createDataFrame([("a", "in", "c"), (None, "in", "z")], "subject string, relation string, object string")
    kept = {(r.subject, r.relation, r.object) for r in infer.relevant(goals, given, RULES[:1]).collect()}
    assert kept == {("a", "in", "b"), ("b", "in", "c")}


def test_no_goals(spark):
    given = facts_of(spark, [("a", "in", "b", 0.9)])
    goals = spark.createDataFrame([], "subject string, relation string, object string")
    verdicts, proofs = infer.prove_goals(goals, given, RULES[:1])
    assert verdicts.count() == 0 and proofs.count() == 0


def test_premises_without_bound_terms(spark):
    given = facts_of(spark, [("gate", "is", "open", 0.9), ("a", "in", "club", 0.9), ("b", "in", "club", 0.9), ("b", "likes", "club", 0.9),
                             ("c", "owns", "d", 0.9)])
    goals = spark.createDataFrame([("a", "member", "club")], "subject string, relation string, object string")
    whole = infer.Rule("member", ("?x", "member", "club"), [("gate", "is", "open"), ("?x", "in", "club")])
    kept = {tuple(r)[:3] for r in infer.relevant(goals, given, [whole]).collect()}
    assert kept == {("gate", "is", "open"), ("a", "in", "club")}
    busy = infer.Rule("busy", ("club", "is", "busy"), [("?x", "in", "?y"), ("?x", "likes", "?y")])
    goals = spark.createDataFrame([("club", "is", "busy")], "subject string, relation string, object string")
    kept = {tuple(r)[:3] for r in infer.relevant(goals, given, [busy]).collect()}
    assert kept == {("a", "in", "club"), ("b", "in", "club"), ("b", "likes", "club")}
