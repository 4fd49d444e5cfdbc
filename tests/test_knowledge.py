import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustframe.functions import text, truth
from trustframe.operators import infer, knowledge, matching, versions
from trustframe.plans import checks
from trustframe.operators import guard

TRIPLE = "subject string, relation string, object string"


def word_sets(rng, n, pool):
    # one word stands in nearly every set, and a third of the sets are copies
    sets = [["hot", *rng.sample(pool, rng.randrange(1, 6))] for _ in range(n)]
    return sets + [sets[0]] * (n // 2)


@pytest.mark.parametrize("share", [0.35, 0.6, 1.0])
def test_match_sets_brute_force(spark, share):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(12)]
    left, right = word_sets(rng, 40, pool), word_sets(rng, 30, pool)

    def frame(sets):
        df = spark.createDataFrame([(s,) for s in sets], "words array<string>")
        return df.withColumn("key", matching.set_key(F.col("words")))

    got = matching.match_sets(frame(left), frame(right), matching.share_needed(share)).collect()
    want = {(tuple(sorted(a)), tuple(sorted(b))): len(set(a) & set(b)) for a in left for b in right
            if len(set(a) & set(b)) >= share * len(a) - 1e-9}
    assert len(got) == len(want)
    assert sorted(r["overlap"] for r in got) == sorted(want.values())


@pytest.mark.parametrize("hot", [True, False])
def test_match_rows_over_several_blocks(spark, monkeypatch, hot):
    """Right sets in several blocks give each pair once, whether by blocks or by rare words; keys may be any type."""
    monkeypatch.setattr(matching, "RIGHT_ROWS", 5)
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(12 if hot else 400)]
    left, right = ([[*rng.sample(pool, rng.randrange(1, 6)), *(["hot"] if hot else [])] for _ in range(n)] for n in (50, 30))
    left += [[], [None, "hot", "w1"]]
    lefts = spark.createDataFrame([*enumerate(left), (0, left[0]), (None, left[1])], "key int, words array<string>")
    rights = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(right)], "key string, words array<string>")
    ways = []
    monkeypatch.setattr(matching, "_by_blocks", lambda *a, own=matching._by_blocks: ways.append("blocks") or own(*a))
    got = matching.match_rows(lefts, rights, matching.share_needed(0.4)).collect()
    want = [(i, f"r{j}", len(a), len(b), len(set(a) & set(b))) for i, a in [*enumerate(left), (0, left[0])] if a
            for j, b in enumerate(right) if len(set(a) & set(b)) >= max(1, 0.4 * len(a) - 1e-9)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert ways == (["blocks"] if hot else [])


def test_shared_words_in_small_steps(monkeypatch):
    monkeypatch.setattr(matching, "CELLS", 7)
    sets = [["a", "b", "c"], ["b"], ["a", "x", None], ["c", "b"]]

    def rows(asks):
        n = len(sets)
        return pa.RecordBatch.from_pydict({
            "cell": [3] * n, "asks": [asks] * n, "left_key": pa.array(range(n) if asks else [None] * n, pa.int64()),
            "right_key": pa.array([None] * n if asks else range(n), pa.int64()), "words": sets,
            "size": pa.array(map(len, sets), pa.int32()), "needed": pa.array([1] * n, pa.int32())})

    got = sorted(x for b in matching.shared_words(iter([rows(False), rows(True)]))
                 for x in zip(*(b[c].to_pylist() for c in ("left_key", "right_key", "overlap"))))
    want = [(i, j, len(set(a) & set(b) - {None})) for i, a in enumerate(sets) for j, b in enumerate(sets)]
    assert got == [x for x in want if x[2]]


def test_contained_terms_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc d") for _ in range(30)) for _ in range(60)]
    terms = {"".join(rng.choice("abc d") for _ in range(rng.randrange(1, 8))) for _ in range(40)} - {""}
    got = matching.contained_terms(
        spark.createDataFrame(list(enumerate(texts)), "text_key int, body string"),
        spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert {(r["text_key"], r["term"]) for r in got} == {(i, t) for i, x in enumerate(texts) for t in terms if t in x}


def test_found_terms_in_small_pieces(monkeypatch):
    """Terms that share runs, overlap, repeat or lie across two texts; no row leaves but those of found terms."""
    monkeypatch.setattr(matching, "CHARACTERS", 5)
    texts, terms = ["abcabcd", "", "xabc", "d\U0001F600bcd", "ab", "cabc"], ["abc", "abcd", "bcab", "cabc", "\U0001F600b", "d", "dxab"]

    def rows(values, asks):
        return pa.RecordBatch.from_pydict({"cell": [1] * len(values), "asks": [asks] * len(values), "value": values,
                                           "text_key": pa.array(range(len(values)) if asks else [None] * len(values), pa.int64())})

    got = [x for b in matching.found_terms(iter([rows(terms, False), rows(texts, True)]))
           for x in zip(b["text_key"].to_pylist(), b["term"].to_pylist())]
    assert sorted(got) == sorted((i, t) for i, x in enumerate(texts) for t in terms if t in x)


def test_keyword_search(spark):
    queries = spark.createDataFrame([("q1", "price of the gold plan"), ("q2", "nothing alike")], "query_id string, body string").withColumn(
        "words", text.space_word_set(F.col("body")))
    facts = spark.createDataFrame([(1, "gold plan price", ["gold"]), (2, "silver plan", []), (3, "other", ["plan"])],
                                  "fact_id int, body string, keywords array<string>").withColumn("words", text.space_word_set(F.col("body")))
    got = {(r["query_id"], r["fact_id"]): (r["score"], r["rank"]) for r in matching.keyword_search(queries, facts, 2).collect()}
    assert got == {("q1", 1): (0.9, 1), ("q1", 3): (0.9, 2)}


def cascade(spark, hypotheses, facts, strict=False):
    h = spark.createDataFrame([(i, *r) for i, r in enumerate(hypotheses)], f"pos int, {TRIPLE}, t double")
    f = spark.createDataFrame([(i, *r) for i, r in enumerate(facts)], f"fact_id int, {TRIPLE}, state string")
    return knowledge.cascade_verdict(h, f, ["pos"], "t", strict).first()["verdict"]


def test_cascade_fixture(spark):
    stored = [("alice", "likes", "chocolate", "FALSE")]
    assert cascade(spark, [("alice", "likes", "chocolate", None)], stored) == "blocked"
    late = [("a", "at", "x", 10.0), ("a", "at", "y", 5.0)]
    assert cascade(spark, late, stored) == "warn"
    assert cascade(spark, late, stored, strict=True) == "blocked"
    assert cascade(spark, [("a", "same_as", "b", None)], stored) == "warn"
    assert cascade(spark, [("a", "same_as", "b", None)], [("b", "same_as", "a", "TRUE")]) == "ok"


def states(spark, rows):
    df = spark.createDataFrame(rows, f"{TRIPLE}, value string")
    return df.select("subject", "relation", "object", truth.from_word(F.col("value")).alias("state"))


def test_inference_fixture(spark):
    facts = states(spark, [("p", "tem_sintoma", "febre", "TRUE"), ("p", "tem_sintoma", "tosse", "TRUE"), ("q", "tem_sintoma", "febre", "TRUE")])
    rule = infer.Rule("gripe", ("?p", "pode_ter", "gripe"), [("?p", "tem_sintoma", "febre"), ("?p", "tem_sintoma", "tosse")], 0.9)
    closed, steps = infer.forward_chain(facts, [rule])
    row = closed.filter("relation = 'pode_ter'").collect()
    assert len(row) == 1 and row[0]["subject"] == "p" and row[0]["steps"] == 2
    s = row[0]["state"]
    assert (s["p_true"], s["p_false"], s["p_und"]) == (pytest.approx(0.9), pytest.approx(0.05), pytest.approx(0.05))
    goals = spark.createDataFrame([("p", "pode_ter", "gripe"), ("q", "pode_ter", "gripe")], TRIPLE)
    verdict = {r["subject"]: (r["verdict"], r["score"]) for r in infer.prove(goals, closed).collect()}
    assert verdict == {"p": ("proved", pytest.approx(1 / 3)), "q": ("undecidable", 0.0)}
    assert infer.explain(goals, steps).count() == 1


def test_closure_of_a_longer_chain_and_symmetry(spark):
    edges = [(f"n{i}", "before", f"n{i + 1}", "TRUE") for i in range(6)]
    closed, _ = infer.forward_chain(states(spark, edges), [infer.transitivity("before")])
    assert {(r["subject"], r["object"]) for r in closed.collect()} == {(f"n{i}", f"n{j}") for i in range(7) for j in range(i + 1, 7)}
    both, _ = infer.forward_chain(states(spark, [("a", "near", "b", "TRUE")]), [infer.symmetry("near")])
    assert both.count() == 2
    with pytest.raises(ValueError):
        infer.forward_chain(states(spark, edges), [infer.Rule("r", ("?a", "x", "?c"), [("?a", "before", "?b"), ("?c", "before", "?d")])])


def test_false_facts_are_no_premises_and_constraints_block(spark):
    rule = infer.Rule("r", ("?x", "causes_harm", "?y"), [("?x", "hits", "?y")])
    closed, _ = infer.forward_chain(states(spark, [("a", "hits", "b", "FALSE")]), [rule])
    assert closed.count() == 1
    blocked, _ = infer.forward_chain(states(spark, [("a", "hits", "b", "TRUE")]), [rule], constraints=knowledge.default_constraints())
    assert blocked.count() == 1


def test_personal_data_constraint(spark):
    df = spark.createDataFrame([("x", "dados_publicos", o) for o in ("123.456.789-09", "meu CPF", "nada")], TRIPLE).withColumn(
        "probability", truth.from_bool(F.lit(True), F.lit(0.5)))
    got = knowledge.constraint_violations(df, knowledge.default_constraints()).collect()
    assert {r["object"] for r in got} == {"123.456.789-09", "meu CPF"} and {r["action"] for r in got} == {"block"}


def test_action_check_wildcards(spark):
    policies = spark.createDataFrame([
        ("bot", "may", "read reports", "TRUE", 0.9, "bot", "read", "*", None),
        ("bot", "never", "delete", "FALSE", 0.8, "bot", "delete", "db", "cleanup")],
        f"{TRIPLE}, state string, confidence double, actor string, action string, resource string, purpose string")
    actions = spark.createDataFrame([
        (1, "Bot", "READ", "reports", None), (2, "bot", "read", "mails", None), (3, "bot", "delete", "db", "cleanup"),
        (4, "bot", "delete", "db", "other"), (5, "bot", "delete", "db", None)], "id int, actor string, action string, resource string, purpose string")
    got = {r["id"]: (r["decision"], r["confidence"]) for r in knowledge.action_check(actions, policies).collect()}
    assert got == {1: ("TRUE", 0.9), 2: ("UNDECIDABLE", 0.0), 3: ("FALSE", 0.8), 4: ("UNDECIDABLE", 0.0), 5: ("FALSE", 0.8)}


def test_find_with_repeated_variable(spark):
    df = spark.createDataFrame([("a", "r", "a", "TRUE"), ("a", "r", "b", "TRUE")], f"{TRIPLE}, state string")
    assert [r["x"] for r in knowledge.find(df, "?x", "r", "?x").collect()] == ["a"]


def test_claim_and_answer_check(spark):
    claims = spark.createDataFrame([("d", 0, "The gold plan costs ten euros"), ("d", 1, "It has lucro certo today"),
                                    ("e", 0, "The gold plan costs ten euros"), ("f", 0, "Unknown matter entirely")],
                                   "doc string, pos int, claim string").withColumn("claim_key", F.md5("claim"))
    facts = spark.createDataFrame([("gold plan", "costs", "ten euros", "TRUE", 0.8)], f"{TRIPLE}, state string, confidence double")
    checked = checks.claim_check(claims, guard.default_rules(), facts=facts)
    got = {(r["doc"], r["pos"]): (r["source"], r["decision"]) for r in checked.collect()}
    assert got == {("d", 0): ("ontology", "TRUE"), ("d", 1): ("compliance", "FALSE"), ("e", 0): ("ontology", "TRUE"), ("f", 0): ("none", "UNDECIDABLE")}
    answers = spark.createDataFrame([("d",), ("e",), ("f",), ("g",)], "doc string")
    out = {r["doc"]: (r["decision"], r["recommended_action"]) for r in checks.answer_check(answers, checked, ["doc"]).collect()}
    assert out == {"d": ("FALSE", "block"), "e": ("TRUE", "allow"), "f": ("UNDECIDABLE", "retry"), "g": ("UNDECIDABLE", "abstain")}
    given = checks.claim_check(claims.withColumn("ev", F.lit(0.7)), guard.default_rules(), facts=facts, evidence="ev").filter("doc = 'f'").first()
    assert (given["source"], given["decision"], given["confidence"]) == ("evidence", "TRUE", 0.7)


def test_claims_are_decided_in_their_rows(spark, monkeypatch):
    """Rules and facts of one block move and write no claim, and decide as the join on claim keys does."""
    rows = [(d, i, t, c) for d in range(6) for t in ("t0", "t1", None) for i, c in enumerate(
        ["The gold plan costs ten euros", "It has lucro certo today", "Silver plan is free", "Unknown matter entirely", "of the"])]
    claims = spark.createDataFrame(rows, "doc int, pos int, tenant_id string, claim string").withColumn(
        "claim_key", F.md5(F.concat("tenant_id", F.lit("|"), "claim")))  # null where the tenant is
    facts = spark.createDataFrame(
        [("t0", "gold plan", "costs", "ten euros", "TRUE", 0.8), ("t0", "gold plan", "costs", "ten euros", "FALSE", None),
         ("t0", "gold plan", "costs", "ten dollars", "TRUE", 0.9), ("t1", "gold plan", "costs", "euros", "FALSE", 0.6),
         ("t1", "gold plan", "costs", "ten", "TRUE", 0.7), ("t1", "silver plan", "is", "free", "UNDECIDABLE", 0.5),
         (None, "gold plan", "costs", "ten euros", "TRUE", 0.4), ("t0", "the", "of", "a", "TRUE", 0.3)],
        f"tenant_id string, {TRIPLE}, state string, confidence double")

    def decided(facts):
        checked = checks.claim_check(claims, guard.default_rules(), facts=facts)
        return checked, sorted(map(str, checked.collect()))

    with monkeypatch.context() as patch:
        patch.setattr(matching, "HELD_BYTES", -1)
        joined = [decided(x) for x in (facts, facts.limit(0), None)]
    monkeypatch.setattr(checks, "cut_lineage", None)
    beside = [decided(x) for x in (facts, facts.limit(0), None)]
    assert [x for _, x in joined] == [x for _, x in beside]
    assert joined[0][0].schema == beside[0][0].schema
    checked = beside[0][0]
    assert "Exchange" in joined[0][0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in checked._jdf.queryExecution().executedPlan().toString()
    assert {(r["tenant_id"], r["claim"][:8]): (r["source"], r["decision"], r["confidence"]) for r in checked.where("pos < 3").collect()} == {
        ("t0", "The gold"): ("ontology", "TRUE", 0.9), ("t1", "The gold"): ("ontology", "FALSE", 0.6), (None, "The gold"): ("none", "UNDECIDABLE", 0.0),
        **{(t, "It has l"): ("compliance", "FALSE", 1.0) for t in ("t0", "t1")}, (None, "It has l"): ("none", "UNDECIDABLE", 0.0),
        **{(t, "Silver p"): ("none", "UNDECIDABLE", 0.0) for t in ("t0", "t1", None)}}
    answers = claims.select("doc", "tenant_id").distinct()
    folded = [sorted(map(str, checks.answer_check(answers, checked, ["doc", "tenant_id"], unique).collect())) for unique in (False, True)]
    assert folded[0] == folded[1] and len(folded[0]) == 18


def test_states(spark):
    row = spark.range(1).select(
        truth.decide_probability(F.lit(0.75)).alias("a"), truth.decide_probability(F.lit(0.2)).alias("b"),
        truth.collapse(truth.implies(truth.from_word(F.lit("FALSE")), truth.from_word(F.lit("UNDECIDABLE")))).alias("c"),
        truth.state(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("d"),
        truth.decide(truth.state(F.lit(0.5), F.lit(0.3), F.lit(0.2))).alias("e")).first()
    assert (row["a"], row["b"], row["c"], row["d"]["p_und"], row["e"]) == ("TRUE", "FALSE", "TRUE", 1.0, "UNDECIDABLE")


def test_upsert_and_diff(spark):
    current = spark.createDataFrame([("r1", "low"), ("r2", "low"), ("r3", "low")], "rule_id string, severity string")
    changes = spark.createDataFrame([("r1", "high", "upsert", 1), ("r1", "medium", "upsert", 2), ("r2", None, "delete", 3), ("r4", "low", "upsert", 4)],
                                    "rule_id string, severity string, op string, at int")
    got = versions.upsert(current, changes, ["rule_id"], ["at"])
    assert {tuple(r) for r in got.collect()} == {("r1", "medium"), ("r3", "low"), ("r4", "low")}
    assert {r["rule_id"] for r in versions.upsert(current, changes, ["rule_id"], ["at"], replace=True).collect()} == {"r1", "r4"}
    change = {(r["rule_id"], r["change"]) for r in versions.diff(current, got, ["rule_id"], ["severity"]).collect()}
    assert change == {("r1", "updated"), ("r2", "removed"), ("r4", "added")}


def test_snapshots(spark):
    a = spark.createDataFrame([("s", "r", "o", "TRUE")], f"{TRIPLE}, state string")
    table = versions.take_snapshot(a, "snap_1", "2024-01-01 00:00:00", 1).unionByName(versions.take_snapshot(a.limit(0), "snap_2", "2024-01-02 00:00:00", 2))
    assert [r["snapshot_id"] for r in versions.list_snapshots(table).collect()] == ["snap_1"]
    assert versions.find_snapshot(table, "snap").count() == 1
    facts, log = versions.rollback(a, table, "snap_1", 5)
    assert facts.first()["version"] == 5 and log.first()["facts_before"] == 1


def test_states_of_one_triple_survive(spark):
    kind = "subject string, relation string, object string, state struct<p_true:double,p_false:double,p_und:double>"
    facts = spark.createDataFrame([("a", "in", "b", (0.2, 0.8, 0.0)), ("a", "in", "b", (0.6, 0.3, 0.1)),
                                   ("b", "in", "c", (1.0, 0.0, 0.0))], kind)
    every, steps = infer.forward_chain(facts, [infer.transitivity("in")])
    states = {(r["subject"], r["object"]): set() for r in every.collect()}
    for r in every.collect():
        states[r["subject"], r["object"]].add(round(r["state"]["p_true"], 6))
    assert states[("a", "b")] == {0.2, 0.6} and ("a", "c") in states and steps.count() == 1


def test_circular_derivations_are_explained_once(spark):
    kind = ("subject string, relation string, object string, rule string, "
            "premises array<struct<subject:string,relation:string,object:string>>")
    steps = spark.createDataFrame([("a", "r", "b", "x", [("b", "r", "a")]), ("b", "r", "a", "x", [("a", "r", "b")])], kind)
    target = spark.createDataFrame([("a", "r", "b")], "subject string, relation string, object string")
    assert sorted(r["level"] for r in infer.explain(target, steps).collect()) == [0, 1]


def test_diff_compares_sets_of_rows(spark):
    kind = "k int, state string"
    left = spark.createDataFrame([(1, "TRUE"), (1, "FALSE"), (2, "TRUE"), (3, "TRUE"), (5, "A"), (5, "B")], kind)
    right = spark.createDataFrame([(1, "TRUE"), (2, "FALSE"), (4, "TRUE"), (5, "C"), (5, "D")], kind)
    got = sorted(tuple(r) for r in versions.diff(left, right, ["k"], ["state"]).na.fill("-").collect())
    assert got == [(1, "removed", "FALSE", "-"), (2, "updated", "TRUE", "FALSE"), (3, "removed", "TRUE", "-"),
                   (4, "added", "-", "TRUE"), (5, "added", "-", "C"), (5, "added", "-", "D"), (5, "removed", "A", "-"),
                   (5, "removed", "B", "-")]
