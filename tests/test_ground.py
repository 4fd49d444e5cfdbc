import random

import pytest
from pyspark.sql import functions as F

from trustframe.functions import text
from trustframe.operators import ground, review


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_claim_split_fixture(spark):
    got = one(spark, text.claims(F.lit("O Dr. Machado de Assis morava na Av. Paulista, etc. Ele era muito respeitado.")))
    assert got == ["O Dr. Machado de Assis morava na Av. Paulista, etc.", "Ele era muito respeitado."]
    assert one(spark, text.claims(F.lit("Oi."))) == []
    # a capital letter before the point, and an abbreviation in another case
    assert one(spark, text.claims(F.lit("See plan B. It holds. mr. Smith agrees!"))) == ["See plan B. It holds.", "Mr. Smith agrees!"]


def test_dependency(spark):
    assert one(spark, text.depends_on_previous(F.lit("However, it failed.")))
    assert not one(spark, text.depends_on_previous(F.lit("The plan failed again.")))


def evidence(spark, answer, contexts):
    samples = spark.createDataFrame([("s", answer, [(str(i), c) for i, c in enumerate(contexts)])],
                                    "id string, answer string, contexts array<struct<doc_id:string,text:string>>")
    return ground.evidence(ground.claim_rows(samples, ["id"]))


def test_numeric_contradiction_and_exact_match(spark):
    row = evidence(spark, "O rio tem 7.500 quilômetros de extensão.", ["O rio tem 6.992 quilômetros de extensão."]).first()
    assert row["label"] == "contradicted"
    row = evidence(spark, "O rio tem 6.992 quilômetros de extensão.", ["Dizem: o rio tem 6.992 quilômetros de extensão. Sim."]).first()
    assert (row["label"], row["confidence"]) == ("supported", 1.0)
    assert (row["evidence_start"], row["evidence_end"]) == (7, 47)


def test_routing_sends_only_the_rest(spark):
    rows = evidence(spark, "The tower has 300 meters of height. Nothing like this is known here.", ["The tower has 300 meters of height."])
    seen = []

    def heavy(frame):
        seen.append([r["claim"] for r in frame.collect()])
        return frame.withColumn("label", F.lit("supported"))

    out = {r["route"]: r for r in ground.route(rows.withColumn("cost", F.lit(0.5)), heavy).collect()}
    assert seen == [["Nothing like this is known here."]]
    assert out["fast_exact_match"]["usd_saved"] == 0.5 and out["heavy"]["usd_spent"] == 0.5


def brute_chain(labels, confs, parent):
    """Repeat the two propagation rules until nothing moves."""
    labels, confs, own = dict(labels), dict(confs), dict(confs)
    rank = {"supported": 0, "unsupported": 1, "contradicted": 2}
    for _ in range(500):
        before = (dict(labels), dict(confs))
        for c, p in parent.items():
            if rank[labels[p]] > rank[labels[c]]:
                labels[c] = labels[p]
            confs[c] = own[c] * (0.15 + 0.85 * confs[p])
        if before == (labels, confs):
            break
    return labels, confs


def test_propagation_over_edges_with_a_cycle(spark):
    labels = {1: "supported", 2: "unsupported", 3: "supported", 4: "contradicted", 5: "supported", 6: "supported"}
    confs = {1: 0.9, 2: 0.5, 3: 0.8, 4: 0.7, 5: 0.6, 6: 1.0}
    parent = {2: 1, 3: 2, 5: 6, 6: 5}
    claims = spark.createDataFrame([("s", i, labels[i], confs[i]) for i in labels], "id string, claim_id int, label string, confidence double")
    edges = spark.createDataFrame([("s", p, c) for c, p in parent.items()], "id string, parent int, child int")
    got = {r["claim_id"]: r for r in ground.propagate_edges(claims, edges, ["id"]).collect()}
    want_labels, want_confs = brute_chain(labels, confs, parent)
    assert {i: r["label"] for i, r in got.items()} == want_labels
    for i, r in got.items():
        assert r["confidence"] == pytest.approx(want_confs[i], abs=1e-3)


def test_a_long_chain_is_followed_to_its_end(spark):
    rows = [("s", i, "contradicted" if i == 0 else "supported", 0.0 if i % 3 else 1.0) for i in range(1000)]
    claims = spark.createDataFrame(rows, "id string, claim_id int, label string, confidence double")
    edges = spark.createDataFrame([("s", i - 1, i) for i in range(1, 1000)] + [("s", 999, 500)],
                                  "id string, parent int, child int")
    got = ground.propagate_edges(claims, edges, ["id"])
    assert got.filter("label = 'contradicted'").count() == 1000
    other = ground.propagate_edges(claims.filter("claim_id > 0"), edges, ["id"])
    assert other.filter("label = 'supported'").count() == 999


def test_answers_without_claims_keep_a_row(spark):
    rows = [("a", "", [("d", "the sky is blue today")]), ("b", "The sky is blue today.", [("d", "the sky is blue today")]),
            ("c", None, [])]
    samples = spark.createDataFrame(rows, "id string, answer string, contexts array<struct<doc_id:string,text:string>>")
    got = {r["id"]: r for r in ground.evaluate(samples, ["id"]).collect()}
    assert got["b"]["claims"] == 1 and not got["b"]["recommend_abstention"]
    for k in ("a", "c"):
        assert got[k]["claims"] == 0 and got[k]["risk"] == pytest.approx(0.7) and got[k]["recommend_abstention"]


def test_chain_equals_edges(spark):
    rng = random.Random(2)
    rows = [("s", i, f"claim {i}", rng.choice(["supported", "unsupported", "contradicted"]), round(rng.random(), 3), i > 0 and rng.random() < 0.6)
            for i in range(30)]
    df = spark.createDataFrame(rows, "id string, pos int, claim string, label string, confidence double, depends boolean")
    chain = {r["pos"]: (r["label"], round(r["confidence"], 4)) for r in ground.propagate_chain(df, ["id"]).collect()}
    edges = df.filter("depends").select("id", (F.col("pos") - 1).alias("parent"), F.col("pos").alias("child"))
    loop = ground.propagate_edges(df.select("id", F.col("pos").alias("claim_id"), "label", "confidence"), edges, ["id"])
    assert chain == {r["claim_id"]: (r["label"], round(r["confidence"], 4)) for r in loop.collect()}


def test_graph_text(spark):
    df = spark.createDataFrame([("s", 0, 'say "a"', "supported", 1.0, False), ("s", 1, "it b", "unsupported", 0.5, True)],
                               "id string, pos int, claim string, label string, confidence double, depends boolean")
    out = ground.propagate_chain(df, ["id"])
    mermaid = ground.graph_text(out, ["id"]).first()["graph"].split("\n")
    assert mermaid[0] == "graph TD" and mermaid[-1] == "    c1 --> c2" and '\\"a\\"' in mermaid[1]
    assert ground.graph_text(out, ["id"], "dot").first()["graph"].endswith("    c1 -> c2;\n}")


def test_intervals(spark):
    df = spark.createDataFrame([([(5, 9), (0, 3), (3, 5), (12, 15)], [(4, 13)])],
                               "a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>")
    merged = ground.merge_intervals(F.col("a"))
    row = df.select(merged.alias("m"), ground.interval_length(merged).alias("n"), ground.span_f1(merged, F.col("b")).alias("f")).first()
    assert [tuple(x) for x in row["m"]] == [(0, 9), (12, 15)] and row["n"] == 12
    assert row["f"] == pytest.approx(2 * 6 / (12 + 9))


def test_conflicting_sources(spark):
    rows = evidence(spark, "The bridge has 40 towers along the river side.",
                    ["The bridge has 40 towers along the river side.", "The bridge has 50 towers along the river side."])
    row = ground.adjudicate(rows).first()
    assert (row["source_status"], row["label"], row["confidence"]) == ("arbitrary_unilateral_choice", "contradicted", 0.5)
    warned = evidence(spark, "However, the bridge has 40 towers along the river side.",
                      ["However, the bridge has 40 towers along the river side.", "The bridge has 50 towers along the river side."])
    assert ground.adjudicate(warned).first()["source_status"] == "adjudicated_correctly"


def test_risk_and_sets(spark):
    assert one(spark, ground.abstention_risk(F.lit(0.5), F.lit(0), F.lit(0.2))) == pytest.approx(0.41)
    assert one(spark, ground.abstention_risk(F.lit(1.0), F.lit(1), F.lit(0.0))) == 1.0
    assert one(spark, ground.prediction_set(F.lit("supported"), F.lit(0.4), F.lit(0.7))) == ["supported", "unsupported", "contradicted"]
    assert one(spark, ground.prediction_set(F.lit("supported"), F.lit(0.9), F.lit(0.05))) == ["supported"]


def test_default_quantile(spark):
    from trustframe.functions import fixed
    df = spark.createDataFrame([(s,) for s in fixed.DEFAULT_NONCONFORMITY], "score double")
    assert review.conformal_quantile(df, "score", 0.1).first()["q_hat"] == 0.70


def test_other_splitters_and_extractors(spark):
    from trustframe.functions import splitters, text
    from trustframe.operators import extract
    rows = [(1, "- first claim\n2) second one; no\nthird line here"), (2, None), (3, "Policy: keep it\nfree text\n definition :  a thing ")]
    df = spark.createDataFrame(rows, "id int, answer string").withColumn("contexts", F.array(F.struct(
        F.lit("d").alias("doc_id"), F.lit("first claim is here").alias("text"))))
    by_line = ground.split_answers(df, ["id"], splitters.LineSplitter).collect()
    assert [(r["id"], r["pos"], r["claim"]) for r in sorted(by_line)][:3] == [
        (1, 0, "first claim"), (1, 1, "second one"), (1, 2, "third line here")]
    scored = {(r["id"], r["pos"]): r["label"] for r in ground.evidence(
        ground.claim_rows(df, ["id"], splitters.LineSplitter)).collect()}
    assert scored[1, 0] == "supported" and scored[1, 1] == "unsupported"
    by_column = ground.claim_rows(df, ["id"], lambda a: F.split(a, "\n"))
    assert by_column.count() == 6
    own = ground.claim_rows(df, ["id"]).select("id", "claim").collect()
    assert own == ground.claim_rows(df, ["id"], text.claims).select("id", "claim").collect()
    facts = extract.facts_by(df, ["id"], splitters.MarkedFacts, "answer").collect()
    assert sorted(map(tuple, facts)) == [(3, "a thing", "definition", 1.0), (3, "keep it", "policy", 1.0)]


def test_conflicting_numbers_equal_brute_force(spark):
    import random
    draw = random.Random(5)
    rows = []
    for k in range(60):
        parts = [f"keep {draw.choice([30, 60, 90])} days" for _ in range(draw.randint(0, 3))] + [
            f"pay {draw.choice([5, 7])} euros" for _ in range(draw.randint(0, 1))]
        rows.append((k, draw.choice(["a", "b", None]), " and ".join(parts)))
    rows += [(60, "a", None), (61, "b", "no numbers 5")]
    df = spark.createDataFrame(rows, "id int, source string, text string")
    got = {(r["id"], r["unit"], r["value"]): (r["n_same"], r["n_other"], r["low"], r["high"])
           for r in ground.conflicting_numbers(df, "id", "text", ["source"]).collect()}
    mentions = {}
    for r in df.select("id", "source", text_numbers().alias("n")).collect():
        for n in r["n"] or []:
            mentions.setdefault((r["source"] or "", n["unit"]), {}).setdefault(r["id"], set()).add(n["value"])
    wanted = {}
    for (_, unit), docs in mentions.items():
        every = {int(v) for vs in docs.values() for v in vs}
        for doc, values in docs.items():
            for v in values:
                wanted[doc, unit, v] = (sum(v in x for x in docs.values()), sum(x != {v} for x in docs.values()), min(every), max(every))
    assert got == wanted and any(o for _, o, _, _ in got.values())


def text_numbers():
    from trustframe.functions import text
    return text.numbers_with_units(F.col("text"))


def test_unsupported_spans_read_the_answer_once(spark):
    rows = [(1, "A  b c. A b!\u00a0D e", [("a b c.", "unsupported"), ("D e", "contradicted"), ("A b!", "supported"), ("z", "unsupported")]),
            (2, None, [("a", "unsupported")]), (3, "x", []), (4, "x y", [(None, "unsupported"), ("Y", None)])]
    frame = spark.createDataFrame(rows, "id int, answer string, items array<struct<claim:string,label:string>>")
    found = frame.select("id", ground.unsupported_intervals(F.col("answer"), F.col("items")).alias("spans"))
    assert [[tuple(x) for x in r["spans"]] for r in found.orderBy("id").collect()] == [[(0, 6), (12, 15)], [], [], []]
    # white space is collapsed once per answer, not for both ends of every claim
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 1
