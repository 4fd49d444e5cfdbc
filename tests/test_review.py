import math
import random

import pytest
from pyspark.sql import functions as F

from trustframe.functions import costs
from trustframe.operators import extract, generate, review


def test_kappa_fixture(spark):
    cells = {("s", "s"): 40, ("u", "u"): 37, ("u", "c"): 10, ("c", "c"): 12, ("c", "u"): 1}
    rows = [(a, b) for (a, b), n in cells.items() for _ in range(n)]
    got = review.agreement(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert got["percent_agreement"] == pytest.approx(0.89) and got["kappa"] == pytest.approx(0.826169, abs=1e-6)


def test_decision_seed_figures(spark):
    # twelve rows with one false allow among five that should stay open
    rows = [("TRUE", "TRUE")] * 4 + [("FALSE", "FALSE")] * 3 + [("UNDECIDABLE", "UNDECIDABLE")] * 4 + [("UNDECIDABLE", "TRUE")]
    m = review.decision_metrics(spark.createDataFrame(rows, "expected string, observed string")).first()
    assert (round(m["accuracy"], 4), round(m["false_allow_rate"], 4), m["useful_abstention_rate"]) == (0.9167, 0.0833, 0.8)


def test_mcnemar_exact(spark):
    rows = [(True, False)] * 8 + [(False, True)] * 2 + [(True, True)] * 5
    got = review.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean"), "a", "b").first()
    assert got["p_value"] == pytest.approx(2 * sum(math.comb(10, k) for k in range(3)) / 2 ** 10)


def test_cost_sweep_brute_force(spark):
    rng = random.Random(7)
    labels = ["supported", "unsupported", "contradicted"]
    runs = [(rng.choice(labels), round(rng.random(), 3), rng.choice(labels), rng.choice(labels), 0.001) for _ in range(80)]
    df = spark.createDataFrame(runs, "lex_label string, lex_conf double, heavy_label string, gold_label string, cost double")
    got = {round(r["threshold"], 2): r for r in review.cost_sweep(df, 0.03).collect()}
    for i in range(101):
        t, preds, spent = i / 100, [], 0.0
        for lex, conf, heavy, gold, cost in runs:
            cheap = lex == "contradicted" or (lex == "supported" and conf >= t)
            preds.append((lex if cheap else heavy, gold))
            spent += 0 if cheap else cost
        scores = []
        for label in labels:
            tp = sum(p == g == label for p, g in preds)
            total = sum(p == label for p, _ in preds) + sum(g == label for _, g in preds)
            if total:
                scores.append(2 * tp / total)
        assert got[t]["f1_score"] == pytest.approx(sum(scores) / len(scores), abs=1e-8)
        assert got[t]["cost_usd"] == pytest.approx(spent, abs=1e-8)


def test_tokens_and_prices(spark):
    row = spark.range(1).select(
        costs.text_tokens(F.lit(10), F.lit("pt-BR")).alias("pt"), costs.text_tokens(F.lit(10), F.lit("en")).alias("en"),
        costs.text_tokens(F.lit(1), F.lit("en")).alias("one"), costs.image_tokens(F.lit(1024), F.lit(1024), F.lit("high")).alias("tiles"),
        costs.image_tokens(F.lit(4096), F.lit(512), F.lit("high")).alias("wide"), costs.image_tokens(F.lit(10), F.lit(10), F.lit("low")).alias("low"),
        costs.inference_cost(F.lit(1_000_000), F.lit(1_000_000), F.lit("openai/gpt-4o")).alias("known"),
        costs.inference_cost(F.lit(1_000_000), F.lit(0), F.lit("new-model")).alias("other")).first()
    assert (row["pt"], row["en"], row["one"], row["low"]) == (3, 2, 1, 85)
    assert row["tiles"] == 4 * 170 + 85 and row["wide"] == 12 * 2 * 170 + 85
    assert (row["known"], row["other"]) == (20.0, 0.15)


def test_gate_and_best(spark):
    gate = review.quality_gate(spark.createDataFrame([(0.9, 0.1), (0.7, 0.3)], "support double, risk double"), {"support": 0.8}, {"risk": 0.1}).first()
    assert not gate["passed"]
    curve = spark.createDataFrame([(0.1, 5.0, 0.9, False), (0.2, 2.0, 0.5, True), (0.3, 1.0, 0.5, True)], "threshold double, cost_usd double, f1_score double, feasible boolean")
    assert review.best_run(curve).first()["threshold"] == 0.3
    assert review.best_run(curve.filter("not feasible")).first()["threshold"] == 0.1


def test_fact_patterns_in_portuguese(spark):
    body = ("A taxa de juros: 12,5%. O cliente deve pagar a fatura. Não é permitido fumar aqui. Prazo de 30 dias. "
            "Atendimento de 9h às 18h. Somente gerentes pode aprovar compras. Consentimento é a permissão livre do titular.")
    facts = {(r["fact_type"], r["content"]) for r in extract.pattern_facts(spark.createDataFrame([(1, body)], "doc int, text string"), ["doc"]).collect()}
    assert ("definition", "Consentimento: a permissão livre do titular") in facts
    assert ("numeric", "juros: 12,5%") in facts and ("numeric", ": 30 dias") in facts
    assert ("rule", "cliente: pagar a fatura") in facts and ("rule", "fumar aqui") in facts
    assert any(t == "temporal" and c.startswith("Atendimento de 9h") for t, c in facts)
    assert ("constraint", "Somente gerentes pode aprovar compras") in facts


def test_concepts_and_chunks(spark):
    body = "O consentimento deve ser livre. Tratamento sem consentimento explícito é vedado. Outra frase"
    rows = extract.concepts(spark.createDataFrame([(1, body)], "doc int, text string"), ["doc"]).collect()
    lgpd = [r for r in rows if r["concept"] == "consentimento"][0]
    assert lgpd["source"] == "LGPD:Art. 7,Art. 8"
    assert lgpd["facts"] == ["O consentimento deve ser livre"] and len(lgpd["constraints"]) == 1
    text = ". ".join(["word " * 6] * 10)
    chunks = spark.createDataFrame([(text,)], "t string").select(extract.chunks(F.col("t"), 20).alias("c")).first()["c"]
    assert len(chunks) > 1 and all(len(c) <= 81 for c in chunks)
    assert "".join(chunks).replace(" ", "") == text.replace(" ", "")


def test_merge_and_first_hits(spark):
    a = spark.createDataFrame([(1, "Same fact", "rule", 0.7)], "doc int, content string, fact_type string, confidence double")
    b = spark.createDataFrame([(1, "same fact", "rule", 0.9), (1, "other", "rule", 0.6)], a.schema)
    assert {r["content"] for r in extract.merge_extractors([a, b], ["doc"]).collect()} == {"same fact", "other"}
    hits = spark.createDataFrame([("d", 2, "late"), ("d", 1, "first")], "doc string, pos int, content string")
    assert extract.first_hits(hits, "doc", ["pos"]).first()["content"] == "first"


def test_perturb(spark):
    df = spark.createDataFrame([("s1", "The tower has 300 meters. Vou enviar hoje.", [("The tower has 300 meters.", "supported")])],
                               "sid string, answer string, gold array<struct<text:string,label:string>>")
    got = {r["strategy"]: r for r in generate.perturb(df, "sid").collect()}
    assert len(got) == 6
    swapped = got["number_swap"]
    # the answer and its gold claim get the same noise
    assert swapped["gold"][0]["text"] in swapped["answer"] and "300" not in swapped["answer"]
    assert swapped["gold"][0]["label"] == "contradicted"
    assert got["negation"]["answer"].startswith("The não tower")
    assert "vou estar enviando" in got["pt_telemarketing"]["answer"]
    injected = got["injection"]
    assert injected["answer"][injected["unsupported_start"]:].strip() == injected["gold"][-1]["text"]
    assert len(got["conflicting_context"]["contexts"]) == 2
    with pytest.raises(ValueError):
        generate.perturb(df, "sid", ["nope"])


def test_seed_judges_and_parsers(spark):
    from trustframe.functions import fixed, text
    answers = ["Contractors may export data to external analytics.", "Refunds are available within 30 days.",
               "Premium refunds are available within 30 days.", ""]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = [r["d"] for r in df.orderBy("i").select(review.judge_by_rules(F.col("a"), fixed.SEED_ANSWER_RULES).alias("d")).collect()]
    assert got == ["FALSE", "TRUE", "UNDECIDABLE", "UNDECIDABLE"]
    row = spark.range(1).select(
        text.parse_label(F.lit('{"label":"maybe","confidence":"x","evidence_doc_idx":"2"}')).alias("l"),
        text.parse_fact_list(F.lit('x [{"content":"c","type":"RULE","entities":["e"]}] y')).alias("f"),
        text.parse_fact_list(F.lit("nothing")).alias("n")).first()
    assert tuple(row["l"]) == ("unsupported", 0.0, 2)
    assert tuple(row["f"][0]) == ("c", "rule", 0.7, ["e"]) and row["n"] == []
