"""Retrieval fixtures with hand-made vectors and exact expected metrics."""

import pytest
from pyspark.sql import functions as F

from trustframe.operators import rag

VECTORS = {"unknown": [0.0, 0.0, 0.0], "alpha": [1.0, 0.0, 0.0], "beta": [0.8, 0.6, 0.0], "gamma": [0.0, 1.0, 0.0],
           "other": [0.0, 0.0, 1.0]}


def frames(spark, cases):
    """cases: (case, query word, {document: word}, gold documents)."""
    pairs = [(c, d, VECTORS[q], VECTORS[w], d in gold) for c, q, docs, gold in cases for d, w in docs.items()]
    scored = rag.score_pairs(spark.createDataFrame(
        pairs, "case_id string, document_id string, query_vector array<double>, document_vector array<double>, relevant boolean"))
    head = spark.createDataFrame([(c, list(gold), None) for c, _, _, gold in cases],
                                 "case_id string, relevant array<string>, retrieved array<string>")
    return head, scored


SWEEP = [("c1", "alpha", {"d-alpha": "alpha", "d-beta": "beta"}, ["d-alpha"]),
         ("c2", "gamma", {"d-gamma": "gamma", "d-noise": "other"}, ["d-gamma"]),
         ("c3", "unknown", {"d-x": "other"}, [])]


def points(spark, k, thresholds, relative=0.0):
    head, scored = frames(spark, SWEEP)
    results = rag.case_results(head, scored, k, "adaptive", 0.0, relative)
    return {r["threshold"]: r for r in rag.threshold_curve(results, thresholds, relative).collect()}, results


def test_sweep_sizes_and_abstention(spark):
    got, _ = points(spark, 2, [0.01, 0.9, 1.01])
    assert [got[t]["mean_context_size"] for t in (0.01, 0.9, 1.01)] == pytest.approx([1.0, 2 / 3, 0.0])
    assert [got[t]["abstention_rate"] for t in (0.01, 0.9, 1.01)] == pytest.approx([1 / 3, 1 / 3, 1.0])


def test_useful_and_harmful_abstention(spark):
    got, _ = points(spark, 1, [0.9, 1.01])
    assert (got[0.9]["useful_abstention_rate"], got[0.9]["harmful_abstention_rate"]) == (1.0, 0.0)
    assert (got[1.01]["useful_abstention_rate"], got[1.01]["harmful_abstention_rate"]) == (1.0, 1.0)


def test_recommendation(spark):
    head, scored = frames(spark, SWEEP)
    results = rag.case_results(head, scored, 1, "adaptive", 0.0, 0.0)
    curve = rag.threshold_curve(results, [0.0, 0.9, 1.01], 0.0)
    best = rag.recommend_threshold(curve).first()
    assert best["threshold"] == 0.9
    row = curve.first()
    assert (row["hit_at_k"], row["mrr"]) == (1.0, 1.0)


def test_declared_and_adaptive_context(spark):
    head, scored = frames(spark, [("c", "alpha", {"data": "alpha", "other": "other"}, ["data"])])
    head = head.withColumn("retrieved", F.array(F.lit("data"), F.lit("data"), F.lit("other")))
    declared = rag.case_results(head, scored, 3, "declared").first()
    assert (declared["context_precision"], declared["context_recall"]) == (0.5, 1.0)
    assert declared["context_duplicate_rate"] == pytest.approx(1 / 3)
    adaptive = rag.case_results(head, scored, 3, "adaptive", 0.4).first()
    assert adaptive["context"] == ["data"] and adaptive["context_duplicate_rate"] == 0.0


def test_bad_parameters(spark):
    head, scored = frames(spark, SWEEP)
    with pytest.raises(ValueError):
        rag.case_results(head, scored, 0)
    with pytest.raises(ValueError):
        rag.case_results(head, scored, 3, "other")
    with pytest.raises(ValueError):
        rag.threshold_curve(head, [])


def test_stage_metrics_denominators(spark):
    head, scored = frames(spark, SWEEP)
    head = head.withColumn("expected_decision", F.lit("TRUE")).withColumn(
        "observed_decision", F.when(F.col("case_id") == "c1", "TRUE").when(F.col("case_id") == "c2", "FALSE"))
    m = rag.stage_metrics(rag.case_results(head, scored, 1, "adaptive", 0.5, 0.0)).first()
    assert (m["sample_count"], m["evaluable_queries"], m["context_evaluable_cases"]) == (3, 2, 2)
    assert m["decision_accuracy"] == 0.5 and m["context_abstention_rate"] == pytest.approx(1 / 3)
