import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustframe.operators import rag, search


def brute_force(cases, documents, judged, k):
    top, first = [], {}
    for case, own, q in cases:
        ranked = []
        for d, v in documents:
            if d == own or v is None or q is None or len(v) != len(q):
                continue
            length = np.sqrt(sum(x * x for x in q)) * np.sqrt(sum(x * x for x in v))
            ranked.append((-round(sum(a * b for a, b in zip(q, v)) / length if length else 0.0, 9), d))
        ranked.sort()
        top += [(case, d, -s, (case, d) in judged, r) for r, (s, d) in enumerate(ranked[:k], 1)]
        places = [r for r, (_, d) in enumerate(ranked, 1) if (case, d) in judged]
        if places:
            first[case] = places[0]
    return sorted(top), first


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_search_equals_brute_force(spark, block_rows):
    draw = random.Random(2)
    documents = [(d, [float(draw.randint(-2, 2)) for _ in range(3)]) for d in range(150)]  # many ties and zero vectors
    documents += [(200, None), (201, [1.0, None, 2.0]), (202, []), (203, [1.0, 0.0])]
    cases = [(d, d, v) for d, v in documents if d % 10 == 0 and d < 150] + [(900, None, [1.0, 2.0, 0.5]), (901, None, None)]
    judged = {(c, draw.randrange(150)) for c, _, _ in cases for _ in range(3)} | {(0, 0), (900, 203)}
    top, first = search.search(
        spark.createDataFrame(cases, "case_id long, own_id long, vector array<double>"),
        spark.createDataFrame(documents, "document_id long, vector array<double>").withColumn("block", F.lit(1)), 4,
        spark.createDataFrame(list(judged), "case_id long, document_id long"), block_rows)
    clean = [(d, v) for d, v in documents if d != 201 and v]
    wanted = brute_force([c for c in cases if c[2]], clean, judged, 4)
    assert sorted((r["case_id"], r["document_id"], r["score"], r["relevant"], r["rank"]) for r in top.collect()) == wanted[0]
    assert {r["case_id"]: r["first_rank"] for r in first.collect()} == wanted[1]


def test_search_gives_the_same_results_as_scored_pairs(spark):
    draw = random.Random(4)
    vectors = [(d, [draw.gauss(0, 1) for _ in range(8)]) for d in range(60)]
    df = spark.createDataFrame(vectors, "id long, vector array<double>")
    judged = spark.createDataFrame([(c, (c * 7 + 3) % 60) for c in range(0, 60, 5)], "case_id long, document_id long")
    asked = df.where("id % 5 = 0").select(F.col("id").alias("case_id"), F.col("id").alias("own_id"), "vector")
    corpus = df.select(F.col("id").alias("document_id"), "vector")
    pairs = asked.join(corpus.withColumnRenamed("vector", "document_vector"), F.col("own_id") != F.col("document_id"))
    scored = rag.score_pairs(pairs.withColumnRenamed("vector", "query_vector")).join(
        judged.withColumn("relevant", F.lit(True)), ["case_id", "document_id"], "left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(False)))
    cases = judged.select("case_id", F.array("document_id").alias("relevant"), F.lit(None).cast("array<long>").alias("retrieved"))
    top, first = search.search(asked, corpus, 3, judged, 16)
    one = rag.case_results(cases, scored, 3, "adaptive", 0.1).orderBy("case_id").collect()
    assert one == rag.searched_results(cases, top, first, 3, "adaptive", 0.1).orderBy("case_id").collect()


def test_empty_sides(spark):
    none = spark.createDataFrame([], "case_id long, vector array<double>")
    top, first = search.search(none, none.withColumnRenamed("case_id", "document_id"), 3)
    assert top.count() == 0 == first.count()


def test_dense_vectors(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (1, 3, 2.0)], "id long, dim int, weight double")
    assert search.dense(rows, "id", 4).first()["vector"] == [0.5, 0.0, 0.0, 2.0]


def test_block_tells_apart_what_only_rounding_joins():
    """Documents closer than a product can tell are ranked by their rounded cosines, ties by id, and counted so."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    documents = np.concatenate([base, base * 3.0, base + 1e-10, base + 3e-9, np.zeros((2, 16)), rng.normal(size=(30, 16))])
    ids, cases = rng.permutation(len(documents)), np.concatenate([base + 0.01, np.zeros((1, 16))])

    def table(vectors, **columns):
        return pa.table({"vector": pa.array(list(vectors)), "size": pa.array([16] * len(vectors), pa.int32()),
                         "norm": np.sqrt([sum(x * x for x in v) for v in vectors.tolist()]), **columns})

    def cosine(a, b):
        length = np.sqrt(sum(x * x for x in a)) * np.sqrt(sum(x * x for x in b))
        return np.round(sum(x * y for x, y in zip(a, b)) / length, 9) if length else 0.0

    score = np.array([[cosine(a, b) for b in documents.tolist()] for a in cases.tolist()])
    best = [2, 8, 14, 20, 4, 10, 24]  # the best relevant document of each case
    got = search.best_in_block(3)(
        table(cases, case_id=np.arange(len(cases)), own_id=np.full(len(cases), ids[0]),
              best_score=score[np.arange(len(cases)), best], best_id=ids[best]), table(documents, document_id=ids)).to_pylist()
    for case in range(len(cases)):
        line = sorted((-s, i) for s, i in zip(score[case], ids.tolist()) if i != ids[0])
        assert [(r["score"], r["document_id"]) for r in got if r["case_id"] == case and r["listed"]] == [(-s, i) for s, i in line[:3]]
        ahead = [r["ahead"] for r in got if r["case_id"] == case and not r["listed"]]
        assert ahead == [sum(x < (-score[case][best[case]], ids[best[case]]) for x in line)]
