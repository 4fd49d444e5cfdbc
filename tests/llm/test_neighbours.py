import random
from functools import reduce
from operator import add, mul

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, k):
    good = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for i, v in good:
        if i % 20 == 0:
            ranked = sorted((-float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), j)
                            for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in ranked[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_all_leaves_give_the_exact_answer(spark):
    draw = random.Random(4)
    rows = [(k, [draw.choice([-1.0, -0.5, 0.0, 0.5, 2.0]) for _ in range(4)], 1) for k in range(150)]
    rows += [(200 + k, rows[0][1], 1) for k in range(60)] + [rows[5], rows[5]]
    rows += [(300, None, 1), (320, [0.0] * 4, 1), (340, [1.0, None, 0.0, 0.0], 1), (360, [float("nan"), 1.0, 1.0, 1.0], 1),
             (380, [float("inf"), 1.0, 1.0, 1.0], 1), (None, [1.0] * 4, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "low": F.lit(2)})
    got, wanted = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0, depth=3, probes=1000)), by_hand(rows, 20)
    assert got.keys() == wanted.keys()
    for query, own in wanted.items():
        assert [j for j, _ in got[query]] == [j for j, _ in own]
        assert np.allclose([s for _, s in got[query]], [s for _, s in own], rtol=0, atol=1e-12)


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0))
    wanted = by_hand([(r["vec_id"], r["embedding"]) for r in df.collect()], 20)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in own}) for q, own in wanted.items())
    assert hits >= 0.9 * sum(map(len, wanted.values()))


def test_leaves_are_split_into_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_VECTORS", 7)
    monkeypatch.setattr(neighbours, "GROUP_QUERIES", 2)
    draw = random.Random(6)
    rows = [(k, [draw.gauss(0, 1) for _ in range(3)], 1) for k in range(120)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, depth=2, probes=100))
    assert {q: [j for j, _ in own] for q, own in got.items()} == {
        q: [j for j, _ in own] for q, own in by_hand(rows, 20).items()}


def test_few_or_no_vectors(spark):
    ask = F.col("vec_id") % 20 == 0
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), ask).count() == 0
    two = spark.createDataFrame([(20, [1.0, 0.0], 1), (21, [0.5, 0.5], 1)], SCHEMA)
    assert [tuple(r) for r in neighbours.nearest(two, ask).collect()] == [(20, 1, 21, 0.5)]


@pytest.mark.parametrize("scale", [1e-6, 1e-20, 1e6])
def test_small_and_large_vectors(spark, scale):
    draw = np.random.default_rng(3)
    rows = [(k, [float(x) * scale for x in draw.normal(size=6)], 1) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0, depth=3, probes=1000))
    for query, own in got.items():
        q = rows[query][1]
        ranked = sorted((-reduce(add, map(mul, q, v), 0.0), k) for k, v, _ in rows if k != query)[:20]
        assert own == [(k, -s) for s, k in ranked]
