import numpy as np
from pyspark.sql import functions as F

from trustframe.llm import characters, toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 1000 and len(held) > 50
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                              1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, wrong).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


def test_odd_tables(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (6, 0), (7, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    rows = toxicity.score(make_docs(odd_rows), labels, carry=("source", "text")).collect()
    assert sorted(str((r["doc_id"], r["text"], r["source"])) for r in rows) == sorted(
        str((r[0], r[1], r[3])) for r in odd_rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(make_docs(odd_rows), none).collect()} == {0.0}
    assert toxicity.score(make_docs([]), labels).count() == 0


def _texts(spark, rows):
    return spark.createDataFrame(rows, "toxic int, text string")


def _plain(rows, least=4.0):
    """Codes and log ratios of the runs that differ, from all counts in plain arrays."""
    grams = [characters.word_grams([w for t, text in rows if t == own for w in characters.words_of(text)], 5)[0]
             for own in (1, 0)]
    codes = np.unique(np.concatenate(grams))
    t, o = (np.bincount(np.searchsorted(codes, x), minlength=len(codes)) for x in grams)
    both, logs = characters.kneser_ney(codes, t + o, 5), []
    for own in (t, o):
        orders = characters.kneser_ney(codes[own > 0], own[own > 0], 5)
        logs.append(np.log(characters.probability({n: both[n] if n <= 2 else orders[n] for n in both}, codes)))
    _, first, context = np.unique(codes >> np.uint64(6), return_index=True, return_inverse=True)
    n, prior = t + o, t.sum() / (t + o).sum()
    usual = ((np.add.reduceat(t, first) + prior / 2) / (np.add.reduceat(n, first) + 0.5))[context]
    differs = np.abs(t - n * usual) >= least * np.sqrt(n * usual * (1 - usual))
    return codes[differs], (logs[0] - logs[1])[differs]


def test_ratios_come_from_all_counts(spark):
    draw = np.random.default_rng(3)
    words = ["".join(draw.choice(list("abcdeéя"), draw.integers(1, 9))) for _ in range(400)]
    rows = [(k % 3 % 2, " ".join(draw.choice(words[:300] if k % 3 % 2 else words[100:], 60))) for k in range(90)]
    codes, logs = _plain(rows)
    texts = _texts(spark, rows)
    whole, parts = toxicity.train(texts), toxicity.train(texts, entries=4)
    assert len(codes) > 10 and len(whole.ranges) == 1 and len(parts.ranges) > 3
    assert np.array_equal(whole.part(0).value.codes, codes)
    assert np.allclose(whole.part(0).value.logs, logs, atol=1e-4)
    assert np.array_equal(np.concatenate([parts.part(k).value.codes for k in range(len(parts.ranges))]), codes)
    docs = texts.unionByName(_texts(spark, [(0, None), (0, " "), (1, "unseen")]))
    once, pieces = (toxicity.features(docs, model, 16).toPandas().sort_values(["text", "toxic"], ignore_index=True)
                    for model in (whole, parts))
    assert once.columns.equals(pieces.columns) and once["text"].equals(pieces["text"])
    assert np.allclose(once[list(toxicity.FEATURES)], pieces[list(toxicity.FEATURES)], atol=1e-5)


def test_rare_runs_count_beside_a_million_frequent_ones(spark):
    letters = np.random.default_rng(8).integers(97, 123, (20_000, 70), dtype=np.uint8)
    filler = " ".join(bytes(x).decode() for x in letters)
    assert len(np.unique(characters.word_grams(filler.split(), 5)[0])) > 1 << 20
    rows = [(0, filler)] * 4 + [(0, "éaéaéb " * 2000), (1, "éaéaéc " * 3)]
    asked = _texts(spark, [(0, "éaéaéb"), (1, "éaéaéc")])
    found = {r["toxic"]: r["toxic_part"] for r in toxicity.features(asked, toxicity.train(_texts(spark, rows)), 16).collect()}
    assert found[1] > found[0] + 0.5


def test_words_are_scored_some_at_a_time():
    words, sizes = [f"w{k}" for k in range(40_000)], []

    def score(some):
        sizes.append(len(some))
        return np.array([[int(word[1:])] for word in some], np.float32)

    scores = characters.WordScores(score, 1)
    first, second = scores.rows([words, words[:7] + ["w50000"]])
    assert scores.matrix[first, 0].tolist() == list(range(40_000))
    assert scores.matrix[second, 0].tolist() == [*range(7), 50_000]
    assert sum(sizes) == 40_001 and max(sizes) <= 1 << 14
