from fractions import Fraction

from pyspark.sql import functions as F

from trustframe.llm import mixing


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, full = Fraction(3 * sum(sizes.values()), 2), {}
    while True:
        heavy = sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and left * weight[s] > 2 * sizes[s] * heavy]
        if not over:
            return full | {s: left * weight[s] / heavy for s in names if s not in full}
        for s in over:
            full[s] = 2 * sizes[s]
            left -= 2 * sizes[s]


def rows_of(sources, each=40):
    return [(100 * k + d, "w " * ((7 * d + k) % 30), "en", s, 1) for k, s in enumerate(sources) for d in range(each)]


def check(rows, got, depth):
    sizes, totals = {}, {}
    for doc_id, text, _, source, _ in rows:
        n = len((text or "").encode().split())
        sizes[str(doc_id)] = n
        totals[source] = totals.get(source, 0) + n
    wanted = targets_by_hand(totals)
    by_id = {str(r[0]): r[3] for r in rows}
    taken = dict.fromkeys(totals, 0)
    for r in got:
        source = by_id[str(r["doc_id"])]
        assert r["size"] == sizes[str(r["doc_id"])] and r["source_size"] == totals[source]
        assert abs(r["target"] - float(wanted[source])) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        assert all(r[c] is None or 0 <= r[c] < 2 ** depth for c in ("shard0", "shard1"))
        taken[source] += r["taken"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - float(wanted[s])) <= 1 for s in wanted)


def test_targets_and_taken_words(make_docs):
    for sources, blocks in ((["b", "a", None, "B", "é", "c"], 8), (["only"], 4), ([f"s{k}" for k in range(12)], 1024)):
        rows = rows_of(sources) + [(9001, None, None, sources[0], None), (9002, " \t", "en", sources[0], 2)]
        got = mixing.mix(make_docs(rows), blocks=blocks, depth=3).collect()
        check(rows, got, 3)
        again = mixing.mix(make_docs(rows).repartition(3), blocks=blocks, depth=3).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


def test_hot_source_and_empty_ones(make_docs):
    rows = rows_of(["hot"], 300) + [(10_000, "a b c", "en", "tiny", 1), (10_001, "", "en", "empty", 0)]
    check(rows, mixing.mix(make_docs(rows)).collect(), 5)
    assert mixing.mix(make_docs([])).count() == 0
    assert {r["taken"] for r in mixing.mix(make_docs([(1, None), (2, "")])).collect()} == {0}


def test_tree_splits_quotas_exactly_and_without_bias(spark):
    quotas = spark.createDataFrame([(1, 700), (2, 200), (3, 100), (4, 0)], "rank int, quota long")
    rows = mixing.split_quotas(quotas, 3, 1).groupBy("shard").agg(
        F.sum("quota").alias("n"), F.sum(F.when(F.col("rank") == 1, F.col("quota"))).alias("first")).collect()
    assert sorted(r["n"] for r in rows) == [125] * 8 and sum(r["first"] for r in rows) == 700
    assert all(60 < r["first"] < 115 for r in rows) and len({r["first"] for r in rows}) > 2


def test_documents_of_the_mix(make_docs):
    rows = rows_of(["a", "b", "c"])
    docs = make_docs(rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    wanted = targets_by_hand({s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "abc"})
    assert all(abs(words[s] - float(wanted[s])) <= 1 for s in wanted)
