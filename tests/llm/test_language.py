import numpy as np
from pyspark.sql import functions as F

from trustframe.llm import language

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 250 < len(held) < 420
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_texts_and_nothing_to_learn_from(make_docs, odd_rows):
    rows = language.identify(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (1, 2, 3))
    assert by_id[7]["lang_pred"] == by_id[None]["lang_pred"] == "en"
    unknown = make_docs(odd_rows).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unknown).collect()} == {"und"}
    assert language.identify(make_docs([])).count() == 0


def test_labels_of_held_out_rows_are_not_read(make_docs):
    rows = [(k, f"{'alpha beta' if k % 2 else 'gamma delta'} word{k}", "xx" if k % 2 else "yy", "a", 1) for k in range(60)]
    flag = {r["doc_id"]: r["held_out"] for r in language.identify(make_docs(rows)).collect()}
    wrong = [(k, t, "zz" if flag[k] else lang, s, n) for k, t, lang, s, n in rows]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(make_docs(wrong)).collect()}
    assert got == {k: "xx" if k % 2 else "yy" for k in range(60)}


def test_number_signs_are_no_letters(make_docs):
    rows = [(k, "the words of it", "en", "a", 1) for k in range(12)] + [(50, "½ ² ¾", "en", "a", 5), (51, "①② 12", "en", "a", 5),
                                                                         (52, "½kg of it", "en", "a", 5)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(make_docs(rows)).collect()}
    assert got[50] == got[51] == ("und", 0.0) and got[52][0] == "en"


def test_calibration_reads_all_learned_rows(spark):
    """Scale and limits are those of all rows, not of a part of them."""
    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else "b", [float(x) for x in rng.gamma(2.0, 0.5, 2)], int(i % 50)) for i in range(3000)]
    model = language.Model({})
    model.langs, model.limits = ["a", "b"], np.full(2, np.inf)
    frame = spark.createDataFrame([*rows, ("c", [0.0, 0.0], 9)], "lang string, entropy array<double>, letters long")
    language.calibrate(model, frame, 0.99)
    own = {k: [v[j] for lang, v, n in rows if lang == k and n] for j, k in enumerate("ab")}
    assert np.allclose(model.limits, [np.quantile(own[k], 0.99) for k in "ab"], rtol=1e-12)
    values, place = np.array([v for _, v, n in rows if n]), np.array(["ab".index(k) for k, _, n in rows if n])
    loss = [np.log(np.exp(-s * (values - values.min(1, keepdims=True))).sum(1)).mean()
            + (s * (values[np.arange(len(place)), place] - values.min(1))).mean() for s in language.SCALES]
    assert model.scale == language.SCALES[int(np.argmin(loss))]
