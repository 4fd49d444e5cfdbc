"""The stages compared with plain Python, each on what the stage before it kept."""

import importlib

import pytest
import test_mixing
import test_near_copies
import test_packing
import test_repeats
from pyspark.sql import functions as F

from trustframe.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        after = pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [name for name, *_ in stages] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    assert all(after.columns == ["doc_id", "text", "lang", "source", "n_chars"] for *_, after in stages[:-1])
    assert all(after.dtypes == stages[0][1].dtypes for *_, after in stages[:-1])


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = toxicity.score(before, labels).where("predicted = 0")
    assert ids(after) == ids(kept) and len(ids(after)) > 0.7 * before.count()


def rows(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    found = test_near_copies.by_hand(rows(before))
    assert ids(after) == sorted({root for _, root in found.values()})


def test_repeats_go_and_documents_stay(stages):
    _, before, after = stages[2]
    wanted = test_repeats.by_hand(rows(before))
    assert ids(after) == ids(before)
    for doc_id, text in rows(after):
        assert len((text or "").split()) == wanted[doc_id][0][0] - wanted[doc_id][0][1]
    assert after.where("n_chars <> length(text)").count() == 0


def test_mix_and_packing(stages):
    _, before, after = stages[3]
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    sizes = {r["source"]: r["n"] for r in before.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    taken = {r["source"]: r["n"] for r in after.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    wanted = test_mixing.targets_by_hand(sizes)
    assert all(abs(taken[s] - float(wanted[s])) <= 1 for s in sizes)
    _, before, packed = stages[4]
    assert test_packing.packed_well(packed.collect(), 1024) > 0
    found = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect())
    assert found == sorted((doc_id, *p) for doc_id, text in rows(before) for p in test_packing.pieces_by_hand(text))


def test_odd_rows_pass_all_stages(spark, make_docs, odd_rows, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    for given in (odd_rows + [(4, "one", "en", "a", 3)], []):
        folder = tmp_path / str(len(given))
        make_docs(given).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
        packed = pipeline.run(spark, str(folder)).collect()
        assert bool(packed) == bool(given)
