import json

from pyspark.sql import functions as F

from trustframe.operators import guard, review, versions
from trustframe.sources import readers, writers


def lines(path, *items):
    path.write_text("\n".join(i if isinstance(i, str) else json.dumps(i) for i in items))
    return str(path)


def test_cases(spark, tmp_path):
    path = lines(tmp_path / "cases.jsonl", {"case_id": "a", "query": "q", "documents": [{"document_id": "d1", "text": "t"}],
                                            "relevant_document_ids": ["d1"], "retrieved_document_ids": ["d1", "d2"]}, "{broken", {"query": "x"})
    got = readers.read_cases(spark, path)
    assert got.valid.count() == 1 and got.quarantine.count() == 2
    tables = readers.case_tables(got.valid)
    assert [tables[t].count() for t in ("cases", "documents", "relevant", "retrieved")] == [1, 1, 1, 2]


def test_samples(spark, tmp_path):
    good = {"id": "1", "lang": " PT ", "question": "q", "answer": "abcd", "contexts": [{"doc_id": "d", "text": "t"}],
            "gold": {"claims": [{"claim_id": "c", "text": "t", "label": "supported"}], "unsupported_spans": []}}
    bad = dict(good, id="2", gold={"claims": [], "unsupported_spans": [{"start": 5, "end": 2, "text": ""}]})
    got = readers.read_samples(spark, lines(tmp_path / "s.jsonl", good, bad, {"id": "3"}, "nope"))
    assert got.valid.count() == 1 and got.quarantine.count() == 3
    assert {"bad span"} == set(got.quarantine.filter("id = '2'").first()["problems"])
    assert readers.with_language(got.valid, "pt").count() == 1 and readers.with_gold(got.valid).count() == 1
    profile = {r["lang"]: r for r in readers.sample_profile(got.valid).collect()}
    assert profile["all"]["mean_answer_chars"] == 4.0
    writers.export_splits(got.valid, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.first()["split"] == "test"


def test_manifest_rules_facts_ledger_annotations(spark, tmp_path):
    manifest = readers.read_manifest(spark, lines(tmp_path / "m.json", {"labels": {"a": 2, "b": 1}}))
    frame = spark.createDataFrame([("a",), ("a",), ("c",)], "label string")
    got = {r["value"]: (r["actual"], r["declared"], r["matches"]) for r in review.reconcile(frame, "label", manifest).collect()}
    assert got == {"a": (2, 2, True), "b": (0, 1, False), "c": (1, 0, False)}
    rules = readers.read_rules(spark, lines(tmp_path / "r.jsonl", {"rule_id": "r", "standard": "gdpr", "severity": "high", "patterns": ["secret"]},
                                            {"rule_id": "x", "standard": "none", "severity": "high"}, {"rule_id": "y", "standard": "gdpr", "severity": "huge"}))
    loaded = guard.rules_from_frame(rules.valid)
    assert [r.rule_id for r in loaded] == ["r"] and loaded[0].enabled and rules.quarantine.count() == 2
    facts = readers.read_fact_files(spark, lines(tmp_path / "f.json", {"domain": "d", "facts": [{"subject": "a", "relation": "b", "object": "c"}]}))
    assert facts.first()["object"] == "c"
    ledger = readers.read_ledger_lines(spark, lines(tmp_path / "l.jsonl", {"query_id": "1", "prove": {"proved": ["x"]}}, "{oops"))
    assert [r["query_id"] for r in ledger.collect()] == ["1"]
    csv = tmp_path / "a.csv"
    csv.write_text("sample_id;claim_id;claim_text;context_text;seed_label;annotator_1_label;annotator_2_label;adjudicated_label;notes\n1;c;\"x; y\";t;s;s;u;s;\n")
    row = readers.read_annotations(spark, str(csv)).first()
    assert row["claim_text"] == "x; y" and row["annotator_2_label"] == "u"
    traces = readers.read_traces(spark, lines(tmp_path / "t.jsonl", {"trace_id": "t", "span_id": "s", "stage": "x", "event": "e", "timestamp": "2024-01-01T00:00:00Z", "attributes": {"a": "b"}}))
    assert traces.first()["attributes"] == {"a": "b"}


def test_decision_checks(spark):
    df = spark.createDataFrame([("TRUE", "allow", 0.5), ("TRUE", "block", 0.5), ("FALSE", "allow", 0.5), ("NO", "warn", 0.5), ("TRUE", "warn", 1.5)],
                               "decision string, recommended_action string, confidence double").withColumn(
        "evidence", F.array(F.struct(F.lit(3).alias("span_start"), F.lit(5).alias("span_end"))))
    got = readers.check_decisions(df)
    assert got.valid.count() == 1 and got.quarantine.count() == 4


def test_writers(spark, tmp_path):
    ledger = spark.createDataFrame([("t1", "2024-01-01", 1), ("t2", "2024-01-02", 2)], "tenant_id string, date string, n int")
    writers.append_ledger(ledger, str(tmp_path / "ledger"))
    writers.append_ledger(ledger, str(tmp_path / "ledger"))
    back = writers.read_ledger(spark, str(tmp_path / "ledger"))
    plan = back.filter("tenant_id = 't1'")._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 4 and "PartitionFilters: [isnotnull(tenant_id" in plan
    writers.write_curve(spark.createDataFrame([(0.2, 1.0), (0.1, 0.5)], "threshold double, f1 double"), str(tmp_path / "curve"))
    assert [r["threshold"] for r in spark.read.option("header", True).csv(str(tmp_path / "curve")).collect()] == ["0.1", "0.2"]
    facts = spark.createDataFrame([("a", "b", "c")], "subject string, relation string, object string")
    writers.save_facts(facts, str(tmp_path / "facts"))
    assert writers.load_facts(spark, str(tmp_path / "facts")).count() == 1
    writers.append_snapshot(versions.take_snapshot(facts, "s1", "2024-01-01 00:00:00", 1), str(tmp_path / "snap"))
    writers.write_records(facts, str(tmp_path / "rec"))
    assert spark.read.json(str(tmp_path / "rec")).count() == 1
