"""No verdict crosses tenants."""

import pytest
from pyspark.sql import functions as F

from trustframe.functions import fixed, text
from trustframe.operators import knowledge, matching
from trustframe.plans import checks

CLAIM = "the violet harbour opens before seven"


def claims(spark):
    rows = [("a", CLAIM), ("b", CLAIM), (None, CLAIM)]
    frame = spark.createDataFrame(rows, "tenant_id string, claim string")
    return frame.withColumn("claim_key", F.concat_ws("|", F.coalesce("tenant_id", F.lit("none")), "claim"))


def facts(spark):
    return spark.createDataFrame([("a", "violet harbour", "opens", "before seven", "TRUE", 0.9, "f1")],
                                 "tenant_id string, subject string, relation string, object string, state string, "
                                 "confidence double, fact_id string")


def test_facts_of_another_tenant_do_not_count(spark):
    words = claims(spark).withColumn("words", text.token_set(F.col("claim"), fixed.OVERLAP_STOPWORDS))
    got = [r["claim_key"] for r in knowledge.relevant_facts(words, facts(spark)).collect()]
    assert got == ["a|" + CLAIM]
    with pytest.raises(ValueError):
        knowledge.relevant_facts(words.drop("tenant_id"), facts(spark))
    checked = checks.claim_check(claims(spark), [], facts=facts(spark)).collect()
    assert {r["tenant_id"]: r["decision"] for r in checked} == {"a": "TRUE", "b": "UNDECIDABLE", None: "UNDECIDABLE"}


def test_entries_actions_and_search_keep_to_the_tenant(spark):
    entries = spark.createDataFrame([("b", "violet harbour", ["port"], [CLAIM], [])],
                                    "tenant_id string, concept string, synonyms array<string>, facts array<string>, "
                                    "constraints array<string>")
    got = {r["claim_key"]: r["decision"] for r in knowledge.ontology_check(claims(spark), entries).collect()}
    assert got == {"b|" + CLAIM: "TRUE"}
    actions = spark.createDataFrame([(t, "ann", "read", "file", "") for t in ("a", "b")],
                                    "tenant_id string, actor string, action string, resource string, purpose string")
    policies = spark.createDataFrame([("b", "x", "y", "z", "TRUE", 0.8, "ann", "read", "file", "")],
                                     "tenant_id string, subject string, relation string, object string, state string, "
                                     "confidence double, actor string, action string, resource string, purpose string")
    got = {r["tenant_id"]: r["decision"] for r in knowledge.action_check(actions, policies).collect()}
    assert got == {"a": "UNDECIDABLE", "b": "TRUE"}
    words = F.split("claim", " ")
    queries = claims(spark).select("tenant_id", F.col("claim_key").alias("query_id"), words.alias("words"),
                                   F.col("claim").alias("body"))
    found = spark.createDataFrame([("a", 1, CLAIM.split(), ["harbour"]), ("b", 2, ["other"], ["violet"])],
                                  "tenant_id string, fact_id long, words array<string>, keywords array<string>")
    got = {(r["query_id"][0], r["fact_id"], r["score"])
           for r in matching.keyword_search(queries, found, scope=("tenant_id",)).collect()}
    assert got == {("a", 1, 1.0), ("b", 2, 0.9)}


def test_facts_by_type_and_tenant(spark):
    rows = facts(spark).withColumn("fact_type", F.lit("rule"))
    assert knowledge.find(rows, fact_type="rule", tenant="a").count() == 1
    assert knowledge.find(rows, fact_type="concept").count() == knowledge.find(rows, tenant="b").count() == 0
    hypotheses = spark.createDataFrame([("a", "x", "r", "y"), ("b", "x", "r", "y")],
                                       "tenant_id string, subject string, relation string, object string")
    false = spark.createDataFrame([("b", "x", "r", "y", "FALSE", "f")],
                                  "tenant_id string, subject string, relation string, object string, state string, fact_id string")
    assert [r["tenant_id"] for r in knowledge.symbolic_contradictions(hypotheses, false).collect()] == ["b"]
