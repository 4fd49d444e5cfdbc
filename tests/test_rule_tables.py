import random
import re

import pytest
from pyspark.sql import functions as F

from trustframe.operators import guard, rule_tables
from trustframe.plans import tenant_queries
from trustframe.sources import schemas

RULES = "tenant_id string, " + schemas.RULE


def rule(tenant, rule_id, patterns, regex=False, severity="high", context=(), exceptions=(), scope=None, enabled=True):
    return (tenant, rule_id, "custom", "d", list(patterns), severity, "r", regex, list(context), list(exceptions), scope, enabled)


@pytest.mark.parametrize("pattern, part", [
    (r"passport\s*\d+", "passport"), (r"\bhttps?://", "http"), (r"ab|cde", None), (r"(abcd)?xyz", "xyz"), (r"[abc]def+g", "def"),
    (r"\d{3}\.\d", None), (r"Abc\.Def", "abc.def"), (r"abcd*", "abc"), (r"abc{2,3}d", None), ("", None), (r"[]x]foo", "foo")])
def test_fixed_parts(pattern, part):
    assert rule_tables.fixed_part(pattern) == part


def test_fixed_parts_stand_in_every_match():
    draw = random.Random(1)
    pieces = ["abc", "x", r"\d", "[ab]", "(?:q|w)", "d?", "e*", "f+", r"\.", "g{1,2}", "(hij)", "."]
    for _ in range(2000):
        pattern = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 6)))
        part = rule_tables.fixed_part(pattern)
        text = "".join(draw.choice("abcxdefghijqw.1") for _ in range(60))
        for match in re.finditer(pattern, text):
            assert part is None or part in match[0].lower()


@pytest.mark.parametrize("cell_rows", [3, 2048])
def test_equal_to_rules_as_configuration(spark, cell_rows):
    """Every tenant sees what a scan with its own list sees."""
    draw = random.Random(6)
    words = ["copyright", "CPF", "123.456.789-09", "passport", "AB123456", "raça", "the", "a@b.co", "4111 1111 1111 1111", "x"]
    rows = [(i, draw.choice(["a", "a", "a", "b", None]), " ".join(draw.choice(words) for _ in range(draw.randint(0, 12))))
            for i in range(60)] + [(60, "c", None), (61, "a", ""), (61, "a", "CPF 123.456.789-09")]
    texts = spark.createDataFrame(rows, "id long, tenant_id string, text string").withColumn("cell", F.lit(0))
    owned = {"a": guard.default_rules(["lgpd"]), "b": guard.default_rules(["gdpr", "pci_dss"]), None: guard.default_rules(["hipaa"])}
    table = [(t, r.rule_id, r.standard, r.description, r.patterns, r.severity, r.remediation, r.is_regex, r.context_required,
              r.exceptions, r.scope, r.enabled) for t, own in owned.items() for r in own]
    got = rule_tables.scan(texts, "text", spark.createDataFrame(table, RULES), cell_rows=cell_rows)
    keys = ["id", "tenant_id", "rule_id", "matched", "position", "snippet", "severity_rank"]
    seen = sorted(repr(tuple(r)) for r in guard.violation_rows(got, ["id", "tenant_id"]).select(*keys).collect())
    wanted = []
    for tenant in ("a", "b", "c", None):
        rules = owned.get(tenant, []) + (owned[None] if tenant else [])
        part = texts.where(F.col("tenant_id").eqNullSafe(tenant))
        wanted += guard.violation_rows(guard.scan(part, "text", rules, context_keys=None), ["id", "tenant_id"]).select(*keys).collect()
    assert seen == sorted(repr(tuple(r)) for r in wanted) and got.count() == len(rows)


def test_context_scope_exceptions_and_disabled(spark):
    rules = [rule("t", "ctx", ["alpha"], context=["hr"]), rule("t", "out", ["alpha"], context=["output"]),
             rule("t", "in", ["alpha"], scope="input"), rule("t", "off", ["alpha"], enabled=False),
             rule("t", "exc", ["alpha"], exceptions=["OMEGA"]), rule("u", "other", ["alpha"]), rule(None, "all", ["ALPHA"], severity="low")]
    texts = spark.createDataFrame([(1, "t", "Alpha beta", ["hr"]), (2, "t", "alpha omega", None), (3, None, "alpha", None)],
                                  "id int, tenant_id string, text string, keys array<string>")
    got = rule_tables.scan(texts, "text", spark.createDataFrame(rules, RULES), context_keys="keys")
    found = {r["id"]: [v["rule_id"] for v in r["violations"]] for r in got.collect()}
    assert found == {1: ["all", "ctx", "exc", "out"], 2: ["all", "out"], 3: ["all"]}
    assert [r["decision"] for r in rule_tables.decided(got).orderBy("id").collect()] == ["FALSE", "FALSE", "UNDECIDABLE"]


def test_policies_of_tenants(spark):
    policies = [("t", "p1", "FALSE", 0.9, "secret", "plan", None, None), ("t", "p2", "TRUE", 0.6, "open", "plan", "go+", "output"),
                ("u", "p3", "FALSE", 0.9, "open", "", None, None), ("t", "p4", "FALSE", 0.9, "", "", "open", "input")]
    texts = spark.createDataFrame([(1, "t", "the secret plan"), (2, "t", "we gooo"), (3, "t", "open"), (4, "u", "open"), (5, "t", "")],
                                  "id int, tenant_id string, text string")
    none = spark.createDataFrame([], RULES)
    got = rule_tables.decided(rule_tables.scan(texts, "text", none, spark.createDataFrame(policies, tenant_queries.POLICY_DDL)))
    assert {r["id"]: (r["denied_by"], r["decision"], r["confidence"]) for r in got.collect()} == {
        1: (["p1"], "FALSE", 1.0), 2: ([], "TRUE", 0.6), 3: ([], "TRUE", 0.6), 4: (["p3"], "FALSE", 1.0), 5: ([], "TRUE", 1.0)}


def test_many_rules_and_empty_tables(spark):
    texts = spark.createDataFrame([(1, "t", "say word4711 and word12")], "id int, tenant_id string, text string")
    many = spark.createDataFrame([rule("t", f"r{k}", [f"word{k} "]) for k in range(6000)], RULES)
    got = rule_tables.scan(texts, "text", many).first()
    assert [v["rule_id"] for v in got["violations"]] == ["r4711"]
    assert rule_tables.scan(texts.limit(0), "text", many).count() == 0
    assert rule_tables.scan(texts, "text", many.limit(0)).first()["violations"] == []
