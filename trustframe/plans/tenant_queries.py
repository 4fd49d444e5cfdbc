"""Queries with rules and policies of several tenants, held in tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions import fixed
from trustframe.functions.session import read_texts
from trustframe.operators import guard, rule_tables
from trustframe.plans import sqltext as S
from trustframe.plans.registry import query
from trustframe.sources import schemas

#: (tenant, rule): the standard rules are dealt to two tenants, some rules hold for all.
TENANT_RULES = [(("north", "south")[k % 2], rule) for k, rule in enumerate(guard.default_rules())] + [
    (None, guard.Rule("ALL-1", "custom", "medium", True, [r"licen[cs]e:?\s+\w+"], "licence line", exceptions=["Apache"])),
    (None, guard.Rule("ALL-2", "custom", "low", False, ["All rights reserved"], "rights", context_required=["hr", "legal"])),
    ("north", guard.Rule("N-1", "custom", "high", False, ["copyright"], "copyright", exceptions=["mit license", "gpl"])),
    ("north", guard.Rule("N-2", "custom", "critical", True, [r"https?://\S+"], "address", context_required=["output"])),
    ("south", guard.Rule("S-1", "custom", "critical", True, [r"https?://\S+"], "address", scope="input")),
    ("south", guard.Rule("S-2", "custom", "critical", False, ["the"], "switched off", enabled=False)),
]
POLICY_DDL = ("tenant_id string, policy_id string, state string, confidence double, subject string, object string, "
              "pattern string, scope string")
TENANT_POLICY_ROWS = [
    ("north", "n1", "FALSE", 0.9, "network", "address", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", None),
    ("north", "n2", "TRUE", 0.7, "the that this and with", "from have were", None, "output"),
    ("south", "s1", "FALSE", 0.8, "key", "", r"AKIA[0-9A-Z]{16}", "output"),
    ("south", "s2", "FALSE", 0.8, "input", "only", "token", "input"),
    (None, "a1", "TRUE", 0.4, "la le les und die", "der que los", "license", None),
]


def tenant_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a large tenant, a small one and none; every second has the context hr."""
    tenant = F.when(F.col("doc_id") % 4 == 0, "south").when(F.col("doc_id") % 9 > 0, "north")
    keys = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("hr")))
    return read_texts(spark, sf, "documents").select("doc_id", "text", tenant.alias("tenant_id"), keys.alias("keys"))


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [(tenant, r.rule_id, r.standard, r.description, r.patterns, r.severity, r.remediation, r.is_regex,
             r.context_required, r.exceptions, r.scope, r.enabled) for tenant, r in TENANT_RULES]
    return (spark.createDataFrame(rows, "tenant_id string, " + schemas.RULE),
            spark.createDataFrame(TENANT_POLICY_ROWS, POLICY_DDL))


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    rules, policies = tables(spark)
    return rule_tables.scan(tenant_texts(spark, sf), "text", rules, policies, context_keys="keys")


def tenant_sql() -> str:
    rows = []
    for tenant, rule in TENANT_RULES:
        keys = ["output"] if "output" in rule.context_required else []
        where = [] if tenant is None else [f"tenant_id = {S.q(tenant)}"]
        if not rule.enabled or rule.scope == "input":
            where.append("false")
        if rule.context_required and not keys:
            where.append("hr" if "hr" in rule.context_required else "false")
        where += [f"NOT contains(lower(text), {S.q(e.lower())})" for e in rule.exceptions]
        for pattern in rule.patterns:
            if rule.is_regex:
                found = f"regexp_extract(text, {S.q('(?i)' + pattern)})"
                hit, at = f"{found} <> ''", f"instr(text, {found}) - 1"
            else:
                at = f"instr(lower(text), {S.q(pattern.lower())}) - 1"
                found, hit = f"substr(text, {at} + 1, {len(pattern)})", f"contains(lower(text), {S.q(pattern.lower())})"
            rows.append(f"SELECT doc_id, {S.q(rule.rule_id)} AS rule_id, {S.q(rule.severity)} AS severity, {found} AS matched, "
                        f"CAST({at} AS INTEGER) AS position FROM d WHERE {' AND '.join([hit, *where])}")
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'south' WHEN doc_id % 9 > 0 THEN 'north' END AS tenant_id,
  doc_id % 2 = 0 AS hr, {S.token_set('text', fixed.OVERLAP_STOPWORDS)} AS w FROM documents),
v AS ({' UNION ALL '.join(rows)})"""


def policy_sql() -> str:
    hits = []
    for tenant, policy_id, state, confidence, subject, thing, pattern, scope in TENANT_POLICY_ROWS:
        own = sorted({w for w in re.findall(r"\w+", f"{subject} {thing}".lower())} - set(fixed.OVERLAP_STOPWORDS))
        hit = f"(len(w) > 0 AND len(list_intersect(w, {S.word_list(own)})) / len(w) >= 0.35)"
        hit = f"({hit} OR regexp_matches(text, {S.q('(?i)' + pattern)}))" if pattern else hit
        where = [hit, *([] if tenant is None else [f"tenant_id = {S.q(tenant)}"]), *(["false"] if scope == "input" else [])]
        hits.append(f"SELECT doc_id, {S.q(policy_id)} AS policy_id, {S.q(state)} AS state, {confidence} AS confidence "
                    f"FROM d WHERE {' AND '.join(where)}")
    return f"p AS ({' UNION ALL '.join(hits)})"


@query("tenant_compliance_scan", tenant_sql() + "SELECT * FROM v")
def tenant_compliance_scan(spark: SparkSession, sf: str) -> DataFrame:
    return guard.violation_rows(scanned(spark, sf), ["doc_id"]).select("doc_id", "rule_id", "severity", "matched", "position")


@query("tenant_policy_scan", tenant_sql() + f""",
{policy_sql()},
b AS (SELECT doc_id, bool_or(severity IN ('critical', 'high')) AS blocks FROM v GROUP BY 1),
h AS (SELECT doc_id, string_agg(policy_id, ',' ORDER BY policy_id) FILTER (state = 'FALSE') AS denied_by,
  max(confidence) FILTER (state = 'TRUE') AS allowed FROM p GROUP BY 1),
j AS (SELECT d.doc_id, coalesce(denied_by, '') AS denied_by, allowed, blocks, denied_by IS NOT NULL OR coalesce(blocks, false) AS denied
  FROM d LEFT JOIN b USING (doc_id) LEFT JOIN h USING (doc_id))
SELECT doc_id, denied_by, CASE WHEN denied THEN 'FALSE' WHEN blocks IS NOT NULL THEN 'UNDECIDABLE' ELSE 'TRUE' END AS decision,
  CASE WHEN denied THEN 'block' WHEN blocks IS NOT NULL THEN 'warn' ELSE 'allow' END AS recommended_action,
  CASE WHEN denied THEN 1.0 WHEN blocks IS NOT NULL THEN 0.5 ELSE coalesce(allowed, 1.0) END::DOUBLE AS confidence FROM j""")
def tenant_policy_scan(spark: SparkSession, sf: str) -> DataFrame:
    return rule_tables.decided(scanned(spark, sf)).select(
        "doc_id", F.array_join("denied_by", ",").alias("denied_by"), "decision", "recommended_action", "confidence")
