"""Scan queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions import fixed, text
from trustframe.functions.session import read_texts
from trustframe.operators import guard, quality
from trustframe.plans import checks
from trustframe.plans import sqltext as S
from trustframe.plans.registry import query

RULES = guard.default_rules()
ACTIVE = [(r, p) for r in RULES if not r.context_required for p in r.patterns]


@query("pii_scan", "SELECT doc_id, " + ", ".join(
    f"CAST(len(regexp_extract_all(text, {S.q('(?i)' + p)})) AS INTEGER) AS n_{k}"
    for k, p, _ in fixed.PII_PATTERNS) + " FROM documents")
def pii_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_texts(spark, sf, "documents").select("doc_id", "text")
    return guard.pii_counts(docs, "text").drop("text")


def mask_sql(e: str) -> str:
    patterns = {k: p for k, p, _ in fixed.PII_PATTERNS}
    for kind in text.MASK_ORDER:
        if kind == "email":
            e = (f"regexp_replace({e}, '([a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}})', "
                 f"'\\1***@\\2', 'g')")
        elif kind == "cartao_credito":
            e = f"regexp_replace({e}, '\\d{{4}}[\\s-]?\\d{{4}}[\\s-]?\\d{{4}}[\\s-]?(\\d{{4}})', '****-****-****-\\1', 'g')"
        elif kind == "cpf":
            e = f"regexp_replace({e}, '\\d{{3}}\\.?\\d{{3}}\\.?\\d{{3}}-?(\\d{{2}})', '***.***.***-\\1', 'g')"
        else:
            e = f"regexp_replace({e}, {S.q(patterns[kind])}, '[REDACTED]', 'g')"
    return e


@query("pii_mask", f"SELECT doc_id, md5({mask_sql('text')}) AS masked_md5, "
                   f"CAST(len({mask_sql('text')}) AS INTEGER) AS n_chars FROM documents")
def pii_mask(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_texts(spark, sf, "documents").select("doc_id", text.mask_pii(F.col("text")).alias("masked"))
    return docs.select("doc_id", F.md5("masked").alias("masked_md5"), F.length("masked").alias("n_chars"))


@query("page_mask", f"SELECT page_id, md5({mask_sql('html')}) AS masked_md5 FROM pages")
def page_mask(spark: SparkSession, sf: str) -> DataFrame:
    return read_texts(spark, sf, "pages").select(
        "page_id", F.md5(text.mask_pii(F.col("html"))).alias("masked_md5"))


def violations_sql(table: str, keys: str, column: str = "text", where: str = "") -> str:
    rows = []
    for rule, pattern in ACTIVE:
        if rule.is_regex:
            found = f"regexp_extract({column}, {S.q('(?i)' + pattern)})"
            at = f"instr({column}, {found}) - 1"
            hit = f"{found} <> ''"
        else:
            at = f"instr(lower({column}), {S.q(pattern.lower())}) - 1"
            found = f"substr({column}, {at} + 1, {len(pattern)})"
            hit = f"contains(lower({column}), {S.q(pattern.lower())})"
        rows.append(
            f"SELECT {keys}, {S.q(rule.rule_id)} AS rule_id, {S.q(rule.standard)} AS standard, "
            f"{S.q(rule.severity)} AS severity, {fixed.SEVERITIES.index(rule.severity)} AS severity_rank, "
            f"{S.q(rule.remediation)} AS remediation, {found} AS matched, CAST({at} AS INTEGER) AS position, "
            f"{column} AS body FROM {table} WHERE {hit} {where}")
    return " UNION ALL ".join(rows)


VIOLATIONS = f"WITH v AS ({violations_sql('documents', 'doc_id, source')})"


def scanned_documents(spark: SparkSession, sf: str) -> DataFrame:
    return guard.scan(read_texts(spark, sf, "documents").select("doc_id", "source", "text"), "text", RULES)


@query("compliance_scan", VIOLATIONS + """
SELECT doc_id, rule_id, standard, severity, matched, position,
  substr(body, greatest(0, position - 50) + 1,
         position + len(matched) + 50 - greatest(0, position - 50)) AS snippet FROM v""")
def compliance_scan(spark: SparkSession, sf: str) -> DataFrame:
    return guard.violation_rows(scanned_documents(spark, sf), ["doc_id"]).select(
        "doc_id", "rule_id", "standard", "severity", "matched", "position", "snippet")


REPORT_SQL = VIOLATIONS + """,
counts AS (
  SELECT d.doc_id, count(v.rule_id) AS total, count(*) FILTER (WHERE v.severity = 'critical') AS critical,
    count(*) FILTER (WHERE v.severity = 'high') AS high, count(*) FILTER (WHERE v.severity = 'medium') AS medium
  FROM documents d LEFT JOIN v USING (doc_id) GROUP BY 1),
reports AS (
  SELECT *, CASE WHEN total = 0 THEN 'compliant' WHEN critical > 0 THEN 'critical_violation'
    WHEN high > 0 THEN 'high_risk' ELSE 'needs_review' END AS status, critical + high > 0 AS blocking FROM counts)
"""


@query("compliance_report", REPORT_SQL + """
SELECT status, blocking, CAST(count(*) AS BIGINT) AS documents, CAST(sum(total) AS BIGINT) AS violations,
  CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high,
  CAST(sum(medium) AS BIGINT) AS medium FROM reports GROUP BY 1, 2""")
def compliance_report(spark: SparkSession, sf: str) -> DataFrame:
    per = guard.report(scanned_documents(spark, sf), ["doc_id"])
    return per.groupBy("status", "blocking").agg(
        F.count("*").alias("documents"), F.sum("total_violations").alias("violations"),
        *[F.sum(s).alias(s) for s in ("critical", "high", "medium")])


@query("compliance_cube", VIOLATIONS + """
SELECT coalesce(standard, 'all') AS standard, coalesce(severity, 'all') AS severity,
  CAST(count(*) AS BIGINT) AS violations FROM v GROUP BY CUBE (standard, severity)""")
def compliance_cube(spark: SparkSession, sf: str) -> DataFrame:
    rows = guard.violation_rows(scanned_documents(spark, sf), ["doc_id"])
    cube = rows.cube("standard", "severity").agg(F.count("*").alias("violations"))
    return cube.select(F.coalesce("standard", F.lit("all")).alias("standard"),
                       F.coalesce("severity", F.lit("all")).alias("severity"), "violations")


@query("violations_ranked", VIOLATIONS + """
SELECT doc_id, rule_id, position, severity_rank,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY severity_rank, rule_id, position) - 1 AS INTEGER) AS place
FROM v""")
def violations_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return guard.ranked_violations(scanned_documents(spark, sf), ["doc_id"])


# ---------------------------------------------------------------------------- input risk

def threats_sql(column: str) -> list[tuple[str, str, str]]:
    """(type, count, severity) as SQL text."""
    lower = f"lower({column})"
    out = [("pii_exposure", f"len(regexp_extract_all({column}, {S.q('(?i)' + p)}))", str(sev))
           for _, p, sev in fixed.PII_PATTERNS]
    for kind, sev, words in fixed.INJECTION_KEYWORDS:
        threat = "jailbreak_attempt" if kind == "jailbreak" else "prompt_injection"
        out.append((threat, f"{S.contains_any(lower, words)}::INT", str(sev)))
    for _, sev, words in fixed.INAPPROPRIATE_KEYWORDS:
        out.append(("inappropriate_content", f"{S.contains_any(lower, words)}::INT", str(sev)))
    for _, p, sev in fixed.ENCODING_PATTERNS:
        out.append(("encoding_attack", f"regexp_matches({column}, {S.q('(?i)' + p)})::INT", str(sev)))
    for kind, sev, patterns in fixed.TECHNICAL_PATTERNS:
        threat = "sql_injection" if kind == "sql_injection" else "command_injection"
        out.append((threat, f"regexp_matches({column}, {S.q('(?i)' + '|'.join(patterns))})::INT", str(sev)))
    groups = " + ".join("(" + " AND ".join(f"contains({lower}, {S.q(w)})" for w in g) + ")::INT"
                        for g in fixed.INTENT_GROUPS)
    out.append(("malicious_intent", f"(({groups}) > 0)::INT", f"least(0.95, 0.5 + 0.2 * ({groups}))"))
    return out


def shield_sql(table: str, keys: str, column: str) -> str:
    signals = threats_sql(column)
    counted = ", ".join(f"{c} AS c{i}, {s} AS s{i}" for i, (_, c, s) in enumerate(signals))
    n = " + ".join(f"c{i}" for i in range(len(signals)))
    total = " + ".join(f"c{i} * s{i}" for i in range(len(signals)))
    top = "greatest(" + ", ".join(f"CASE WHEN c{i} > 0 THEN s{i} ELSE 0 END" for i in range(len(signals))) + ")"
    types = "[" + ", ".join(f"CASE WHEN c{i} > 0 THEN {S.q(t)} END" for i, (t, _, _) in enumerate(signals)) + "]"
    return f"""
counted AS (SELECT {keys}, {column} AS body, {counted} FROM {table}),
summed AS (SELECT *, {n} AS threats, ({total})::DOUBLE AS total, ({top})::DOUBLE AS top,
   array_to_string(list_sort(list_distinct([t FOR t IN {types} IF t IS NOT NULL])), ',') AS threat_types FROM counted),
risked AS (SELECT *, CASE WHEN threats > 0 THEN round(0.7::DOUBLE * top + 0.3::DOUBLE * total / threats, 9) ELSE 0.0 END AS risk FROM summed),
shielded AS (SELECT *, CASE WHEN risk >= 0.7 THEN 'FALSE' WHEN risk >= 0.35 THEN 'UNDECIDABLE' ELSE 'TRUE' END AS decision FROM risked)"""


@query("shield_risk", f"""WITH {shield_sql('conversations', 'conv_id, turn', 'text')}
SELECT conv_id, turn, CAST(threats AS INTEGER) AS threats, threat_types, risk, decision,
  decision <> 'FALSE' AS allowed, decision = 'UNDECIDABLE' AS flagged FROM shielded""")
def shield_risk(spark: SparkSession, sf: str) -> DataFrame:
    out = guard.shield(read_texts(spark, sf, "conversations"), "text")
    return out.select("conv_id", "turn", "threats", F.array_join("threat_types", ",").alias("threat_types"),
                      "risk", "decision", "allowed", "flagged")


@query("shield_documents", f"""WITH {shield_sql('documents', 'doc_id, lang', 'text')}
SELECT lang, decision, CAST(count(*) AS BIGINT) AS documents, CAST(sum(threats) AS BIGINT) AS threats,
  round(avg(risk), 6) AS mean_risk, max(risk) AS max_risk FROM shielded GROUP BY 1, 2""")
def shield_documents(spark: SparkSession, sf: str) -> DataFrame:
    out = guard.shield(read_texts(spark, sf, "documents"), "text")
    return out.groupBy("lang", "decision").agg(
        F.count("*").alias("documents"), F.sum("threats").alias("threats"),
        F.round(F.avg("risk"), 6).alias("mean_risk"), F.max("risk").alias("max_risk"))


# ---------------------------------------------------------------------------- output quality

def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn and the assistant turn after it, by an equi-join on (conv_id, turn)."""
    turns = read_texts(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                 F.col("text").alias("question"))
    answered = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return asked.join(answered, ["conv_id", "turn"])


TOPICS = ["tion", "keit", "ción"]
SENTENCE_FACTS = (f"[{{'n': {S.contains_any('s', fixed.CONSISTENCY_NEGATIONS)}, "
                  f"'w': {S.space_word_set('s', fixed.CONSISTENCY_NEGATIONS)}}} FOR s IN {S.points('lower(answer)')}]")
QUALITY_SQL = f"""
WITH asked AS (
  SELECT q.conv_id, a.turn, q.text AS question, a.text AS answer FROM conversations q
  JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant'),
base AS (
  SELECT *, {S.space_word_set('question', fixed.RELEVANCE_STOPWORDS)} AS qw,
    {S.space_word_set('answer', fixed.RELEVANCE_STOPWORDS)} AS aw, len({S.space_words('answer')}) AS words,
    len({S.points('answer')}) AS sentences,
    len(regexp_extract_all(lower(question), {S.q(fixed.QUESTION_PARTS)})) AS parts,
    {SENTENCE_FACTS} AS facts,
    {S.count_contained('lower(answer)', fixed.HEDGING_WORDS)} > 3 AS hedged,
    {S.contains_any('lower(question)', fixed.DISCLAIMER_TOPICS)} AND NOT
      {S.contains_any('lower(answer)', fixed.DISCLAIMER_TERMS)} AS advised FROM asked),
clash AS (
  SELECT conv_id, turn, coalesce((SELECT bool_or(len(list_intersect(x.w, y.w)) >= 3) FROM
      (SELECT unnest(facts) AS x), (SELECT unnest(facts) AS y) WHERE x.n AND NOT y.n), false) AS inconsistent FROM base),
v AS ({violations_sql('asked', 'conv_id, turn', 'answer')}),
viol AS (SELECT conv_id, turn, list({{'r': rule_id, 's': CASE WHEN severity IN ('critical', 'high') THEN 0.9 ELSE 0.6 END,
    'g': remediation}}) AS vs, bool_or(severity IN ('critical', 'high')) AS blocks FROM v GROUP BY 1, 2),
rel AS (
  SELECT b.*, c.inconsistent, coalesce(x.vs, []) AS vs, coalesce(x.blocks, false) AS blocks,
    CASE WHEN len(qw) = 0 THEN 1.0 ELSE round(0.6::DOUBLE * len(list_intersect(qw, aw)) / len(qw)
      + 0.4 * {S.count_contained('lower(answer)', TOPICS)} / {len(TOPICS)}, 9) END AS relevance
  FROM base b JOIN clash c USING (conv_id, turn) LEFT JOIN viol x USING (conv_id, turn)),
issues AS (
  SELECT *, (relevance < 0.6)::INT + (relevance < 0.3)::INT AS n_rel,
    (CASE WHEN relevance < 0.6 THEN round(1 - relevance, 9) ELSE 0 END + CASE WHEN relevance < 0.3 THEN 0.9 ELSE 0 END)::DOUBLE AS s_rel,
    (words < 10)::INT + (parts > 1 AND words < 50)::INT AS n_inc,
    (CASE WHEN words < 10 THEN 0.6 ELSE 0 END + CASE WHEN parts > 1 AND words < 50 THEN 0.5 ELSE 0 END)::DOUBLE AS s_inc FROM rel),
scores AS (
  SELECT *, round(CASE WHEN n_rel > 0 THEN 1 - s_rel / n_rel ELSE 1 END, 9) AS relevance_score,
    round(CASE WHEN n_inc > 0 THEN 1 - s_inc / n_inc ELSE 1 END, 9) AS completeness_score,
    round(greatest(0, least(1, 1 - abs(words / greatest(sentences, 1) - 15) / 30)), 9) AS clarity_score,
    CASE WHEN hedged THEN 0.96 ELSE 1.0 END::DOUBLE AS factuality_score,
    CASE WHEN inconsistent THEN 0.3 ELSE 1.0 END::DOUBLE AS consistency_score,
    n_rel + n_inc + inconsistent::INT + hedged::INT + advised::INT + len(vs) AS n_issues FROM issues),
overalls AS (
  SELECT *, round(relevance_score * 0.35 + completeness_score * 0.20 + clarity_score * 0.15 + factuality_score * 0.20
      + consistency_score * 0.10, 9) AS overall, relevance < 0.3 OR blocks AS severe FROM scores),
judged AS (
  SELECT *, NOT severe AND overall >= 0.5 AS is_valid,
    CASE WHEN severe THEN 'FALSE' WHEN overall < 0.5 THEN CASE WHEN overall >= 1 - overall THEN 'TRUE' ELSE 'FALSE' END
         WHEN n_issues > 0 AND overall < 0.7 THEN 'UNDECIDABLE' ELSE 'TRUE' END AS decision FROM overalls)
"""


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    pairs = guard.scan(turn_pairs(spark, sf), "answer", RULES)
    return quality.assess(pairs, "question", "answer", violations="violations", topics=TOPICS)


@query("output_quality", QUALITY_SQL + """
SELECT conv_id, turn, relevance, relevance_score, completeness_score, clarity_score, factuality_score,
  consistency_score, round(overall, 6) AS overall, CAST(n_issues AS INTEGER) AS n_issues, is_valid, decision FROM judged""")
def output_quality(spark: SparkSession, sf: str) -> DataFrame:
    return assessed(spark, sf).select(
        "conv_id", "turn", "relevance", "relevance_score", "completeness_score", "clarity_score",
        "factuality_score", "consistency_score", F.round("overall", 6).alias("overall"), F.size("issues").alias("n_issues"), "is_valid", "decision")


@query("retry_guidance", QUALITY_SQL + """,
listed AS (
  SELECT conv_id, turn, is_valid, [i FOR i IN list_concat([
      CASE WHEN relevance < 0.6 THEN {'s': -round(1 - relevance, 9)::DOUBLE, 'p': 0, 'g': 'Incluir termos: ' ||
        array_to_string(list_slice(list_sort([w FOR w IN qw IF NOT list_contains(aw, w)]), 1, 5), ', ')} END,
      CASE WHEN relevance < 0.3 THEN {'s': -0.9::DOUBLE, 'p': 1, 'g': 'Reformular resposta focando na pergunta original'} END],
    list_concat([{'s': -x.s::DOUBLE, 'p': 2, 'g': x.g} FOR x IN list_sort(vs)], [
      CASE WHEN inconsistent THEN {'s': -0.7::DOUBLE, 'p': 1000, 'g': 'Revisar afirmações contraditórias'} END,
      CASE WHEN hedged THEN {'s': -0.4::DOUBLE, 'p': 1001, 'g': 'Ser mais assertivo onde apropriado'} END,
      CASE WHEN words < 10 THEN {'s': -0.6::DOUBLE, 'p': 1002, 'g': 'Elaborar mais a resposta'} END,
      CASE WHEN parts > 1 AND words < 50 THEN {'s': -0.5::DOUBLE, 'p': 1003, 'g': 'Verificar se todas as partes da pergunta foram abordadas'} END,
      CASE WHEN advised THEN {'s': -0.5::DOUBLE, 'p': 1004, 'g': 'Adicionar aviso para consultar profissional qualificado'} END]))
    IF i IS NOT NULL] AS items FROM judged)
SELECT conv_id, turn, CASE WHEN len(items) = 0 THEN 'Melhorar qualidade geral da resposta' ELSE
  array_to_string([i.g FOR i IN list_slice(list_sort(items), 1, 3)], ' | ') END AS retry_guidance
FROM listed WHERE NOT is_valid""")
def retry_guidance(spark: SparkSession, sf: str) -> DataFrame:
    return assessed(spark, sf).filter("NOT is_valid").select("conv_id", "turn", "retry_guidance")


@query("conversation_cycle", QUALITY_SQL.replace("WITH asked", f"WITH {shield_sql('conversations', 'conv_id, turn, role', 'text')}, asked") + """
SELECT j.conv_id, j.turn, s.decision AS input_decision,
  CASE WHEN s.decision = 'FALSE' THEN 'input' WHEN NOT j.is_valid THEN 'output' ELSE 'none' END AS blocked_at,
  CASE WHEN s.decision = 'FALSE' THEN NULL ELSE j.decision END AS output_decision
FROM judged j JOIN shielded s ON s.conv_id = j.conv_id AND s.turn = j.turn - 1""")
def conversation_cycle(spark: SparkSession, sf: str) -> DataFrame:
    return checks.full_cycle(turn_pairs(spark, sf), RULES, TOPICS).select(
        "conv_id", "turn", "input_decision", "blocked_at", "output_decision")
