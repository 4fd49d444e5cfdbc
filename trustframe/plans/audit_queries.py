"""Ledger and trace queries over events, extraction queries over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions import fixed, text, vectors
from trustframe.functions.session import checkpoint_folder, read_table, read_texts
from trustframe.operators import audit, extract, ordered, seals
from trustframe.plans import sqltext as S
from trustframe.plans.rag_queries import rounded
from trustframe.plans.registry import query
from trustframe.sources import writers

# ---------------------------------------------------------------------------- windows


@query("rate_limit_window", """
SELECT event_id, user_id, CAST(n AS BIGINT) AS in_window, n > 2 AS exceeded FROM (
  SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW) AS n FROM events)""")
def rate_limit_window(spark: SparkSession, sf: str) -> DataFrame:
    out = ordered.rate_counts(read_table(spark, sf, "events"), "user_id", "ts", 3600)
    return out.select("event_id", "user_id", "in_window", (F.col("in_window") > 2).alias("exceeded"))


@query("budget_cutoff", """
WITH c AS (SELECT event_id, user_id, value, coalesce(sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events)
SELECT event_id, user_id, CAST(spent AS BIGINT) AS spent_before FROM c WHERE spent <= 50000""")
def budget_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("bigint")
    out = ordered.running(read_table(spark, sf, "events"), ["user_id"], ["event_id"],
                          {"spent": ordered.Running("sum", cents, before=True)})
    spent = F.coalesce("spent", F.lit(0))
    return out.filter(spent <= 50000).select("event_id", "user_id", spent.alias("spent_before"))


# ---------------------------------------------------------------------------- ledger

SEGMENT = 256


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return decision_frame(read_table(spark, sf, "events"))


def decision_frame(events: DataFrame) -> DataFrame:
    """Events as decisions: the event type is the tenant."""
    v, u = F.col("value"), F.col("user_id")
    return events.select(
        F.col("event_type").alias("tenant_id"), F.format_string("P%010d", "event_id").alias("proof_id"),
        F.when(u < 50, F.lit("input_shield")).when(u < 100, F.lit("claim_check")).otherwise(F.lit("policy_check")).alias("proof_type"),
        "ts", F.substring(F.sha2("props", 256), 1, 32).alias("input_hash"),
        F.when(v < 10, F.lit("TRUE")).when(v < 30, F.lit("UNDECIDABLE")).otherwise(F.lit("FALSE")).alias("decision"),
        F.round(F.least(F.lit(1.0), v / 100.0), 4).alias("confidence"),
        F.when(v > 50, text.words_array(["pii_exposure"])).otherwise(F.array().cast("array<string>")).alias("threats"),
        F.when(v > 30, text.words_array(["low_relevance", "off_topic"])).otherwise(F.array().cast("array<string>")).alias("issues"),
        F.when(u < 75, F.lit("onto_a")).otherwise(F.lit("onto_b")).alias("ontology_id"),
        F.when(v < 20, F.lit("search")).otherwise(F.lit("files")).alias("adapter_source"),
        F.col("ts").cast("date").alias("date"), "value")


DECISIONS_SQL = """
d AS (SELECT event_type AS tenant_id, printf('P%010d', event_id) AS proof_id,
    CASE WHEN user_id < 50 THEN 'input_shield' WHEN user_id < 100 THEN 'claim_check' ELSE 'policy_check' END AS proof_type, ts,
    substr(sha256(props), 1, 32) AS input_hash, CASE WHEN value < 10 THEN 'TRUE' WHEN value < 30 THEN 'UNDECIDABLE' ELSE 'FALSE' END AS decision,
    round(least(1.0, value / 100.0), 4)::DOUBLE AS confidence, CASE WHEN value > 50 THEN 1 ELSE 0 END AS n_threats, CASE WHEN value > 30 THEN 2 ELSE 0 END AS n_issues,
    CASE WHEN user_id < 75 THEN 'onto_a' ELSE 'onto_b' END AS ontology_id, CASE WHEN value < 20 THEN 'search' ELSE 'files' END AS adapter_source,
    ts::DATE AS date, value FROM events)
"""


def content_sql(decision: str) -> str:
    def marked(e: str) -> str:
        return f"coalesce(strlen({e}) || ':' || {e}, '-')"

    def listed(*items: str) -> str:
        return S.q(f"[{len(items)}:" + "".join(f"{len(i)}:{i}" for i in items))

    fields = [*map(marked, ("proof_id", "proof_type", "tenant_id", "(epoch_us(ts)::VARCHAR)", "input_hash")), "'-'", marked(decision),
              marked("(trunc(confidence * 4611686018427387904)::BIGINT::VARCHAR)"),
              f"CASE WHEN n_threats > 0 THEN {listed('pii_exposure')} ELSE {listed()} END",
              f"CASE WHEN n_issues > 0 THEN {listed('low_relevance', 'off_topic')} ELSE {listed()} END", marked("ontology_id"),
              *["'-'"] * 4, marked("adapter_source"), *["'-'"] * 6]
    return f"sha256({' || '.join(fields)})"


LEDGER_SQL = f"""
WITH RECURSIVE {DECISIONS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, proof_id) - 1 AS seq, {content_sql('decision')} AS ch FROM d),
g AS (SELECT *, seq // {SEGMENT} AS segment FROM n),
digests AS (SELECT tenant_id, segment, sha256(string_agg(ch, '' ORDER BY seq)) AS digest FROM g GROUP BY 1, 2),
anchors AS (
  SELECT tenant_id, 0::BIGINT AS segment, sha256('ledger:' || tenant_id) AS anchor FROM digests WHERE segment = 0
  UNION ALL SELECT a.tenant_id, a.segment + 1, sha256(x.digest || a.anchor) FROM anchors a JOIN digests x ON x.tenant_id = a.tenant_id AND x.segment = a.segment
    WHERE EXISTS (SELECT 1 FROM digests y WHERE y.tenant_id = a.tenant_id AND y.segment = a.segment + 1)),
chain AS (
  SELECT g.tenant_id, g.segment, g.seq, a.anchor AS previous_hash, sha256(g.ch || a.anchor) AS entry_hash
  FROM g JOIN anchors a USING (tenant_id, segment) WHERE g.seq % {SEGMENT} = 0
  UNION ALL SELECT g.tenant_id, g.segment, g.seq, c.entry_hash, sha256(g.ch || c.entry_hash)
  FROM chain c JOIN g ON g.tenant_id = c.tenant_id AND g.segment = c.segment AND g.seq = c.seq + 1)
"""


@query("ledger_append", LEDGER_SQL + """
SELECT tenant_id, CAST(segment AS BIGINT) AS segment, CAST(seq AS BIGINT) AS seq, previous_hash, entry_hash FROM chain""")
def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    return audit.append(decisions(spark, sf), segment=SEGMENT).select(
        "tenant_id", "segment", "seq", "previous_hash", "entry_hash")


@query("ledger_verify", f"""
WITH {DECISIONS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, proof_id) - 1 AS seq FROM d),
bad AS (SELECT tenant_id, count(*) FILTER (WHERE value > 60 AND decision <> 'TRUE') AS invalid, min(CASE WHEN value > 60 AND decision <> 'TRUE' THEN seq // {SEGMENT} END) AS first_bad,
    max(seq // {SEGMENT}) AS last_segment, count(*) AS total, min_by(proof_id, seq) AS first_proof, max_by(proof_id, seq) AS last_proof FROM n GROUP BY 1)
SELECT tenant_id, CAST(total AS BIGINT) AS total, CAST(invalid AS BIGINT) AS invalid_entries, CAST(coalesce(last_segment - first_bad, 0) AS BIGINT) AS broken_links,
  invalid = 0 AS valid, first_proof, last_proof FROM bad""")
def ledger_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Build the chain, change some decisions afterwards, and verify."""
    ledger = audit.append(decisions(spark, sf), segment=SEGMENT)
    changed = F.when(F.col("value") > 60, F.lit("TRUE")).otherwise(F.col("decision"))
    return audit.verify(ledger.withColumn("decision", changed))


SEAL_SQL = f"""
WITH RECURSIVE {DECISIONS_SQL},
leaves AS MATERIALIZED (SELECT tenant_id, date, proof_id, digest, row_number() OVER (PARTITION BY tenant_id, date ORDER BY proof_id) - 1 AS place,
  count(*) OVER (PARTITION BY tenant_id, date) AS n FROM (SELECT *, {content_sql('decision')} AS digest FROM d)),
tree AS (
  SELECT tenant_id, date, 0 AS level, place, digest, n, n AS total FROM leaves
  UNION ALL
  SELECT tenant_id, date, level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 15) // 16, max(total)
  FROM tree WHERE n > 1 GROUP BY tenant_id, date, level, place // 16)
"""


@query("ledger_seal", SEAL_SQL + """
SELECT tenant_id, strftime(date, '%Y-%m-%d') AS date, CAST(total AS BIGINT) AS n, digest AS root FROM tree WHERE n = 1""")
def ledger_seal(spark: SparkSession, sf: str) -> DataFrame:
    """Root over the decisions of each tenant and day."""
    rows = decisions(spark, sf)
    sealed = seals.seal(rows.withColumn("content_hash", audit.content_hash(rows)), ["tenant_id", "date"], ["proof_id"])
    return sealed.withColumn("date", F.col("date").cast("string"))


@query("ledger_inclusion", SEAL_SQL + """,
sides AS MATERIALIZED (
  SELECT a.tenant_id, a.date, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM tree a JOIN tree b ON a.tenant_id = b.tenant_id AND a.date = b.date AND a.level = b.level AND a.place // 16 = b.place // 16
  WHERE a.n > 1 GROUP BY 1, 2, 3, 4),
walk AS (
  SELECT tenant_id, date, proof_id, 0 AS level, place, digest AS folded, '' AS siblings FROM leaves
  UNION ALL
  SELECT w.tenant_id, w.date, w.proof_id, w.level + 1, w.place // 16, sha256(s.before || w.folded || s.after), w.siblings || s.before || s.after
  FROM walk w JOIN sides s ON s.tenant_id = w.tenant_id AND s.date = w.date AND s.level = w.level AND s.place = w.place)
SELECT w.proof_id, sha256(max_by(w.siblings, w.level)) AS path_hash, max_by(w.folded, w.level) = any_value(t.digest) AS holds
FROM walk w JOIN tree t ON t.tenant_id = w.tenant_id AND t.date = w.date AND t.n = 1 GROUP BY 1""")
def ledger_inclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Every decision's way up to its day's root."""
    rows = decisions(spark, sf)
    hashed = rows.withColumn("content_hash", audit.content_hash(rows))
    found = seals.proofs(hashed, F.lit(True), ["tenant_id", "date"], ["proof_id"])
    joined = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return found.select("proof_id", F.sha2(joined, 256).alias("path_hash"),
                        (seals.fold(F.col("path"), F.col("content_hash")) == F.col("root")).alias("holds"))


@query("ledger_stats", f"""
WITH {DECISIONS_SQL}
SELECT tenant_id, CASE WHEN proof_type IS NOT NULL THEN 'proof_type' WHEN decision IS NOT NULL THEN 'decision' WHEN ontology_id IS NOT NULL THEN 'ontology_id'
  WHEN adapter_source IS NOT NULL THEN 'adapter_source' ELSE 'total' END AS level, coalesce(proof_type, decision, ontology_id, adapter_source, 'all') AS name,
  CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 9) AS avg_confidence, CAST(sum(n_threats) AS BIGINT) AS threats, CAST(sum(n_issues) AS BIGINT) AS issues
FROM d GROUP BY GROUPING SETS ((tenant_id), (tenant_id, proof_type), (tenant_id, decision), (tenant_id, ontology_id), (tenant_id, adapter_source))""")
def ledger_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(audit.ledger_statistics(decisions(spark, sf)))


@query("ledger_search", f"""
WITH {DECISIONS_SQL}
SELECT proof_id, decision, strftime(date, '%Y-%m-%d') AS date FROM d WHERE tenant_id = 'click' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
  AND proof_type = 'claim_check' AND ontology_id = 'onto_b' ORDER BY date DESC, ts DESC, proof_id LIMIT 50""")
def ledger_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search in a written ledger; only the tenant's days asked for are read."""
    path = f"{checkpoint_folder(spark)}/ledgers/{uuid.uuid4().hex}"
    writers.append_ledger(decisions(spark, sf), path)
    found = audit.search(writers.read_ledger(spark, path), "click", "2024-01-05", "2024-01-20", "claim_check", "onto_b", 50)
    return found.select("proof_id", "decision", F.col("date").cast("string").alias("date"))


@query("ledger_counts", f"""
WITH c AS (SELECT conv_id || '-' || turn AS query_id, {S.claims('text')} AS cs FROM conversations),
q AS (SELECT query_id, CAST(len([x FOR x IN cs IF len(x) < 40]) AS INTEGER) AS proved, CAST(len([x FOR x IN cs IF len(x) > 120]) AS INTEGER) AS rejected,
  CAST(len([x FOR x IN cs IF len(x) BETWEEN 100 AND 120]) AS INTEGER) AS undecidable FROM c)
SELECT * FROM q WHERE rejected > 0 OR undecidable > 0""")
def ledger_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as ledger entries whose claims are proved, rejected or undecided by their length."""
    claims = read_texts(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        text.claims(F.col("text")).alias("cs"))
    entries = claims.select(
        "query_id", F.filter("cs", lambda c: F.length(c) < 40).alias("proved"),
        F.filter("cs", lambda c: F.length(c) > 120).alias("rejected"),
        F.filter("cs", lambda c: F.length(c).between(100, 120)).alias("undecidable"))
    return audit.outcome_counts(entries, ["rejected", "undecidable"])


@query("decision_ids", f"""
WITH {DECISIONS_SQL}
SELECT proof_id, 'QST-' || substr(sha256(tenant_id || ':' || decision || ':' || input_hash), 1, 16) AS decision_id FROM d""")
def decision_ids(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).select("proof_id", audit.decision_id(
        F.col("tenant_id"), F.col("decision"), F.col("input_hash")).alias("decision_id"))


# ---------------------------------------------------------------------------- traces

def trace_events(spark: SparkSession, sf: str) -> DataFrame:
    return trace_frame(read_table(spark, sf, "events"))


def trace_frame(events: DataFrame) -> DataFrame:
    """Events as trace events: the events of a user form a trace."""
    v = F.col("value")
    decision = F.when(v < 10, F.lit("TRUE")).when(v < 30, F.lit("UNDECIDABLE"))
    attributes = F.create_map(
        F.lit("decision"), decision, F.lit("status"), F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("ok")),
        F.lit("total_tokens"), F.get_json_object("props", "$.k"), F.lit("estimated_cost_usd"), F.round(v / 1000, 6).cast("string"),
        F.lit("api_key"), F.sha2("props", 256), F.lit("case_id"), F.concat(F.lit("case"), F.col("user_id")),
        F.lit("authorization"), F.lit("Bearer x"))
    return events.select(
        F.concat(F.lit("user"), "user_id").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.when(v < 20, F.lit("pre_rag")).when(v < 40, F.lit("during_rag")).otherwise(F.lit("post_rag")).alias("stage"),
        F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(v < 60, v).alias("duration_ms"), attributes.alias("attributes"))


TRACE_SQL = """
WITH t AS (SELECT 'user' || user_id AS trace_id, event_id::VARCHAR AS span_id, CASE WHEN value < 20 THEN 'pre_rag' WHEN value < 40 THEN 'during_rag' ELSE 'post_rag' END AS stage,
  event_type AS event, ts, CASE WHEN value < 60 THEN value END AS duration_ms, CASE WHEN value < 10 THEN 'TRUE' WHEN value < 30 THEN 'UNDECIDABLE' END AS decision,
  event_type = 'error' AS failed, CAST(props->>'$.k' AS BIGINT) AS tokens, round(value / 1000, 6) AS cost FROM events)
"""


@query("trace_summary", TRACE_SQL + """
SELECT trace_id, CAST(count(*) AS BIGINT) AS event_count, round(coalesce(sum(duration_ms), 0), 6) AS latency_total, round(coalesce(avg(duration_ms), 0), 6) AS latency_average,
  round(coalesce(max(duration_ms), 0), 6) AS latency_max, CAST(count(decision) AS BIGINT) AS decisions, CAST(count(*) FILTER (WHERE decision = 'UNDECIDABLE') AS BIGINT) AS abstentions,
  CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS failures, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(cost), 6) AS estimated_cost_usd FROM t GROUP BY 1""")
def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.trace_summary(trace_events(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("trace_breakdown", TRACE_SQL + """
SELECT trace_id, 'stage' AS level, stage AS name, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1, 3
UNION ALL SELECT trace_id, 'event', event, CAST(count(*) AS BIGINT) FROM t GROUP BY 1, 3
UNION ALL SELECT trace_id, 'decision', decision, CAST(count(*) AS BIGINT) FROM t WHERE decision IS NOT NULL GROUP BY 1, 3""")
def trace_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return audit.trace_breakdown(trace_events(spark, sf))


@query("trace_replay", TRACE_SQL + "SELECT span_id, stage, event, decision FROM t WHERE trace_id = 'user8'")
def trace_replay(spark: SparkSession, sf: str) -> DataFrame:
    return audit.replay(trace_events(spark, sf), "case8").select("span_id", "stage", "event", "decision")


@query("trace_redact", TRACE_SQL + """
SELECT span_id, '[REDACTED]' AS api_key, '[REDACTED]' AS auth, tokens::VARCHAR AS total_tokens, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS status FROM t""")
def trace_redact(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("attributes")
    return audit.redact(trace_events(spark, sf)).select(
        "span_id", a["api_key"].alias("api_key"), a["authorization"].alias("auth"), a["total_tokens"].alias("total_tokens"),
        a["status"].alias("status"))


@query("trace_redact_json", """
WITH t AS (SELECT event_id, props, '{"run":{"total_tokens":' || user_id || ',"deep":' || repeat('[{"x":', 30) AS head, repeat('}]', 30) || ',"note":"the \\"token\\": stays"}' AS tail FROM events)
SELECT event_id, head || '{"user_password":"[REDACTED]"}' || tail || ',"Authorization":"[REDACTED]"' || CASE WHEN event_id % 4 > 0 THEN '}' ELSE '' END AS attributes FROM t""")
def trace_redact_json(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes as JSON text with secrets sixty levels deep and up to 2,400 characters long, some cut off."""
    event = F.col("event_id")
    secret = F.repeat(F.lit('y\\"'), (event % 3 * 400 + 1).cast("int"))
    attributes = F.concat(
        F.lit('{"run":{"total_tokens":'), F.col("user_id"), F.lit(',"deep":'), F.repeat(F.lit('[{"x":'), 30),
        F.lit('{"user_password":'), F.col("props"), F.lit("}"), F.repeat(F.lit("}]"), 30),
        F.lit(',"note":"the \\"token\\": stays"},"Authorization": "'), secret,
        F.when(event % 4 > 0, F.lit('"}')).otherwise(F.lit("")))
    return read_table(spark, sf, "events").select("event_id", text.redact_json(attributes).alias("attributes"))


@query("trace_spans", TRACE_SQL + """
SELECT trace_id AS "traceId", span_id AS "spanId", stage || '.' || event AS name, (epoch_us(ts) * 1000)::VARCHAR AS "startTimeUnixNano",
  (epoch_us(ts) * 1000 + floor(coalesce(duration_ms, 0) * 1000000)::BIGINT)::VARCHAR AS "endTimeUnixNano" FROM t""")
def trace_spans(spark: SparkSession, sf: str) -> DataFrame:
    return audit.spans(trace_events(spark, sf), "evaluation").select(
        "traceId", "spanId", "name", "startTimeUnixNano", "endTimeUnixNano")


# ---------------------------------------------------------------------------- extraction

def facts_sql() -> str:
    body = f"trim(regexp_replace({S.squeeze('text')}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'))"
    lists = []
    for i, (kind, pattern, names) in enumerate(fixed.FACT_PATTERNS):
        regex = S.q("(?i)" + extract.pattern_text(pattern))
        g = {n: f"[coalesce(x, '') FOR x IN regexp_extract_all(body, {regex}, {j + 1})]" for j, n in enumerate(names)}
        whole = f"regexp_extract_all(body, {regex}, 0)"
        n = f"range(1, len({whole}) + 1)"

        def at(name: str) -> str:
            return f"trim({g[name]}[i])"

        if kind == "temporal":
            expr = f"trim({whole}[i])"
        elif kind == "definition":
            expr = f"CASE WHEN {at('term')} <> '' AND {at('definition')} <> '' THEN {at('term')} || ': ' || {at('definition')} END"
        elif kind == "numeric" and "unit" in g:
            expr = f"CASE WHEN {at('value')} <> '' THEN ': ' || {at('value')} || ' ' || {g['unit']}[i] END"
        elif kind == "numeric":
            expr = f"CASE WHEN {at('value')} <> '' THEN {at('context')} || ': ' || {at('value')} END"
        elif kind == "rule" and "subject" in g:
            expr = f"CASE WHEN {at('rule')} <> '' THEN CASE WHEN {at('subject')} <> '' THEN {at('subject')} || ': ' ELSE '' END || {at('rule')} END"
        elif kind == "constraint" and "action" in g:
            expr = f"CASE WHEN {at('condition')} <> '' AND {at('action')} <> '' THEN 'Somente ' || {at('condition')} || ' pode ' || {at('action')} END"
        elif kind == "constraint" and "context" in g:
            expr = f"CASE WHEN {at('constraint')} <> '' THEN CASE WHEN {at('context')} <> '' THEN {at('context')} || ': ' ELSE '' END || {at('constraint')} END"
        else:
            expr = f"CASE WHEN {at(names[0])} <> '' THEN {at(names[0])} END"
        lists.append(f"SELECT doc_id, body, {i} AS p, unnest({n}) AS i, '{kind}' AS kind, unnest([{expr} FOR i IN {n}]) AS content FROM b")
    generic = S.contains_any("lower(content)", fixed.GENERIC_WORDS)
    start = "substr(lower(content), 1, 30)"
    return f"""
WITH b AS (SELECT doc_id, {body} AS body FROM documents),
f AS ({' UNION ALL '.join(lists)}),
c AS (SELECT *, substr(lower(trim(content)), 1, 100) AS key, least(100, greatest(0, 70 + CASE WHEN len(content) > 20 THEN 5 ELSE 0 END + CASE WHEN len(content) > 50 THEN 5 ELSE 0 END
    + CASE WHEN kind = 'numeric' AND regexp_matches(content, '\\d+[.,]\\d+') THEN 10 ELSE 0 END - CASE WHEN {generic} THEN 15 ELSE 0 END
    + CASE WHEN (len(lower(body)) - len(replace(lower(body), {start}, ''))) / len({start}) > 1 THEN 5 ELSE 0 END)) / 100.0::DOUBLE AS confidence FROM f WHERE content IS NOT NULL),
k AS (SELECT * FROM c WHERE confidence >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY p, i) = 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, p, i) - 1 AS INTEGER) AS pos FROM k),
facts AS (SELECT doc_id, pos, content, kind AS fact_type, round(confidence, 6) AS confidence FROM r WHERE pos < 50)
"""


FACTS_SQL = facts_sql()


@query("fact_extraction", FACTS_SQL + "SELECT * FROM facts")
def fact_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract.pattern_facts(read_texts(spark, sf, "documents"), ["doc_id"])


@query("document_sync", FACTS_SQL + """,
todo AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
mine AS (SELECT * FROM facts WHERE doc_id IN (SELECT doc_id FROM todo)),
known AS (SELECT DISTINCT content FROM facts WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS documents_checked, CAST((SELECT count(*) FROM todo) AS BIGINT) AS documents_synced,
  CAST((SELECT count(*) FROM mine) AS BIGINT) AS facts_extracted,
  CAST((SELECT count(DISTINCT content) FROM mine WHERE content NOT IN (SELECT content FROM known)) AS BIGINT) AS facts_added""")
def document_sync(spark: SparkSession, sf: str) -> DataFrame:
    docs, processed = read_texts(spark, sf, "documents"), read_table(spark, sf, "labels")
    known = extract.pattern_facts(docs.join(processed.select("doc_id"), "doc_id", "left_semi"), ["doc_id"])
    return extract.sync(docs, processed, known, "doc_id")[1]


def concepts_sql() -> str:
    raw = "replace(replace(replace(text, chr(13), ' '), chr(10), '. '), '; ', '. ')"
    parts = []
    for framework, concept, articles, terms in fixed.CONCEPT_TERMS:
        source = framework + (":" + ",".join(articles) if articles else "")
        parts.append(f"SELECT doc_id, {S.q(framework)} AS framework, {S.q(concept)} AS concept, {S.q(source)} AS source, raw, plain FROM s WHERE {S.contains_any('plain', terms)}")
    return f"""
WITH l AS (SELECT doc_id, {S.points(raw)} AS ss FROM documents),
u AS (SELECT doc_id, unnest(ss) AS raw FROM l),
s AS (SELECT doc_id, raw, {S.squeeze('lower(raw)')} AS plain FROM u),
m AS ({' UNION ALL '.join(parts)}),
n AS (SELECT doc_id, framework, concept, source, raw, {S.contains_any('plain', fixed.CONCEPT_CONSTRAINT_MARKS)} AS forbids FROM m)
SELECT doc_id, framework, concept, source, CAST(least(10, count(DISTINCT raw) FILTER (WHERE NOT forbids)) AS INTEGER) AS facts,
  CAST(least(10, count(DISTINCT raw) FILTER (WHERE forbids)) AS INTEGER) AS constraints FROM n GROUP BY 1, 2, 3, 4"""


@query("concept_extraction", concepts_sql())
def concept_extraction(spark: SparkSession, sf: str) -> DataFrame:
    out = extract.concepts(read_texts(spark, sf, "documents"), ["doc_id"])
    return out.select("doc_id", "framework", "concept", "source", F.size("facts").alias("facts"), F.size("constraints").alias("constraints"))


CHUNK_TOKENS = 250
CHUNK_SQL = f"""
WITH s AS (SELECT doc_id, text, string_split(regexp_replace(text, {S.q('([.!?])' + text.SPACE + '+')}, '\\1{S.MARK}', 'g'), '{S.MARK}') AS ss FROM documents),
f AS (SELECT doc_id, text, list_reduce([{{'done': []::VARCHAR[], 'now': CASE WHEN len(x) > {4 * CHUNK_TOKENS} THEN x ELSE ' ' || x END, 'raw': x}} FOR x IN ss],
  lambda a, b: {{'done': CASE WHEN len(a.now) + len(b.raw) > {4 * CHUNK_TOKENS} AND a.now <> '' THEN list_append(a.done, regexp_replace(a.now, {S.q(f'^{text.SPACE}+|{text.SPACE}+$')}, '', 'g')) ELSE a.done END,
    'now': CASE WHEN len(a.now) + len(b.raw) > {4 * CHUNK_TOKENS} THEN b.raw ELSE a.now || ' ' || b.raw END, 'raw': b.raw}}) AS r FROM s),
c AS (SELECT doc_id, CASE WHEN len(text) <= {4 * CHUNK_TOKENS} THEN [text] WHEN r.now <> '' THEN list_append(r.done, regexp_replace(r.now, {S.q(f'^{text.SPACE}+|{text.SPACE}+$')}, '', 'g')) ELSE r.done END AS chunks FROM f)
"""


@query("chunk_pack", CHUNK_SQL + """
SELECT doc_id, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS pos, md5(unnest(chunks)) AS chunk_md5 FROM c""")
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_texts(spark, sf, "documents")
    return text.each(docs, ["doc_id"], extract.chunks(F.col("text"), CHUNK_TOKENS), "chunk", "pos").select(
        "doc_id", "pos", F.md5("chunk").alias("chunk_md5"))


@query("chunk_regroup", CHUNK_SQL + """
SELECT doc_id, md5(array_to_string(chunks, ' ')) AS content_md5, CAST(len(chunks) AS BIGINT) AS chunks FROM c""")
def chunk_regroup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_texts(spark, sf, "documents")
    rows = text.each(docs, ["doc_id"], extract.chunks(F.col("text"), CHUNK_TOKENS), "content", "pos")
    return extract.regroup(rows, "doc_id", "pos", "content").select("doc_id", F.md5("content").alias("content_md5"), "chunks")


@query("hash_embedding", f"""
WITH w AS (SELECT doc_id, unnest({S.space_words('text')}) AS word FROM documents),
h AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256(word), 1, 8) AS BIGINT) % 128 AS INTEGER) AS dim, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight FROM h""")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    out = vectors.hash_embedding_entries(read_texts(spark, sf, "documents"), "doc_id", "text")
    return out.withColumn("weight", F.round("weight", 9))
