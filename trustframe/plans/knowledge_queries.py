"""Fact, policy, inference and version queries over the TPC-H-like tables, documents and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions import fixed, text, truth
from trustframe.functions.session import read_table, read_texts
from trustframe.operators import guard, infer, knowledge, matching, versions
from trustframe.plans import checks
from trustframe.plans import sqltext as S
from trustframe.plans.guard_queries import RULES, violations_sql
from trustframe.plans.rag_queries import rounded
from trustframe.plans.registry import query

MIN_SENTENCE = 10

# ---------------------------------------------------------------------------- claims against facts


def document_sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = text.each(read_texts(spark, sf, "documents"), ["doc_id"],
                     text.sentences_at_points(F.col("text"), MIN_SENTENCE), "claim", "pos")
    return with_claim_key(docs.withColumn("tenant_id", tenant("doc_id")))


def with_claim_key(claims: DataFrame) -> DataFrame:
    return claims.withColumn("claim_key", F.md5(F.concat("tenant_id", F.lit("|"), "claim")))


def distinct_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Different sentences of each tenant; their keys are made after the shuffle, which they would nearly double."""
    return with_claim_key(document_sentences(spark, sf).select("tenant_id", "claim").distinct())


def tenant(number: str) -> Column:
    """Rows belong to two tenants by their number."""
    return F.concat(F.lit("t"), F.col(number) % 2)


def passage_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return text.each(read_table(spark, sf, "benchmark"), ["item_id"],
                     text.sentences_at_points(F.col("text"), MIN_SENTENCE), "sentence", "pos")


def passage_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark sentences as facts; their state follows the length of the sentence."""
    n = F.length("sentence")
    return passage_sentences(spark, sf).select(
        tenant("item_id").alias("tenant_id"), F.concat(F.lit("item"), "item_id").alias("subject"),
        F.lit("has_fact").alias("relation"), F.col("sentence").alias("object"),
        F.when(n % 3 == 0, F.lit("FALSE")).otherwise(F.lit("TRUE")).alias("state"),
        F.round(0.5 + (n % 50) / 100.0, 2).alias("confidence"))


SENTENCES_SQL = f"""
sents AS (SELECT doc_id, 't' || doc_id % 2 AS tenant, unnest(l) AS claim, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT doc_id, {S.points('text', MIN_SENTENCE)} AS l FROM documents)),
passages AS (SELECT item_id, 't' || item_id % 2 AS tenant, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS spos
  FROM (SELECT item_id, {S.points('text', MIN_SENTENCE)} AS l FROM benchmark)),
"""
RELEVANT_SQL = f"""WITH {SENTENCES_SQL}
cw AS (SELECT tenant, claim, {S.token_set('claim', fixed.OVERLAP_STOPWORDS)} AS words FROM (SELECT DISTINCT tenant, claim FROM sents)),
ct AS (SELECT tenant, claim, len(words) AS n, unnest(words) AS word FROM cw),
fw AS (SELECT tenant, item_id, spos, CASE WHEN len(sentence) % 3 = 0 THEN 'FALSE' ELSE 'TRUE' END AS state,
    round(0.5 + (len(sentence) % 50) / 100.0, 2)::DOUBLE AS confidence,
    {S.token_set("'item' || item_id || ' has_fact ' || sentence", fixed.OVERLAP_STOPWORDS)} AS words FROM passages),
ft AS (SELECT tenant, item_id, spos, state, confidence, unnest(words) AS word FROM fw),
pairs AS (SELECT tenant, claim, n, item_id, spos, state, confidence, count(*) AS overlap FROM ct JOIN ft USING (tenant, word) GROUP BY ALL),
verdicts AS (SELECT tenant, claim, max(CASE WHEN state = 'FALSE' THEN confidence END) AS against,
    max(CASE WHEN state = 'TRUE' THEN confidence END) AS supports FROM pairs WHERE overlap / n >= 0.35 GROUP BY 1, 2),
relevant AS (SELECT tenant, claim, CASE WHEN against IS NOT NULL THEN 'FALSE' ELSE 'TRUE' END AS decision, coalesce(against, supports) AS confidence FROM verdicts)
"""


@query("fact_relevance", RELEVANT_SQL + """
SELECT s.doc_id, s.pos, r.decision, r.confidence FROM sents s JOIN relevant r USING (tenant, claim)""")
def fact_relevance(spark: SparkSession, sf: str) -> DataFrame:
    claims = document_sentences(spark, sf).select(
        "tenant_id", F.struct("doc_id", "pos").alias("claim_key"), text.token_set(F.col("claim"), fixed.OVERLAP_STOPWORDS).alias("words"))
    verdict = knowledge.relevant_facts(claims, passage_facts(spark, sf))
    return verdict.select("claim_key.doc_id", "claim_key.pos", "decision", "confidence")


SIMILAR_SQL = f"""WITH {SENTENCES_SQL}
cw AS (SELECT claim, {S.space_word_set('claim', fixed.SIMILARITY_STOPWORDS)} AS words FROM (SELECT DISTINCT claim FROM sents)),
ct AS (SELECT claim, len(words) AS n, unnest(words) AS word FROM cw),
fw AS (SELECT sentence, {S.space_word_set('sentence', fixed.SIMILARITY_STOPWORDS)} AS words FROM (SELECT DISTINCT sentence FROM passages)),
ft AS (SELECT sentence, len(words) AS m, unnest(words) AS word FROM fw),
pairs AS (SELECT claim, n, sentence, m, count(*) AS overlap FROM ct JOIN ft USING (word) GROUP BY ALL),
scored AS (SELECT claim, sentence, round(overlap / (n + m - overlap), 9) AS similarity FROM pairs WHERE overlap / (n + m - overlap) > 0.5)
"""


@query("similar_facts", SIMILAR_SQL + """
SELECT s.doc_id, s.pos, CAST(count(*) AS BIGINT) AS facts, max(similarity) AS best FROM sents s JOIN scored USING (claim) GROUP BY 1, 2""")
def similar_facts(spark: SparkSession, sf: str) -> DataFrame:
    def sets(frame: DataFrame, column: str) -> DataFrame:
        words = text.space_word_set(F.col(column), fixed.SIMILARITY_STOPWORDS)
        return frame.select(column).distinct().withColumn("words", words).withColumn("key", matching.set_key(F.col("words")))

    sentences = document_sentences(spark, sf)
    claims, facts = sets(sentences, "claim"), sets(passage_sentences(spark, sf), "sentence")
    pairs = matching.match_rows(claims.select(F.col("claim").alias("key"), "words"), facts, matching.jaccard_needed(0.5))
    union = F.col("n_left") + F.col("n_right") - F.col("overlap")
    close = pairs.withColumn("similarity", F.round(F.col("overlap") / union, 9)).filter(F.col("overlap") / union > 0.5)
    copies = facts.groupBy(F.col("key").alias("right_key")).agg(F.count("*").alias("copies"))
    per = close.join(copies, "right_key").groupBy(F.col("left_key").alias("claim")).agg(
        F.sum("copies").alias("facts"), F.max("similarity").alias("best"))
    return sentences.join(per, "claim").select("doc_id", "pos", "facts", "best")


SEARCH_SQL = f"""WITH {SENTENCES_SQL}
cw AS (SELECT tenant, claim, {S.space_word_set('claim')} AS words FROM (SELECT DISTINCT tenant, claim FROM sents)),
ct AS (SELECT tenant, claim, len(words) AS n, unnest(words) AS word FROM cw),
fw AS (SELECT tenant, item_id * 1000 + spos AS fact_id, {S.space_word_set('sentence')} AS words FROM passages),
ft AS (SELECT tenant, fact_id, len(words) AS m, unnest(words) AS word FROM fw),
pairs AS (SELECT tenant, claim, n, fact_id, m, count(*) AS overlap FROM ct JOIN ft USING (tenant, word) GROUP BY ALL),
scored AS (SELECT tenant, claim, fact_id, round(overlap / greatest(n, m), 9) AS score FROM pairs WHERE round(overlap / greatest(n, m), 9) >= 0.3),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY tenant, claim ORDER BY score DESC, fact_id) AS INTEGER) AS rank FROM scored)
"""


def search(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Top passages of the same tenant for every distinct document sentence."""
    sentences = distinct_claims(spark, sf)
    queries = sentences.select("tenant_id", F.col("claim_key").alias("query_id"), F.lower("claim").alias("body"),
                               text.space_word_set(F.col("claim")).alias("words"))
    facts = passage_sentences(spark, sf).select(
        tenant("item_id").alias("tenant_id"), (F.col("item_id") * 1000 + F.col("pos")).alias("fact_id"), text.space_word_set(F.col("sentence")).alias("words"))
    return matching.keyword_search(queries, facts, k, scope=("tenant_id",))


@query("keyword_search", SEARCH_SQL + "SELECT md5(tenant || '|' || claim) AS query_id, fact_id, score, rank FROM ranked WHERE rank <= 5")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return search(spark, sf, 5)


@query("search_verdicts", SEARCH_SQL + """,
v AS (SELECT s.doc_id, s.pos, r.score AS s FROM sents s LEFT JOIN ranked r ON r.tenant = s.tenant AND r.claim = s.claim AND r.rank = 1)
SELECT CASE WHEN s IS NULL THEN 'uncertain' WHEN s >= 0.6 THEN 'verified' WHEN s >= 0.4 THEN 'uncertain' ELSE 'contradicted' END AS status,
  coalesce(s >= 0.6, false) AS supported, CAST(count(*) AS BIGINT) AS claims,
  round(avg(CASE WHEN s IS NULL THEN 0 WHEN s >= 0.85 THEN s WHEN s >= 0.6 THEN s * 0.9 WHEN s >= 0.4 THEN 0.5 ELSE 1 - s END), 6) AS mean_confidence
FROM v GROUP BY 1, 2""")
def search_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    best = search(spark, sf, 1).select(F.col("query_id").alias("claim_key"), "score")
    rows = document_sentences(spark, sf).join(best, "claim_key", "left").withColumn("v", truth.search_verdict(F.col("score")))
    return rows.groupBy(F.col("v.status").alias("status"), F.col("v.supported").alias("supported")).agg(
        F.count("*").alias("claims"), F.round(F.avg("v.confidence"), 6).alias("mean_confidence"))


def ontology_entries(spark: SparkSession, sf: str) -> DataFrame:
    """One entry per passage: its first two words name the concept, its sentences are the facts."""
    items = read_table(spark, sf, "benchmark").withColumn("s", text.sentences_at_points(F.col("text"), MIN_SENTENCE))
    first = F.get("s", 0)
    return items.select(
        tenant("item_id").alias("tenant_id"),
        F.concat_ws(" ", F.slice(F.split(text.squeeze(F.lower("text")), " "), 1, 2)).alias("concept"),
        F.col("text").alias("definition"), F.array().cast("array<string>").alias("synonyms"), F.col("s").alias("facts"),
        F.when((F.length("text") % 2 == 0) & first.isNotNull(), F.array(F.concat(F.lit("never "), first)))
        .otherwise(F.array().cast("array<string>")).alias("constraints"))


ONTOLOGY_SQL = f"""WITH {SENTENCES_SQL}
entries AS (SELECT 't' || item_id % 2 AS tenant, array_to_string(list_slice(string_split({S.squeeze('lower(text)')}, ' '), 1, 2), ' ') AS concept,
    {S.points('text', MIN_SENTENCE)} AS facts, len(text) % 2 = 0 AS strict FROM benchmark),
claims AS (SELECT DISTINCT tenant, claim FROM sents),
named AS (SELECT c.tenant, c.claim, lower(c.claim) AS body, e.concept, e.facts, CASE WHEN e.strict AND len(e.facts) > 0 THEN lower('never ' || e.facts[1]) END AS rule,
    {S.space_word_set('c.claim', fixed.SIMILARITY_STOPWORDS)} AS words, {S.space_word_set('c.claim', fixed.CONSTRAINT_NEGATIONS)} AS plain
  FROM claims c JOIN entries e ON c.tenant = e.tenant AND contains(lower(c.claim), e.concept)),
sims AS (SELECT tenant, claim, concept, sim FROM (SELECT tenant, claim, concept, words, {S.space_word_set('f', fixed.SIMILARITY_STOPWORDS)} AS fw
    FROM (SELECT tenant, claim, concept, words, unnest(facts) AS f FROM named)), LATERAL (SELECT
    CASE WHEN len(words) = 0 OR len(fw) = 0 THEN 0 ELSE len(list_intersect(words, fw)) / len(list_distinct(list_concat(words, fw))) END AS sim)),
supports AS (SELECT tenant, claim, count(*) AS supporting, sum(sim) AS total FROM sims WHERE sim > 0.5 GROUP BY 1, 2),
sides AS (SELECT tenant, claim, count(*) AS concepts, count(*) FILTER (WHERE rule IS NOT NULL
    AND len(list_intersect(plain, {S.space_word_set("coalesce(rule, '')", fixed.CONSTRAINT_NEGATIONS)})) >= 2
    AND {S.contains_any('body', fixed.CONSTRAINT_NEGATIONS)} <> {S.contains_any("coalesce(rule, '')", fixed.CONSTRAINT_NEGATIONS)}) AS contradicting
  FROM named GROUP BY 1, 2),
verdicts AS (SELECT s.tenant, s.claim, concepts, coalesce(supporting, 0) AS supporting, contradicting,
    CASE WHEN contradicting > 0 THEN 'FALSE' WHEN supporting > 0 THEN 'TRUE' ELSE 'UNDECIDABLE' END AS decision,
    CASE WHEN contradicting > 0 THEN 0.8 WHEN supporting > 0 THEN least(0.9, total / supporting + 0.2) ELSE 0.3 END AS confidence
  FROM sides s LEFT JOIN supports USING (tenant, claim))
"""


def ontology_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    claims = distinct_claims(spark, sf)
    return knowledge.ontology_check(claims, ontology_entries(spark, sf))


@query("ontology_claim_check", ONTOLOGY_SQL + """
SELECT s.doc_id, s.pos, CAST(concepts AS BIGINT) AS concepts, CAST(supporting AS BIGINT) AS supporting,
  CAST(contradicting AS BIGINT) AS contradicting, decision, round(confidence, 9)::DOUBLE AS confidence FROM sents s JOIN verdicts USING (tenant, claim)""")
def ontology_claim_check(spark: SparkSession, sf: str) -> DataFrame:
    out = document_sentences(spark, sf).join(ontology_verdicts(spark, sf), "claim_key")
    return out.select("doc_id", "pos", "concepts", "supporting", "contradicting", "decision",
                      F.round("confidence", 9).alias("confidence"))


@query("hallucination_counts", ONTOLOGY_SQL + """
SELECT s.doc_id, CAST(count(*) AS BIGINT) AS claims, CAST(count(*) FILTER (WHERE coalesce(decision, 'UNDECIDABLE') <> 'TRUE') AS BIGINT) AS hallucinations
FROM sents s LEFT JOIN verdicts USING (tenant, claim) GROUP BY 1""")
def hallucination_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = document_sentences(spark, sf).join(ontology_verdicts(spark, sf), "claim_key", "left")
    return out.groupBy("doc_id").agg(
        F.count("*").alias("claims"),
        F.count_if(F.coalesce("decision", F.lit("UNDECIDABLE")) != "TRUE").alias("hallucinations"))


@query("entry_expand", f"""
WITH entries AS (SELECT array_to_string(list_slice(string_split({S.squeeze('lower(text)')}, ' '), 1, 2), ' ') AS concept,
    text, {S.points('text', MIN_SENTENCE)} AS facts FROM benchmark)
SELECT concept AS subject, 'is_a' AS relation, 'concept' AS object, 'concept' AS fact_type, 0.8::DOUBLE AS confidence FROM entries
UNION ALL SELECT concept, 'defined_as', text, 'definition', 0.8 FROM entries
UNION ALL SELECT concept, 'has_fact', unnest(facts), 'fact', 0.8 FROM entries
UNION ALL SELECT concept, 'constrained_by', 'never ' || facts[1], 'constraint', 0.8 FROM entries WHERE len(text) % 2 = 0 AND len(facts) > 0""")
def entry_expand(spark: SparkSession, sf: str) -> DataFrame:
    entries = ontology_entries(spark, sf)
    frame = entries.select(
        "tenant_id", F.lit("passages").alias("ontology_id"), "concept", "definition", "synonyms",
        F.array().cast("array<string>").alias("related_concepts"), "facts", "constraints",
        F.lit("benchmark").alias("source"), F.lit("probable").alias("confidence"))
    return knowledge.facts_from_entries(frame).select("subject", "relation", "object", "fact_type", "confidence")


# ---------------------------------------------------------------------------- composite checks

CHECK_SQL = f"""{RELEVANT_SQL},
viol AS (SELECT DISTINCT claim FROM ({violations_sql('sents', 'doc_id, pos, claim', 'claim')}) v WHERE severity IN ('critical', 'high')),
checked AS (
  SELECT s.doc_id, s.pos, s.claim, CASE WHEN v.claim IS NOT NULL THEN 'FALSE' ELSE coalesce(r.decision, 'UNDECIDABLE') END AS decision,
    CASE WHEN v.claim IS NOT NULL THEN 'compliance' WHEN r.claim IS NOT NULL THEN 'ontology' ELSE 'none' END AS source,
    CASE WHEN v.claim IS NOT NULL THEN 1.0 ELSE coalesce(r.confidence, 0.0) END AS confidence
  FROM sents s LEFT JOIN viol v USING (claim) LEFT JOIN relevant r USING (tenant, claim))
"""

def checked_claims(spark: SparkSession, sf: str) -> DataFrame:
    return checks.claim_check(document_sentences(spark, sf), RULES, facts=passage_facts(spark, sf))


@query("claim_check", CHECK_SQL + """
SELECT source, decision, CAST(count(*) AS BIGINT) AS claims, round(avg(confidence), 6) AS mean_confidence FROM checked GROUP BY 1, 2""")
def claim_check(spark: SparkSession, sf: str) -> DataFrame:
    return checked_claims(spark, sf).groupBy("source", "decision").agg(
        F.count("*").alias("claims"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


ANSWER_SQL = CHECK_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
labelled AS (SELECT doc_id, pos, CASE decision WHEN 'TRUE' THEN 'supported' WHEN 'FALSE' THEN 'contradicted' ELSE 'unsupported' END AS label,
    confidence::DOUBLE AS conf, pos > 0 AND {S.depends('claim')} AS depends FROM checked),
chain AS (
  SELECT doc_id, pos, label, conf FROM labelled WHERE NOT depends
  UNION ALL
  SELECT l.doc_id, l.pos, CASE WHEN c.label = 'contradicted' THEN 'contradicted' WHEN c.label = 'unsupported' AND l.label = 'supported' THEN 'unsupported' ELSE l.label END,
    l.conf * (0.15 + 0.85 * c.conf) FROM chain c JOIN labelled l ON l.doc_id = c.doc_id AND l.pos = c.pos + 1 AND l.depends),
per AS (SELECT doc_id, count(*) AS claims, bool_or(label = 'contradicted') AS con, bool_or(label = 'unsupported') AS uns, min(conf) AS conf FROM chain GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(claims, 0) AS BIGINT) AS claims,
  CASE WHEN claims IS NULL THEN 'UNDECIDABLE' WHEN con THEN 'FALSE' WHEN uns THEN 'UNDECIDABLE' ELSE 'TRUE' END AS decision,
  CASE WHEN claims IS NULL THEN 'abstain' WHEN con THEN 'block' WHEN uns THEN 'retry' ELSE 'allow' END AS recommended_action,
  round(coalesce(conf, 0), 6) AS confidence FROM documents d LEFT JOIN per USING (doc_id)"""


@query("answer_decision", ANSWER_SQL)
def answer_decision(spark: SparkSession, sf: str) -> DataFrame:
    answers = read_table(spark, sf, "documents").select("doc_id")
    unique = answers.groupBy("doc_id").count().filter("count > 1").isEmpty()
    out = checks.answer_check(answers, checked_claims(spark, sf), ["doc_id"], unique)
    return out.select("doc_id", "claims", "decision", "recommended_action", F.round("confidence", 6).alias("confidence"))


POLICIES = [
    ("p1", "buyers may", "submit", "urgent orders", "TRUE", 0.9, "BUILDING", "URGENT", "O", ""),
    ("p2", "machinery", "never", "high f", "FALSE", 0.8, "MACHINERY", "HIGH", "", ""),
    ("p3", "automobile furniture", "place", "low medium orders p o", "TRUE", 0.7, "*", "LOW", "*", ""),
    ("p4", "household", "blocked", "urgent p", "FALSE", 0.95, "HOUSEHOLD", "*", "P", "asia"),
    ("p5", "anyone", "places", "medium", "TRUE", 0.6, "AUTOMOBILE", "MEDIUM", "F", "*"),
]
#: One tenant has all policies, the other all but the last.
TENANT_POLICIES = [("t0", *p) for p in POLICIES] + [("t1", *p) for p in POLICIES[:-1]]
POLICY_DDL = ("tenant_id string, policy_id string, subject string, relation string, object string, state string, confidence double, "
              "actor string, action string, resource string, purpose string")


def policy_sql_rows() -> str:
    rows = []
    for owner, pid, s, r, o, state, conf, actor, action, resource, purpose in TENANT_POLICIES:
        words = [w for w in f"{s} {r} {o}".lower().split() if w not in fixed.OVERLAP_STOPWORDS]
        fields = [S.word_list(words if f in ("", "*") else [f.lower()]) for f in (actor, action, resource)]
        rows.append(f"({S.q(owner)}, {S.q(pid)}, {S.q(state)}, {conf}::DOUBLE, {fields[0]}, {fields[1]}, {fields[2]}, {S.q(purpose.lower())})")
    return ", ".join(rows)


@query("action_authorisation", f"""
WITH p(tenant, policy_id, state, confidence, actors, acts, resources, purpose) AS (VALUES {policy_sql_rows()}),
a AS (SELECT o_orderkey, 't' || c_custkey % 2 AS tenant, lower(c_mktsegment) AS actor, lower(regexp_replace(o_orderpriority, '^[^A-Z]*', '')) AS act,
    lower(o_orderstatus) AS res, CASE WHEN c_nationkey < 10 THEN 'asia' ELSE '' END AS purpose FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT a.*, max(CASE WHEN p.state = 'FALSE' THEN p.confidence END) AS denied, max(CASE WHEN p.state = 'TRUE' THEN p.confidence END) AS allowed
  FROM a LEFT JOIN p ON p.tenant = a.tenant AND list_contains(p.actors, actor) AND list_contains(p.acts, act) AND list_contains(p.resources, res)
    AND (p.purpose IN ('', '*') OR a.purpose = '' OR a.purpose = p.purpose) GROUP BY ALL)
SELECT o_orderkey, CASE WHEN denied IS NOT NULL THEN 'FALSE' WHEN allowed IS NOT NULL THEN 'TRUE' ELSE 'UNDECIDABLE' END AS decision,
  CASE WHEN denied IS NOT NULL THEN 'policy_denied' WHEN allowed IS NOT NULL THEN 'policy_allowed' ELSE 'policy_missing' END AS status,
  coalesce(denied, allowed, 0) AS confidence FROM m""")
def action_authorisation(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = read_table(spark, sf, "orders"), read_table(spark, sf, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    actions = joined.select(
        "o_orderkey", tenant("c_custkey").alias("tenant_id"), F.col("c_mktsegment").alias("actor"),
        F.regexp_replace("o_orderpriority", "^[^A-Z]*", "").alias("action"), F.col("o_orderstatus").alias("resource"),
        F.when(F.col("c_nationkey") < 10, F.lit("asia")).otherwise(F.lit("")).alias("purpose"))
    policies = spark.createDataFrame(TENANT_POLICIES, POLICY_DDL)
    return knowledge.action_check(actions, policies).select("o_orderkey", "decision", "status", "confidence")


TEXT_POLICIES = [
    knowledge.TextPolicy("t1", "FALSE", 0.9, "network", "address", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", None),
    knowledge.TextPolicy("t2", "TRUE", 0.7, "the that this and with", "from have were", None, "output"),
    knowledge.TextPolicy("t3", "FALSE", 0.9, "input", "only", "token", "input"),
]


def policy_hit_sql(p: knowledge.TextPolicy) -> str:
    import re
    own = sorted({w for w in re.findall(r"\w+", f"{p.subject} {p.object}".lower())} - set(fixed.OVERLAP_STOPWORDS))
    hit = f"(len(w) > 0 AND len(list_intersect(w, {S.word_list(own)})) / len(w) >= 0.35)"
    return f"({hit} OR regexp_matches(text, {S.q('(?i)' + p.pattern)}))" if p.pattern else hit


@query("policy_scan", f"""
WITH v AS ({violations_sql('documents', 'doc_id')}),
b AS (SELECT doc_id, bool_or(severity IN ('critical', 'high')) AS blocks FROM v GROUP BY 1),
d AS (SELECT doc_id, text, {S.token_set('text', fixed.OVERLAP_STOPWORDS)} AS w FROM documents),
h AS (SELECT doc_id, {policy_hit_sql(TEXT_POLICIES[0])} AS denied, {policy_hit_sql(TEXT_POLICIES[1])} AS allowed FROM d)
SELECT h.doc_id, CASE WHEN denied OR coalesce(blocks, false) THEN 'FALSE' WHEN blocks IS NOT NULL THEN 'UNDECIDABLE' ELSE 'TRUE' END AS decision,
  CASE WHEN denied OR coalesce(blocks, false) THEN 'block' WHEN blocks IS NOT NULL THEN 'warn' ELSE 'allow' END AS recommended_action,
  CASE WHEN denied OR coalesce(blocks, false) THEN 1.0 WHEN blocks IS NOT NULL THEN 0.5 WHEN allowed THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence
FROM h LEFT JOIN b USING (doc_id)""")
def policy_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_texts(spark, sf, "documents").select("doc_id", "text")
    return knowledge.policy_check(docs, "text", TEXT_POLICIES, RULES).select(
        "doc_id", "decision", "recommended_action", "confidence")


# ---------------------------------------------------------------------------- consistency

def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as hypotheses about parts and suppliers, in line order with a ship time."""
    relation = (F.when(F.col("l_returnflag") == "A", F.lit("same_as")).when(F.col("l_returnflag") == "R", F.lit("equivalent"))
                .otherwise(F.lit("near")))
    return read_table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("subject"), relation.alias("relation"),
        F.col("l_suppkey").cast("string").alias("object"), "l_orderkey", "l_linenumber",
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"))


def stored_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Stored facts: the inverse pairs of well discounted lines, and FALSE facts of small ones."""
    items = read_table(spark, sf, "lineitem")
    relation = (F.when(F.col("l_returnflag") == "A", F.lit("same_as")).when(F.col("l_returnflag") == "R", F.lit("equivalent"))
                .otherwise(F.lit("near")))
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    inverse = items.filter("l_discount > 0.07").select(
        key.alias("fact_id"), F.col("l_suppkey").cast("string").alias("subject"), relation.alias("relation"),
        F.col("l_partkey").cast("string").alias("object"), F.lit("TRUE").alias("state"))
    false = items.filter("l_quantity < 3").select(
        key.alias("fact_id"), F.col("l_partkey").cast("string").alias("subject"), relation.alias("relation"),
        F.col("l_suppkey").cast("string").alias("object"), F.lit("FALSE").alias("state"))
    return inverse.unionByName(false)


HYPOTHESES_SQL = """
WITH h AS (SELECT l_partkey::VARCHAR AS subject, CASE l_returnflag WHEN 'A' THEN 'same_as' WHEN 'R' THEN 'equivalent' ELSE 'near' END AS relation,
    l_suppkey::VARCHAR AS object, l_orderkey, l_linenumber, l_shipdate AS t, l_discount, l_quantity FROM lineitem),
false_facts AS (SELECT subject, relation, object, min(l_orderkey * 100 + l_linenumber) AS fact_id FROM h WHERE l_quantity < 3 GROUP BY 1, 2, 3),
true_facts AS (SELECT DISTINCT object AS subject, relation, subject AS object FROM h WHERE l_discount > 0.07),
contradictions AS (SELECT h.subject, h.relation, h.object, h.l_orderkey, h.l_linenumber, f.fact_id FROM h JOIN false_facts f USING (subject, relation, object)),
steps AS (SELECT subject, relation, t, lag(t) OVER (PARTITION BY subject, relation ORDER BY l_orderkey, l_linenumber, t) AS earlier FROM h),
time_issues AS (SELECT subject, relation, count(*) FILTER (WHERE earlier > t) AS back_steps, count(*) AS points FROM steps GROUP BY 1, 2 HAVING count(*) FILTER (WHERE earlier > t) > 0),
sym AS (SELECT DISTINCT subject, relation, object FROM h WHERE relation IN ('same_as', 'equals', 'equivalent')),
inverse_issues AS (SELECT s.* FROM sym s WHERE NOT EXISTS (SELECT 1 FROM sym i WHERE i.subject = s.object AND i.relation = s.relation AND i.object = s.subject)
  AND NOT EXISTS (SELECT 1 FROM true_facts i WHERE i.subject = s.object AND i.relation = s.relation AND i.object = s.subject))
"""


@query("symbolic_contradictions", HYPOTHESES_SQL + "SELECT * FROM contradictions")
def symbolic_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.symbolic_contradictions(hypotheses(spark, sf).drop("t"), stored_facts(spark, sf))


@query("temporal_consistency", HYPOTHESES_SQL + """
SELECT subject, relation, CAST(back_steps AS BIGINT) AS back_steps, CAST(points AS BIGINT) AS points FROM time_issues""")
def temporal_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.non_monotonic(hypotheses(spark, sf), ["l_orderkey", "l_linenumber", "t"], "t")


@query("missing_inverse", HYPOTHESES_SQL + "SELECT * FROM inverse_issues")
def missing_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.missing_inverse(hypotheses(spark, sf), stored_facts(spark, sf))


@query("validation_cascade", HYPOTHESES_SQL + """
SELECT CAST((SELECT count(*) FROM contradictions) AS BIGINT) AS contradictions, CAST((SELECT count(*) FROM time_issues) AS BIGINT) AS time_issues,
  CAST((SELECT count(*) FROM inverse_issues) AS BIGINT) AS inverse_issues,
  CASE WHEN (SELECT count(*) FROM contradictions) > 0 THEN 'blocked' ELSE 'warn' END AS verdict""")
def validation_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.cascade_verdict(hypotheses(spark, sf), stored_facts(spark, sf), ["l_orderkey", "l_linenumber", "t"], "t")


EVENT_RELATIONS = [("click", "accesses"), ("view", "spreads"), ("error", "causes_harm"), ("signup", "modifies"),
                   ("purchase", "dados_publicos")]


def event_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as facts with a probability state from their value."""
    names = F.create_map(*[F.lit(x) for pair in EVENT_RELATIONS for x in pair])
    p = F.least(F.lit(1.0), F.col("value") / 60.0)
    kind = F.when(F.col("value") > 40, F.lit("sensitive-misinformation")).otherwise(F.lit("plain"))
    return read_table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("user"), "user_id").alias("subject"),
        F.element_at(names, F.col("event_type")).alias("relation"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("cpf "), "user_id"))
        .when((F.col("event_type") == "signup") & (F.col("value") > 30), F.lit("protected_system"))
        .otherwise(kind).alias("object"),
        truth.state(p, F.round((1 - p) * 0.25, 9), F.round((1 - p) * 0.75, 9)).alias("probability"))


CONSTRAINT_SQL = """
WITH f AS (SELECT event_id, event_type, value, least(1.0, value / 60.0) AS p FROM events),
v AS (
  SELECT event_id, 'no_physical_harm' AS "constraint", 'safety' AS kind, 'critical' AS severity, 'block' AS action FROM f WHERE event_type = 'error' AND p >= 0.3
  UNION ALL SELECT event_id, 'sensitive_data_protection', 'privacy', 'high', 'warn' FROM f WHERE event_type = 'click' AND value > 40
  UNION ALL SELECT event_id, 'controlled_self_modification', 'safety', 'critical', 'block' FROM f WHERE event_type = 'signup' AND value > 30 AND p >= 0.3
  UNION ALL SELECT event_id, 'misinformation_prevention', 'ethical', 'medium', 'warn' FROM f WHERE event_type = 'view' AND value > 40
  UNION ALL SELECT event_id, 'personal_data_protection', 'privacy', 'critical', 'block' FROM f WHERE event_type = 'purchase' AND p >= 0.3)
"""


@query("constraint_scan", CONSTRAINT_SQL + "SELECT * FROM v")
def constraint_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = knowledge.constraint_violations(event_facts(spark, sf), knowledge.default_constraints())
    return out.select("event_id", "constraint", "kind", "severity", "action")


@query("constraint_stats", CONSTRAINT_SQL + """
SELECT kind, severity, CAST(count(*) AS BIGINT) AS violations, CAST(count(DISTINCT "constraint") AS BIGINT) AS constraints FROM v GROUP BY 1, 2""")
def constraint_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = knowledge.constraint_violations(event_facts(spark, sf), knowledge.default_constraints())
    per = out.groupBy("kind", "severity", "constraint").agg(F.count("*").alias("n"))
    return per.groupBy("kind", "severity").agg(F.sum("n").alias("violations"), F.count("*").alias("constraints"))


@query("state_algebra", """
WITH s AS (SELECT event_type, user_id, least(1.0, value / 60.0)::DOUBLE AS p FROM events),
n AS (SELECT event_type, user_id, p AS t, round((1 - p) * 0.25, 9) AS f, round((1 - p) * 0.75, 9) AS u FROM s),
m AS (SELECT event_type, user_id, t / (t + f + u) AS t, f / (t + f + u) AS f, u / (t + f + u) AS u FROM n),
g AS (SELECT event_type, user_id, product(t) AS a_t, 1 - product(1 - f) AS a_f, 1 - product(1 - t) AS o_t, product(f) AS o_f FROM m GROUP BY 1, 2)
SELECT event_type, user_id, round(a_t, 6) AS and_true, round(a_f, 6) AS and_false, round(o_t, 6) AS or_true, round(o_f, 6) AS or_false,
  CASE WHEN round(a_t, 9) >= 0.6 AND round(a_t, 9) - greatest(round(a_f, 9), round(greatest(0, 1 - a_t - a_f), 9)) >= 0.05 THEN 'TRUE'
       WHEN round(a_f, 9) >= 0.6 AND round(a_f, 9) - greatest(round(a_t, 9), round(greatest(0, 1 - a_t - a_f), 9)) >= 0.05 THEN 'FALSE' ELSE 'UNDECIDABLE' END AS and_decision
FROM g""")
def state_algebra(spark: SparkSession, sf: str) -> DataFrame:
    p = F.least(F.lit(1.0), F.col("value") / 60.0)
    states = read_table(spark, sf, "events").select(
        "event_type", "user_id", truth.state(p, F.round((1 - p) * 0.25, 9), F.round((1 - p) * 0.75, 9)).alias("s"))
    out = states.groupBy("event_type", "user_id").agg(
        truth.conjoin_all(F.col("s")).alias("a"), truth.disjoin_all(F.col("s")).alias("o"))
    nine = text.record(**{c: F.round(F.col("a")[c], 9) for c in ("p_true", "p_false", "p_und")})
    return out.withColumn("n", nine).select(
        "event_type", "user_id", F.round("a.p_true", 6).alias("and_true"), F.round("a.p_false", 6).alias("and_false"),
        F.round("o.p_true", 6).alias("or_true"), F.round("o.p_false", 6).alias("or_false"),
        truth.decide(F.col("n")).alias("and_decision"))


# ---------------------------------------------------------------------------- places: facts, closure, goals

def place_states(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers are in nations, nations in regions, regions in the world."""
    def located(frame: DataFrame, subject, obj, false=F.lit(0.0)) -> DataFrame:
        return frame.select(subject.alias("subject"), F.lit("located_in").alias("relation"), obj.alias("object"),
                            truth.state(F.lit(0.9), false, F.lit(0.1) - false).alias("state"))

    nation = F.concat(F.lit("n"), "n_nationkey")
    owed = lambda c: F.when(F.col(c) < 0, F.lit(0.05)).otherwise(F.lit(0.0))
    parts = [
        located(read_table(spark, sf, "supplier"), F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), owed("s_acctbal")),
        located(read_table(spark, sf, "customer"), F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), owed("c_acctbal")),
        located(read_table(spark, sf, "nation"), nation, F.concat(F.lit("r"), "n_regionkey")),
        located(read_table(spark, sf, "region"), F.concat(F.lit("r"), "r_regionkey"), F.lit("world"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def and_rule(a: str, b: str) -> str:
    """SQL of one derivation: AND of two states, then a rule confidence of 0.9."""
    return f"""t * 0.9 AS t, CASE WHEN f + u > 0 THEN f * (1 - t * 0.9) / (f + u) ELSE (1 - t * 0.9) / 2 END AS f, steps FROM (
      SELECT *, greatest(0, 1 - t - f) AS u FROM (SELECT {a}.subject, {b}.object, {a}.t * {b}.t AS t, {a}.f + {b}.f - {a}.f * {b}.f AS f, {a}.steps + {b}.steps AS steps"""


PLACES_SQL = f"""
WITH base AS (
  SELECT 's' || s_suppkey AS subject, 'n' || s_nationkey AS object, 0.9::DOUBLE AS t, CASE WHEN s_acctbal < 0 THEN 0.05 ELSE 0.0 END::DOUBLE AS f, 1 AS steps FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 0.9, CASE WHEN c_acctbal < 0 THEN 0.05 ELSE 0.0 END, 1 FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.9, 0.0, 1 FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'world', 0.9, 0.0, 1 FROM region),
round1 AS (SELECT subject, object, {and_rule('a', 'b')} FROM base a JOIN base b ON a.object = b.subject))),
round2 AS (
  SELECT subject, object, {and_rule('a', 'b')} FROM round1 a JOIN base b ON a.object = b.subject))
  UNION ALL SELECT subject, object, {and_rule('a', 'b')} FROM base a JOIN round1 b ON a.object = b.subject))),
merged2 AS (SELECT subject, object, 1 - product(1 - t) AS t, product(f) AS f, min(steps) AS steps FROM round2 GROUP BY 1, 2),
closure AS (SELECT *, 0 AS round FROM base UNION ALL SELECT *, 1 FROM round1 UNION ALL SELECT *, 2 FROM merged2)
"""


def closure(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return infer.forward_chain(place_states(spark, sf), [infer.transitivity("located_in", 0.9)])


@query("fact_closure", PLACES_SQL + """
SELECT subject, object, round(t, 9) AS p_true, round(f, 9) AS p_false, round(greatest(0, 1 - t - f), 9) AS p_und, CAST(steps AS BIGINT) AS steps FROM closure""")
def fact_closure(spark: SparkSession, sf: str) -> DataFrame:
    facts, _ = closure(spark, sf)
    return facts.select("subject", "object", *[F.round(f"state.{c}", 9).alias(c) for c in ("p_true", "p_false", "p_und")], "steps")


@query("derivation_steps", PLACES_SQL + """
SELECT subject, object, 'transitivity_located_in' AS rule, 1 AS round, CAST(steps AS BIGINT) AS steps, round(t, 9) AS p_true FROM round1
UNION ALL SELECT subject, object, 'transitivity_located_in', 2, CAST(steps AS BIGINT), round(t, 9) FROM round2""")
def derivation_steps(spark: SparkSession, sf: str) -> DataFrame:
    _, derivations = closure(spark, sf)
    return derivations.select("subject", "object", "rule", "round", "steps", F.round("state.p_true", 9).alias("p_true"))


GOALS_SQL = PLACES_SQL + """,
goals AS (SELECT 'c' || c_custkey AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'world' ELSE 'r' || (c_custkey % 5) END AS object FROM customer),
verdicts AS (SELECT g.subject, g.object, CASE WHEN c.t IS NULL THEN 'undecidable' WHEN c.f > c.t AND c.f >= 1 - c.t - c.f THEN 'rejected' ELSE 'proved' END AS verdict, c.steps
  FROM goals g LEFT JOIN closure c USING (subject, object))
"""


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    goals = read_table(spark, sf, "customer").select(
        F.concat(F.lit("c"), key).alias("subject"), F.lit("located_in").alias("relation"),
        F.when(key % 3 == 0, F.lit("world")).otherwise(F.concat(F.lit("r"), key % 5)).alias("object"))
    return infer.prove(goals, closure(spark, sf)[0])


@query("goal_proofs", GOALS_SQL + """
SELECT subject, object, verdict, CASE WHEN verdict = 'proved' THEN CAST(steps AS BIGINT) END AS proof_steps,
  CASE WHEN verdict = 'proved' THEN round(1.0 / (1 + steps), 9) ELSE 0.0 END::DOUBLE AS score FROM verdicts""")
def goal_proofs(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).select("subject", "object", "verdict", "proof_steps", F.round("score", 9).alias("score"))


@query("goal_proof_facts", """
WITH c AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS n, 'r' || n_regionkey AS r, 'r' || (c_custkey % 5) AS wanted, c_custkey % 3 = 0 AS world
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
g AS (SELECT * FROM c WHERE r = wanted), w AS (SELECT * FROM c WHERE world),
rows AS (
  SELECT s, 'governed_by' AS goal, 0 AS level, s AS subject, 'governed_by' AS relation, r AS object, 'governed' AS rule, 2 AS premises FROM g
  UNION ALL SELECT s, 'governed_by', 1, s, 'located_in', r, 'transitivity_located_in', 2 FROM g
  UNION ALL SELECT s, 'governed_by', 1, r, 'located_in', 'world', NULL, NULL FROM g
  UNION ALL SELECT s, 'governed_by', 2, s, 'located_in', n, NULL, NULL FROM g
  UNION ALL SELECT s, 'governed_by', 2, n, 'located_in', r, NULL, NULL FROM g
  UNION ALL SELECT s, 'located_in', 0, s, 'located_in', 'world', 'transitivity_located_in', 2 FROM w
  UNION ALL SELECT s, 'located_in', 1, s, 'located_in', n, NULL, NULL FROM w
  UNION ALL SELECT s, 'located_in', 1, n, 'located_in', 'world', 'transitivity_located_in', 2 FROM w
  UNION ALL SELECT s, 'located_in', 2, n, 'located_in', r, NULL, NULL FROM w
  UNION ALL SELECT s, 'located_in', 2, r, 'located_in', 'world', NULL, NULL FROM w)
SELECT s AS goal_subject, goal AS goal_relation, level, subject, relation, object, rule, premises FROM rows""")
def goal_proof_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs of what governs each customer and, for every third, that it is in the world; two rules, three levels."""
    key = F.col("c_custkey")
    customers = read_table(spark, sf, "customer")
    subject = F.concat(F.lit("c"), key).alias("subject")
    goals = customers.select(subject, F.lit("governed_by").alias("relation"), F.concat(F.lit("r"), key % 5).alias("object"))
    goals = goals.unionByName(customers.where(key % 3 == 0).select(
        subject, F.lit("located_in").alias("relation"), F.lit("world").alias("object")))
    rules = [infer.transitivity("located_in", 0.9), infer.Rule(
        "governed", ("?x", "governed_by", "?z"), [("?x", "located_in", "?z"), ("?z", "located_in", "world")], 0.9)]
    _, proofs = infer.prove_goals(goals, place_states(spark, sf), rules)
    return proofs.select(F.col("subject").alias("goal_subject"), F.col("relation").alias("goal_relation"), "level",
                         "fact.*", "rule", F.when(F.col("rule").isNotNull(), F.size("premises")).alias("premises"))


@query("hypothesis_verdicts", GOALS_SQL + """
SELECT verdict, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN verdict = 'proved' THEN 1.0 / (1 + steps) ELSE 0 END), 9) AS score FROM verdicts GROUP BY 1""")
def hypothesis_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("score"))


@query("fact_explanations", PLACES_SQL + """
SELECT 'n' || n_nationkey AS target, 0 AS level, CAST(count(*) AS BIGINT) AS derivations, 2 AS premises
FROM nation JOIN round1 ON round1.subject = 'n' || n_nationkey AND round1.object = 'world' GROUP BY 1""")
def fact_explanations(spark: SparkSession, sf: str) -> DataFrame:
    _, derivations = closure(spark, sf)
    targets = read_table(spark, sf, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("subject"), F.lit("located_in").alias("relation"), F.lit("world").alias("object"))
    out = infer.explain(targets, derivations)
    return out.groupBy(F.col("target.subject").alias("target"), "level").agg(
        F.count("*").alias("derivations"), F.max(F.size("premises")).alias("premises"))


@query("fact_query", """
SELECT 's' || s_suppkey AS who, 'n' || s_nationkey AS place, 'TRUE' AS state FROM supplier
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'TRUE' FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'TRUE' FROM nation
UNION ALL SELECT 'r' || r_regionkey, 'world', 'TRUE' FROM region""")
def fact_query(spark: SparkSession, sf: str) -> DataFrame:
    facts = knowledge.facts_from_states(place_states(spark, sf), "tenant")
    return knowledge.find(facts, "?who", "located_in", "?place", "TRUE").select("who", "place", "state")


@query("fact_neighbourhood", """
WITH f AS (SELECT 's' || s_suppkey AS subject, 'n' || s_nationkey AS object FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region), nodes AS (SELECT 'n' || n_nationkey AS node FROM nation)
SELECT object AS node, 'in' AS direction, CAST(count(*) AS BIGINT) AS facts FROM f WHERE object IN (SELECT node FROM nodes) GROUP BY 1
UNION ALL SELECT subject, 'out', CAST(count(*) AS BIGINT) FROM f WHERE subject IN (SELECT node FROM nodes) GROUP BY 1""")
def fact_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    nodes = read_table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    touched = knowledge.neighbourhood(place_states(spark, sf), nodes)
    node = F.when(F.col("direction") == "in", F.col("object")).otherwise(F.col("subject"))
    return touched.groupBy(node.alias("node"), "direction").agg(F.count("*").alias("facts"))


@query("ontology_stats", """
WITH f AS (SELECT 'user' || user_id AS subject, event_type AS relation, CASE WHEN value > 40 THEN 'high' ELSE 'low' END AS object,
  CASE WHEN value > 60 THEN 'TRUE' WHEN value > 20 THEN 'UNDECIDABLE' ELSE 'FALSE' END AS state FROM events)
SELECT 'facts' AS metric, 'all' AS name, CAST(count(*) AS BIGINT) AS value FROM f
UNION ALL SELECT 'state', state, CAST(count(*) AS BIGINT) FROM f GROUP BY state
UNION ALL SELECT 'relation', relation, CAST(count(*) AS BIGINT) FROM f GROUP BY relation
UNION ALL SELECT 'nodes', 'all', CAST(count(*) AS BIGINT) FROM (SELECT subject FROM f UNION SELECT object FROM f)
UNION ALL SELECT 'edges', 'all', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT subject, object FROM f)""")
def ontology_stats(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    facts = read_table(spark, sf, "events").select(
        F.concat(F.lit("user"), "user_id").alias("subject"), F.col("event_type").alias("relation"),
        F.when(v > 40, F.lit("high")).otherwise(F.lit("low")).alias("object"),
        F.when(v > 60, F.lit("TRUE")).when(v > 20, F.lit("UNDECIDABLE")).otherwise(F.lit("FALSE")).alias("state"))
    return knowledge.statistics(facts)


@query("undecided_facts", """
WITH s AS (SELECT event_id, least(1.0, value / 60.0)::DOUBLE AS p FROM events)
SELECT event_id FROM s WHERE round((1 - p) * 0.75, 9) > p AND round((1 - p) * 0.75, 9) > round((1 - p) * 0.25, 9)""")
def undecided_facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = event_facts(spark, sf).withColumnRenamed("probability", "state")
    return knowledge.contradictory(facts).select("event_id")


# ---------------------------------------------------------------------------- ingestion and versions

@query("fact_ingest", """
WITH e AS (SELECT CASE WHEN l_discount > 0 THEN l_orderkey::VARCHAR END AS subject, 'has_status' AS relation, l_linestatus AS object,
    CASE WHEN l_returnflag = 'R' THEN 'FALSE' ELSE 'TRUE' END AS state, l_returnflag AS source FROM lineitem),
k AS (SELECT o_orderkey::VARCHAR AS subject, 'has_status' AS relation, o_orderstatus AS object,
    CASE WHEN o_totalprice > 250000 THEN 'TRUE' ELSE 'FALSE' END AS state FROM orders),
j AS (SELECT e.source, CASE WHEN e.subject IS NULL THEN 'skipped' WHEN k.state IS NULL THEN 'imported' WHEN k.state = e.state THEN 'skipped' ELSE 'conflict' END AS fate
  FROM e LEFT JOIN k USING (subject, relation, object))
SELECT source, CAST(count(*) FILTER (WHERE fate = 'imported') AS BIGINT) AS imported, CAST(count(*) FILTER (WHERE fate = 'skipped') AS BIGINT) AS skipped,
  CAST(count(*) FILTER (WHERE fate = 'conflict') AS BIGINT) AS conflict FROM j GROUP BY 1""")
def fact_ingest(spark: SparkSession, sf: str) -> DataFrame:
    entries = read_table(spark, sf, "lineitem").select(
        F.when(F.col("l_discount") > 0, F.col("l_orderkey").cast("string")).alias("subject"),
        F.lit("has_status").alias("relation"), F.col("l_linestatus").alias("object"),
        F.when(F.col("l_returnflag") == "R", F.lit("FALSE")).otherwise(F.lit("TRUE")).alias("state"),
        F.col("l_returnflag").alias("source"))
    existing = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("subject"), F.lit("has_status").alias("relation"),
        F.col("o_orderstatus").alias("object"),
        F.when(F.col("o_totalprice") > 250000, F.lit("TRUE")).otherwise(F.lit("FALSE")).alias("state"))
    return knowledge.ingest_counts(entries, existing, "source")


ADDS_SQL = """
WITH adds AS (SELECT o_orderkey, o_orderdate, o_orderpriority AS ontology, o_custkey::VARCHAR AS subject, 'placed_with' AS relation, o_orderstatus AS object,
    CASE WHEN o_totalprice > 300000 THEN 'TRUE' WHEN o_totalprice > 150000 THEN 'UNDECIDABLE' ELSE 'FALSE' END AS state,
    strftime(o_orderdate, '%Y%m%d')::BIGINT * 100000000 + o_orderkey AS seq FROM orders),
firsts AS (SELECT ontology, subject, relation, object, state, min(seq) AS first FROM adds GROUP BY ALL),
judged AS (SELECT a.*, a.seq = f.first AS accepted, count(*) OVER (PARTITION BY ontology, subject, relation, object) AS dummy,
    (SELECT count(*) FROM firsts g WHERE g.ontology = a.ontology AND g.subject = a.subject AND g.object = a.object) > 1 AS conflict
  FROM adds a JOIN firsts f USING (ontology, subject, relation, object, state)),
versioned AS (SELECT *, 1 + sum(accepted::INT) OVER (PARTITION BY ontology ORDER BY seq ROWS UNBOUNDED PRECEDING) AS to_version FROM judged)
"""


def accepted_adds(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    adds = read_table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("ontology"), F.col("o_custkey").cast("string").alias("subject"),
        F.lit("placed_with").alias("relation"), F.col("o_orderstatus").alias("object"),
        F.when(p > 300000, F.lit("TRUE")).when(p > 150000, F.lit("UNDECIDABLE")).otherwise(F.lit("FALSE")).alias("state"),
        (F.date_format("o_orderdate", "yyyyMMdd").cast("bigint") * 100000000 + F.col("o_orderkey")).alias("seq"))
    keys = ["ontology", *knowledge.TRIPLE]
    return knowledge.accept_facts(adds, adds.select(*keys, "state").limit(0), keys, "seq")


@query("fact_dedup_conflict", ADDS_SQL + "SELECT o_orderkey, accepted, conflict FROM judged")
def fact_dedup_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return accepted_adds(spark, sf).select("o_orderkey", "accepted", "conflict")


@query("fact_versions", ADDS_SQL + """
SELECT o_orderkey, ontology, accepted, CAST(to_version - accepted::INT AS BIGINT) AS from_version, CAST(to_version AS BIGINT) AS to_version FROM versioned""")
def fact_versions(spark: SparkSession, sf: str) -> DataFrame:
    out = versions.number_versions(accepted_adds(spark, sf), "ontology", ["seq"])
    return out.select("o_orderkey", "ontology", "accepted", "from_version", "to_version")


@query("migration_log", ADDS_SQL + """
SELECT ontology, 'add_fact' AS action, CAST(to_version - 1 AS BIGINT) AS from_version, CAST(to_version AS BIGINT) AS to_version, seq
FROM versioned WHERE accepted ORDER BY seq DESC LIMIT 100""")
def migration_log(spark: SparkSession, sf: str) -> DataFrame:
    out = versions.number_versions(accepted_adds(spark, sf), "ontology", ["seq"])
    return versions.newest(versions.migrations(out, "ontology", ["seq"]), "seq", 100)


LEFT_BEFORE, RIGHT_FROM = "1998-01-01", "1996-01-01"


def order_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the order facts: up to a date, and from an earlier date on with new states."""
    base = F.when(F.col("o_orderstatus") == "F", F.lit("FALSE")).when(
        F.col("o_orderstatus") == "O", F.lit("TRUE")).otherwise(F.lit("UNDECIDABLE"))
    facts = read_table(spark, sf, "orders").select(
        F.concat(F.lit("order"), "o_orderkey").alias("subject"), F.lit("has_priority").alias("relation"),
        F.col("o_orderpriority").alias("object"), "o_orderdate", "o_totalprice", base.alias("state"))
    left = facts.filter(F.col("o_orderdate") < F.lit(LEFT_BEFORE).cast("timestamp"))
    right = facts.filter(F.col("o_orderdate") >= F.lit(RIGHT_FROM).cast("timestamp")).withColumn(
        "state", F.when(F.col("o_totalprice") > 250000, F.lit("TRUE")).otherwise(F.col("state")))
    columns = [*knowledge.TRIPLE, "state"]
    return left.select(*columns), right.select(*columns)


DIFF_SQL = f"""
WITH o AS (SELECT 'order' || o_orderkey AS subject, 'has_priority' AS relation, o_orderpriority AS object, o_orderdate, o_totalprice,
    CASE o_orderstatus WHEN 'F' THEN 'FALSE' WHEN 'O' THEN 'TRUE' ELSE 'UNDECIDABLE' END AS state FROM orders),
l AS (SELECT subject, relation, object, state FROM o WHERE o_orderdate < TIMESTAMP '{LEFT_BEFORE}'),
r AS (SELECT subject, relation, object, CASE WHEN o_totalprice > 250000 THEN 'TRUE' ELSE state END AS state FROM o WHERE o_orderdate >= TIMESTAMP '{RIGHT_FROM}'),
d AS (SELECT coalesce(l.subject, r.subject) AS subject, coalesce(l.relation, r.relation) AS relation, coalesce(l.object, r.object) AS object,
    CASE WHEN l.state IS NULL THEN 'added' WHEN r.state IS NULL THEN 'removed' WHEN l.state <> r.state THEN 'updated' END AS change,
    l.state AS from_state, r.state AS to_state FROM l FULL JOIN r ON l.subject = r.subject AND l.relation = r.relation AND l.object = r.object)
"""


@query("snapshot_diff", DIFF_SQL + "SELECT * FROM d WHERE change IS NOT NULL")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    left, right = order_versions(spark, sf)
    return versions.diff(left, right, knowledge.TRIPLE, ["state"])


@query("snapshot_diff_summary", DIFF_SQL + "SELECT change, CAST(count(*) AS BIGINT) AS n FROM d WHERE change IS NOT NULL GROUP BY 1")
def snapshot_diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    left, right = order_versions(spark, sf)
    return versions.diff_summary(versions.diff(left, right, knowledge.TRIPLE, ["state"]))


def snapshot_table(spark: SparkSession, sf: str) -> DataFrame:
    left, right = order_versions(spark, sf)
    return versions.take_snapshot(left, "snap_19980101", "1998-01-01 00:00:00", 1, "first").unionByName(
        versions.take_snapshot(right, "snap_19990101", "1999-01-01 00:00:00", 2, "second"))


@query("snapshot_list", DIFF_SQL + """
SELECT 'snap_19980101' AS snapshot_id, 'first' AS snapshot_name, 1 AS version, CAST(count(*) AS BIGINT) AS fact_count FROM l
UNION ALL SELECT 'snap_19990101', 'second', 2, CAST(count(*) AS BIGINT) FROM r""")
def snapshot_list(spark: SparkSession, sf: str) -> DataFrame:
    return versions.list_snapshots(snapshot_table(spark, sf)).drop("captured_at")


@query("snapshot_rollback", DIFF_SQL + "SELECT subject, relation, object, state, 3 AS version FROM l")
def snapshot_rollback(spark: SparkSession, sf: str) -> DataFrame:
    snapshots = snapshot_table(spark, sf)
    return versions.rollback(order_versions(spark, sf)[1], snapshots, "snap_19980101", 3)[0]


UPSERT_SQL = """
WITH c AS (SELECT p_partkey AS rule_id, CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END AS severity, p_brand AS standard FROM part),
ch AS (SELECT l_partkey AS rule_id, CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 20 THEN 'medium' ELSE 'low' END AS severity,
    l_linestatus AS standard, CASE WHEN l_returnflag = 'R' THEN 'delete' ELSE 'upsert' END AS op, l_orderkey, l_linenumber,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem)
SELECT coalesce(n.rule_id, c.rule_id) AS rule_id, CASE WHEN n.rule_id IS NULL THEN c.severity ELSE n.severity END AS severity,
  CASE WHEN n.rule_id IS NULL THEN c.standard ELSE n.standard END AS standard
FROM c FULL JOIN (SELECT * FROM ch WHERE rn = 1) n ON n.rule_id = c.rule_id WHERE coalesce(n.op, 'keep') <> 'delete'"""


@query("rule_upsert", UPSERT_SQL)
def rule_upsert(spark: SparkSession, sf: str) -> DataFrame:
    current = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("rule_id"),
        F.when(F.col("p_size") > 25, F.lit("high")).otherwise(F.lit("low")).alias("severity"), F.col("p_brand").alias("standard"))
    q = F.col("l_quantity")
    changes = read_table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("rule_id"),
        F.when(q > 40, F.lit("critical")).when(q > 20, F.lit("medium")).otherwise(F.lit("low")).alias("severity"),
        F.col("l_linestatus").alias("standard"),
        F.when(F.col("l_returnflag") == "R", F.lit("delete")).otherwise(F.lit("upsert")).alias("op"),
        "l_orderkey", "l_linenumber", "l_extendedprice")
    return versions.upsert(current, changes, ["rule_id"], ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("entry_upsert", """
WITH e AS (SELECT p_brand AS ontology, lower(p_name) AS concept, p_partkey, p_type,
  row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey DESC) AS rn FROM part)
SELECT ontology, concept, p_type AS definition FROM e WHERE rn = 1 AND p_type <> 'SMALL'""")
def entry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    changes = read_table(spark, sf, "part").select(
        F.col("p_brand").alias("ontology"), F.lower("p_name").alias("concept"), F.col("p_type").alias("definition"),
        F.when(F.col("p_type") == "SMALL", F.lit("delete")).otherwise(F.lit("upsert")).alias("op"), "p_partkey")
    current = changes.select("ontology", "concept", "definition").limit(0)
    return versions.upsert(current, changes, ["ontology", "concept"], ["p_partkey"])


@query("entry_listing", """
WITH e AS (SELECT p_brand AS ontology, lower(p_name) AS concept, p_type, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey DESC) AS rn FROM part)
SELECT ontology, CAST(count(*) AS BIGINT) AS entries FROM e WHERE rn = 1 AND p_type <> 'SMALL' GROUP BY 1""")
def entry_listing(spark: SparkSession, sf: str) -> DataFrame:
    return versions.entry_counts(entry_upsert(spark, sf), ["ontology"])
