"""Groundedness queries: assistant turns are answers, the two turns before them are contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions import costs, splitters, text
from trustframe.functions.session import read_texts
from trustframe.operators import generate, ground
from trustframe.plans import sqltext as S
from trustframe.plans.registry import query

KEYS = ["conv_id", "turn"]
HEAVY_MODEL = "gpt-4o-mini"
OUTPUT_CHARS = 47


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with their contexts. The contexts come by an equi-join on (conv_id, turn)."""
    turns = read_texts(spark, sf, "conversations")
    context = (turns.select("conv_id", F.explode(F.array(F.col("turn") + 1, F.col("turn") + 2)).alias("turn"),
                            F.struct(F.col("turn").alias("doc_id"), "text").alias("context"))
               .groupBy(*KEYS).agg(F.array_sort(F.collect_list("context")).alias("contexts")))
    answers = turns.filter("role = 'assistant'").select(*KEYS, F.col("text").alias("answer"))
    empty = F.array().cast(context.schema["contexts"].dataType)
    return answers.join(context, KEYS, "left").withColumn("contexts", F.coalesce("contexts", empty))


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ground.evidence(ground.claim_rows(samples(spark, sf), KEYS))


CLAIMS_SQL = f"""
answers AS (SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'),
lists AS (SELECT *, {S.claims('answer')} AS cs FROM answers),
claims AS (
  SELECT conv_id, turn, answer, unnest(cs) AS claim, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS pos
  FROM lists),
"""
EVIDENCE_SQL = f"""
WITH {CLAIMS_SQL}
prepared AS (
  SELECT *, {S.tokens('claim')} AS cw, {S.numbers('claim')} AS cn FROM claims),
contexts AS (
  SELECT conv_id, turn AS doc_id, lower(text) AS body, {S.tokens('text')} AS tw, {S.numbers('text')} AS tn
  FROM conversations),
runs AS (
  SELECT conv_id, doc_id, body, tn, list_distinct(tw) AS words, {S.runs('tw')} AS runs FROM contexts),
claim_runs AS (SELECT *, {S.runs('cw')} AS cr FROM prepared),
pairs AS (
  SELECT c.conv_id, c.turn, c.pos, c.claim, c.answer, r.doc_id, c.cn, r.tn, c.cw, r.words, r.body,
    CASE WHEN contains(r.body, lower(c.claim)) THEN 100.0
         WHEN len(c.cr) = 0 THEN 0.0
         ELSE round(100.0::DOUBLE * {S.common('c.cr', 'CASE WHEN len(c.cw) >= 3 THEN r.runs ELSE r.words END')} / len(c.cr), 6)
    END::DOUBLE AS score,
    CASE WHEN len(c.cw) = 0 THEN 0.0 ELSE round(100.0::DOUBLE * {S.common('list_distinct(c.cw)', 'r.words')} / len(list_distinct(c.cw)), 6) END::DOUBLE AS ws
  FROM claim_runs c JOIN runs r ON r.conv_id = c.conv_id AND r.doc_id BETWEEN c.turn - 2 AND c.turn - 1),
labelled AS (
  SELECT *, CASE WHEN ws >= 40 AND {S.numeric_conflict('cn', 'tn')} THEN 'contradicted'
                 WHEN score >= 75 THEN 'supported' ELSE 'unsupported' END AS label
  FROM pairs),
best AS (
  SELECT * FROM labelled
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY score DESC, doc_id) = 1),
scored AS (
  SELECT c.conv_id, c.turn, c.pos, c.claim, c.answer, coalesce(b.label, 'unsupported') AS own_label,
         coalesce(CASE WHEN b.label = 'contradicted' THEN b.ws ELSE b.score END, 0) / 100.0 AS own_conf, b.doc_id, b.body, b.cw, b.words,
         c.pos > 0 AND {S.depends('c.claim')} AS depends
  FROM claims c LEFT JOIN best b USING (conv_id, turn, pos)),
"""


@query("claims_split", f"""
WITH {CLAIMS_SQL} last AS (SELECT 1)
SELECT conv_id, turn, pos, claim, len(claim) AS n_chars FROM claims""")
def claims_split(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_texts(spark, sf, "conversations").filter("role = 'assistant'")
    rows = text.each(turns, KEYS, text.claims(F.col("text")), "claim", "pos")
    return rows.withColumn("n_chars", F.length("claim").cast("bigint"))


@query("claims_by_line", """
WITH l AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[\\n;]')) AS line, generate_subscripts(string_split_regex(text, '[\\n;]'), 1) AS k FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, k, trim(regexp_replace(line, '^[ \\t]*([-*]|[0-9]+[.)])[ \\t]+', ''), E' \\t\\r') AS claim FROM l)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS INTEGER) AS pos, claim FROM c WHERE len(claim) >= 5""")
def claims_by_line(spark: SparkSession, sf: str) -> DataFrame:
    """Claims by another splitter than the library's own, as a table function."""
    turns = read_texts(spark, sf, "conversations").where("role = 'assistant'").withColumn("answer", F.col("text"))
    return ground.split_answers(turns, KEYS, splitters.LineSplitter)


@query("numeric_conflicts", f"""
WITH m AS (SELECT DISTINCT doc_id, coalesce(source, '') AS source, n[2] AS unit, n[1] AS value FROM (SELECT doc_id, source, unnest({S.numbers('text')}) AS n FROM documents)),
t AS (SELECT source, unit, doc_id, count(*) AS c, min(value) AS only FROM m GROUP BY 1, 2, 3)
SELECT m.doc_id, m.source, m.unit, m.value, (SELECT count(*) FROM m x WHERE x.source = m.source AND x.unit = m.unit AND x.value = m.value) AS n_same,
  (SELECT count(*) FROM t WHERE t.source = m.source AND t.unit = m.unit AND NOT (t.c = 1 AND t.only = m.value)) AS n_other,
  (SELECT min(x.value::HUGEINT)::VARCHAR FROM m x WHERE x.source = m.source AND x.unit = m.unit) AS low,
  (SELECT max(x.value::HUGEINT)::VARCHAR FROM m x WHERE x.source = m.source AND x.unit = m.unit) AS high FROM m""")
def numeric_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of every document against all documents of its source."""
    found = ground.conflicting_numbers(read_texts(spark, sf, "documents"), "doc_id", "text", ["source"])
    return found.withColumns({c: F.col(c).cast("string") for c in ("low", "high")})


DOC_CLAIMS_SQL = f"""
WITH lists AS (SELECT doc_id, lang, {S.claims('text')} AS cs FROM documents)
SELECT lang, CAST(count(*) AS BIGINT) AS documents, CAST(sum(len(cs)) AS BIGINT) AS claims,
  CAST(sum(list_sum([len(c) FOR c IN cs])) AS BIGINT) AS claim_chars
FROM lists GROUP BY lang"""


@query("document_claims", DOC_CLAIMS_SQL)
def document_claims(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_texts(spark, sf, "documents").select("lang", text.claims(F.col("text")).alias("cs"))
    chars = F.aggregate("cs", F.lit(0).cast("bigint"), lambda a, c: a + F.length(c))
    return docs.groupBy("lang").agg(
        F.count("*").alias("documents"), F.sum(F.size("cs")).alias("claims"), F.sum(chars).alias("claim_chars"))


@query("claim_dependencies", f"""
WITH {CLAIMS_SQL} last AS (SELECT 1)
SELECT conv_id, turn, pos AS child, pos - 1 AS parent FROM claims WHERE pos > 0 AND {S.depends('claim')}""")
def claim_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_texts(spark, sf, "conversations").filter("role = 'assistant'")
    rows = text.each(turns, KEYS, text.claims(F.col("text")), "claim", "child")
    rows = rows.filter((F.col("child") > 0) & text.depends_on_previous(F.col("claim")))
    return rows.select(*KEYS, "child", (F.col("child") - 1).alias("parent"))


@query("evidence_match", EVIDENCE_SQL + """
spans AS (
  SELECT *, instr(body, lower(claim)) AS exact,
    list_min([instr(body, w) - 1 FOR w IN cw IF list_contains(words, w)]) AS first_word,
    list_max([instr(body, w) - 1 + len(w) FOR w IN cw IF list_contains(words, w)]) AS last_word
  FROM scored)
SELECT conv_id, turn, pos, own_label AS label, round(own_conf, 6) AS confidence, doc_id AS evidence_doc,
  CAST(CASE WHEN exact > 0 THEN exact - 1 ELSE first_word END AS INTEGER) AS evidence_start,
  CAST(CASE WHEN exact > 0 THEN exact - 1 + len(claim) ELSE last_word END AS INTEGER) AS evidence_end
FROM spans""")
def evidence_match(spark: SparkSession, sf: str) -> DataFrame:
    return evidence_rows(spark, sf).select(
        *KEYS, "pos", "label", F.round("confidence", 6).alias("confidence"), "evidence_doc",
        "evidence_start", "evidence_end")


#: The table of distances row by row: v is edits * 1000000 - start, so that the least v has the fewest edits and, of
#: these, the latest start; a running minimum brings in the insertions.
ALIGNMENT_SQL = f"""
WITH RECURSIVE {CLAIMS_SQL}
pairs AS (SELECT row_number() OVER () AS id, c.conv_id, c.turn, c.pos, lower(c.claim) AS claim, t.turn AS doc_id, lower(t.text) AS body
  FROM claims c JOIN conversations t ON t.conv_id = c.conv_id AND t.turn = c.turn - 1),
cells AS (SELECT id, claim, 0 AS j, '' AS ch FROM pairs UNION ALL
  SELECT id, claim, generate_subscripts(string_split(body, ''), 1), unnest(string_split(body, '')) FROM pairs WHERE len(body) > 0),
grid AS (SELECT id, claim, 0 AS i, j, ch, CAST(-j AS BIGINT) AS v FROM cells
  UNION ALL
  SELECT id, claim, i + 1, j, ch, min(t - j * 1000000) OVER (PARTITION BY id ORDER BY j) + j * 1000000 FROM (
    SELECT *, least(v + 1000000, lag(v) OVER (PARTITION BY id ORDER BY j) + CASE WHEN ch = claim[i + 1] THEN 0 ELSE 1000000 END) AS t
    FROM grid WHERE i < len(claim))),
ends AS (SELECT id, j, v, (v + 999999) // 1000000 AS edits FROM grid WHERE i = len(claim)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY (v + 999999) // 1000000, j) = 1)
SELECT conv_id, turn, pos, doc_id AS evidence_doc, CAST(edits AS INTEGER) AS edits, round(100.0::DOUBLE * (1 - edits / len(claim)), 6) AS score,
  CAST(edits * 1000000 - v AS INTEGER) AS "start", CAST(j AS INTEGER) AS "end" FROM pairs JOIN ends USING (id)"""


@query("evidence_alignment", ALIGNMENT_SQL)
def evidence_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Every claim of every assistant turn against the turn before it, by edits."""
    turns = read_texts(spark, sf, "conversations")
    answers = turns.where("role = 'assistant'").select(*KEYS, text.claims(F.col("text")).alias("claims"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("doc_id"), "text")
    found = ground.aligned_evidence(answers, before, KEYS).where("evidence_doc IS NOT NULL")
    return found.select(*KEYS, "pos", "evidence_doc", "edits", F.round("score", 6).alias("score"), "start", "end")


NUMBERS_SQL = f"""
WITH d AS (SELECT doc_id, text, {S.numbers('text')} AS ns FROM documents),
pairs AS (SELECT a.doc_id, b.doc_id AS next_id, a.ns AS an, b.ns AS bn FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, next_id, CAST(len(an) AS INTEGER) AS numbers, CAST(len(bn) AS INTEGER) AS next_numbers,
  {S.numeric_conflict('an', 'bn')} AS conflict
FROM pairs WHERE len(an) > 0 AND len(bn) > 0"""


@query("numeric_contradiction", NUMBERS_SQL)
def numeric_contradiction(spark: SparkSession, sf: str) -> DataFrame:
    docs = (read_texts(spark, sf, "documents")
            .select("doc_id", text.numbers_with_units(F.col("text")).alias("numbers")).filter(F.size("numbers") > 0))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("next_id"),
                        F.col("numbers").alias("next"))
    pairs = docs.join(after, "doc_id")
    return pairs.select("doc_id", "next_id", F.size("numbers").alias("numbers"),
                        F.size("next").alias("next_numbers"),
                        text.numeric_conflict(F.col("numbers"), F.col("next")).alias("conflict"))


CHAIN_SQL = EVIDENCE_SQL + """
RECURSIVE_CHAIN AS (
  SELECT conv_id, turn, pos, own_label AS label, own_conf AS conf FROM scored WHERE NOT depends
  UNION ALL
  SELECT s.conv_id, s.turn, s.pos,
    CASE WHEN c.label = 'contradicted' THEN 'contradicted'
         WHEN c.label = 'unsupported' AND s.own_label = 'supported' THEN 'unsupported' ELSE s.own_label END,
    s.own_conf * (0.15 + 0.85 * c.conf)
  FROM RECURSIVE_CHAIN c JOIN scored s ON s.conv_id = c.conv_id AND s.turn = c.turn AND s.pos = c.pos + 1 AND s.depends),
"""
CHAIN_SQL = CHAIN_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_CHAIN", "chain")


@query("claim_propagation", CHAIN_SQL + """
last AS (SELECT 1)
SELECT conv_id, turn, c.pos, s.own_label, round(s.own_conf, 6) AS own_confidence, c.label,
  round(c.conf, 6) AS confidence
FROM chain c JOIN scored s USING (conv_id, turn, pos)""")
def claim_propagation(spark: SparkSession, sf: str) -> DataFrame:
    out = ground.propagate_chain(evidence_rows(spark, sf), KEYS)
    return out.select(*KEYS, "pos", "own_label", F.round("own_confidence", 6).alias("own_confidence"), "label",
                      F.round("confidence", 6).alias("confidence"))


@query("claim_graph_text")
def claim_graph_text(spark: SparkSession, sf: str) -> DataFrame:
    return ground.graph_text(ground.propagate_chain(evidence_rows(spark, sf), KEYS), KEYS)


ORPHAN_SQL = f"""
WITH {CLAIMS_SQL}
items AS (SELECT conv_id, turn, pos, pos > 0 AND {S.depends('claim')} AS depends,
    array_to_string(list_sort({S.space_words('claim')}), ' ') AS words FROM claims),
orphans AS (SELECT i.* FROM items i WHERE NOT i.depends AND NOT EXISTS (
    SELECT 1 FROM items n WHERE n.conv_id = i.conv_id AND n.turn = i.turn AND n.pos = i.pos + 1 AND n.depends)),
pairs AS (SELECT o.conv_id, o.turn, o.pos AS child, p.pos AS parent,
    1 - {S.edit_distance('o.words', 'p.words')} / greatest(len(o.words), len(p.words)) AS similarity
  FROM orphans o JOIN items p ON p.conv_id = o.conv_id AND p.turn = o.turn AND p.pos <> o.pos)
SELECT conv_id, turn, parent, child, round(similarity, 9) AS similarity FROM pairs WHERE similarity >= 0.72
QUALIFY row_number() OVER (PARTITION BY conv_id, turn, child ORDER BY similarity DESC, parent) = 1"""


@query("orphan_links", ORPHAN_SQL)
def orphan_links(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_texts(spark, sf, "conversations").filter("role = 'assistant'")
    rows = text.each(turns, KEYS, text.claims(F.col("text")), "claim", "pos")
    rows = rows.withColumn("depends", (F.col("pos") > 0) & text.depends_on_previous(F.col("claim")))
    return ground.link_orphans(rows, KEYS)


@query("claim_support_scores", CHAIN_SQL + """
last AS (SELECT 1)
SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS claims,
  CAST(count(*) FILTER (WHERE label = 'supported') AS BIGINT) AS supported,
  CAST(count(*) FILTER (WHERE label = 'contradicted') AS BIGINT) AS contradicted,
  CAST(count(*) FILTER (WHERE label = 'unsupported') AS BIGINT) AS unsupported,
  round(count(*) FILTER (WHERE label = 'supported') / count(*), 9) AS support_rate
FROM chain GROUP BY 1, 2""")
def claim_support_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = ground.support_scores(ground.propagate_chain(evidence_rows(spark, sf), KEYS), KEYS)
    return scores.withColumn("support_rate", F.round("support_rate", 9))


CONFLICT_SQL = CHAIN_SQL + f"""
sides AS (
  SELECT conv_id, turn, pos, count(*) AS contexts, bool_or(label = 'supported') AS sup,
         bool_or(label = 'contradicted') AS con FROM labelled GROUP BY 1, 2, 3),
adjudicated AS (
  SELECT s.conv_id, s.turn, s.pos, s.claim, s.answer, s.own_label, c.label AS chain_label, c.conf AS chain_conf,
    CASE WHEN coalesce(x.contexts, 0) < 2 THEN 'no_conflict_possible'
         WHEN x.sup AND x.con AND NOT ({S.divergence('s.answer')} OR {S.divergence('s.claim')})
           THEN 'arbitrary_unilateral_choice'
         WHEN x.sup AND x.con THEN 'adjudicated_correctly' ELSE 'consistent_sources' END AS source_status
  FROM scored s JOIN chain c USING (conv_id, turn, pos) LEFT JOIN sides x USING (conv_id, turn, pos)),
final AS (
  SELECT *, CASE WHEN source_status = 'arbitrary_unilateral_choice' THEN 'contradicted' ELSE chain_label END AS label,
    CASE WHEN source_status = 'arbitrary_unilateral_choice' THEN greatest(0.1, chain_conf - 0.5) ELSE chain_conf END AS conf
  FROM adjudicated),
"""


@query("source_conflict", CONFLICT_SQL + """
last AS (SELECT 1)
SELECT conv_id, turn, pos, source_status, label, round(conf, 6) AS confidence FROM final""")
def source_conflict(spark: SparkSession, sf: str) -> DataFrame:
    chained = ground.propagate_chain(evidence_rows(spark, sf), KEYS, ["context_labels", "answer"])
    return ground.adjudicate(chained).select(
        *KEYS, "pos", "source_status", "label", F.round("confidence", 6).alias("confidence"))


SPANS_SQL = CONFLICT_SQL + f"""
found AS (
  SELECT conv_id, turn, answer, instr(lower({S.squeeze('answer')}), lower(claim)) - 1 AS s,
         instr(lower({S.squeeze('answer')}), lower(claim)) - 1 + len(claim) AS e
  FROM final WHERE label <> 'supported'),
marked AS (
  SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY conv_id, turn ORDER BY s, e
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh
  FROM found WHERE s >= 0),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (
  SELECT conv_id, turn, island, min(s) AS s, max(e) AS e FROM islands GROUP BY 1, 2, 3),
chars AS (SELECT conv_id, turn, sum(e - s) AS unsupported_chars, count(*) AS n_spans FROM merged GROUP BY 1, 2),
"""

RISK_SQL = SPANS_SQL + f"""
counts AS (
  SELECT conv_id, turn, any_value(answer) AS answer, count(*) AS claims,
    count(*) FILTER (WHERE own_label = 'supported') / count(*) AS raw,
    count(*) FILTER (WHERE label = 'supported') / count(*) AS propagated,
    count(*) FILTER (WHERE own_label = 'contradicted') AS contradicted,
    count(*) FILTER (WHERE source_status IN ('arbitrary_unilateral_choice', 'adjudicated_correctly')) AS conflicting,
    count(*) FILTER (WHERE source_status = 'arbitrary_unilateral_choice') AS penalized,
    min(conf) AS least_conf,
    avg(greatest(1, (1 - conf <= 0.70)::INT + 2 * (1 - greatest(0, 1 - conf) / 2 <= 0.70)::INT)) AS set_size
  FROM final GROUP BY 1, 2),
risks AS (
  SELECT c.*, coalesce(h.unsupported_chars, 0) AS unsupported_chars, coalesce(h.n_spans, 0) AS n_spans,
    len({S.squeeze('c.answer')}) AS total_chars,
    CASE WHEN c.contradicted > 0 THEN 1.0
         ELSE least(1.0, greatest(0.0, 0.7 * (1 - c.raw) + 0.3 * coalesce(h.unsupported_chars, 0) / len({S.squeeze('c.answer')}))) END AS risk
  FROM counts c LEFT JOIN chars h USING (conv_id, turn))
"""


@query("groundedness_report", RISK_SQL + """
SELECT conv_id, turn, CAST(claims AS BIGINT) AS claims, round(raw, 9) AS support_rate_raw,
  round(propagated, 9) AS support_rate_propagated, CAST(contradicted AS BIGINT) AS contradicted,
  CAST(conflicting AS BIGINT) AS conflicting_claims, CAST(penalized AS BIGINT) AS penalized_claims,
  round(set_size, 9) AS mean_set_size, round(least_conf, 6) AS least_confidence,
  CAST(unsupported_chars AS INTEGER) AS unsupported_chars, CAST(total_chars AS INTEGER) AS total_chars,
  CAST(n_spans AS INTEGER) AS n_spans, round(risk, 9) AS risk, round(risk, 9) >= 0.40 AS recommend_abstention
FROM risks""")
def groundedness_report(spark: SparkSession, sf: str) -> DataFrame:
    report = ground.evaluate(samples(spark, sf), KEYS)
    return report.select(
        *KEYS, "claims", F.round("support_rate_raw", 9).alias("support_rate_raw"),
        F.round("support_rate_propagated", 9).alias("support_rate_propagated"), "contradicted",
        "conflicting_claims", "penalized_claims", F.round("mean_set_size", 9).alias("mean_set_size"),
        F.round("least_confidence", 6).alias("least_confidence"), "unsupported_chars", "total_chars",
        F.size("spans").alias("n_spans"), F.round("risk", 9).alias("risk"),
        (F.round("risk", 9) >= 0.40).alias("recommend_abstention"))


@query("abstention_risk", RISK_SQL + """
SELECT CAST(count(*) AS BIGINT) AS answers, round(avg(risk), 9) AS mean_risk,
  CAST(count(*) FILTER (WHERE round(risk, 9) >= 0.40) AS BIGINT) AS abstain,
  round(avg(unsupported_chars / total_chars), 9) AS mean_unsupported_rate FROM risks""")
def abstention_risk(spark: SparkSession, sf: str) -> DataFrame:
    report = ground.evaluate(samples(spark, sf), KEYS)
    return report.agg(F.count("*").alias("answers"), F.round(F.avg("risk"), 9).alias("mean_risk"),
                      F.count_if(F.round("risk", 9) >= 0.40).alias("abstain"),
                      F.round(F.avg("unsupported_rate"), 9).alias("mean_unsupported_rate"))


@query("unsupported_span_merge", SPANS_SQL + """
last AS (SELECT 1)
SELECT conv_id, turn, CAST(s AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end FROM merged""")
def unsupported_span_merge(spark: SparkSession, sf: str) -> DataFrame:
    report = ground.evaluate(samples(spark, sf), KEYS)
    return report.select(*KEYS, F.explode("spans").alias("s")).select(
        *KEYS, F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query("top_unsupported", RISK_SQL + """
SELECT conv_id, turn, CAST(unsupported_chars AS INTEGER) AS unsupported_chars FROM risks
WHERE unsupported_chars > 0 ORDER BY conv_id, turn LIMIT 5""")
def top_unsupported(spark: SparkSession, sf: str) -> DataFrame:
    report = ground.evaluate(samples(spark, sf), KEYS)
    return (report.filter("unsupported_chars > 0").orderBy(*KEYS).limit(5)
            .select(*KEYS, "unsupported_chars"))


GOLD_SQL = EVIDENCE_SQL + f"""
gold AS (
  SELECT conv_id, turn, pos AS gpos, regexp_replace(claim, '^(\\S+) ', '\\1 não ') AS text,
    CASE WHEN len(claim) % 2 = 0 THEN 'supported' ELSE 'unsupported' END AS label FROM claims),
sims AS (
  SELECT s.conv_id, s.turn, s.pos, s.own_label AS label, g.label AS gold_label, g.gpos,
    round(1 - {S.edit_distance('s.claim', 'g.text')} / greatest(len(s.claim), len(g.text)), 9) AS sim
  FROM scored s JOIN gold g USING (conv_id, turn)),
top AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY sim DESC, gpos) = 1),
aligned AS (
  SELECT conv_id, turn, pos, label, CASE WHEN sim > 0.6 THEN gold_label END AS gold_label,
         CASE WHEN sim > 0.6 THEN sim END AS gold_similarity FROM top)
"""


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Claims against a gold list: the same claims negated, labelled by the parity of their length."""
    base = samples(spark, sf)
    gold = base.select(*KEYS, F.transform(text.claims(F.col("answer")), lambda c: text.record(
        text=generate.negate(c),
        label=F.when(F.length(c) % 2 == 0, F.lit("supported")).otherwise(F.lit("unsupported")))
    ).alias("gold"))
    scored = ground.evidence(ground.claim_rows(base, KEYS))
    return ground.align_gold(scored.join(gold, KEYS))


@query("gold_alignment", GOLD_SQL + "SELECT * FROM aligned")
def gold_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return aligned(spark, sf).select(*KEYS, "pos", "label", "gold_label", "gold_similarity")


@query("gold_scores", GOLD_SQL + """,
counts AS (
  SELECT conv_id, turn,
    count(*) FILTER (WHERE label = 'supported' AND gold_label = 'supported') AS tp,
    count(*) FILTER (WHERE label = 'supported' AND coalesce(gold_label, '') <> 'supported') AS fp,
    count(*) FILTER (WHERE label <> 'supported' AND gold_label = 'supported') AS fn
  FROM aligned GROUP BY 1, 2)
SELECT conv_id, turn, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
  CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) ELSE 0.0 END::DOUBLE AS "precision",
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) ELSE 0.0 END::DOUBLE AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 9) ELSE 0.0 END::DOUBLE AS f1
FROM counts""")
def gold_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = ground.gold_scores(aligned(spark, sf), KEYS)
    return scores.select(*KEYS, "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def with_cost(scored: DataFrame) -> DataFrame:
    chars = F.length("claim")
    tokens_in = costs.text_tokens(chars, F.lit("pt-BR"))
    tokens_out = costs.text_tokens(F.lit(OUTPUT_CHARS), F.lit("pt-BR"))
    return scored.withColumn("cost", costs.inference_cost(tokens_in, tokens_out, F.lit(HEAVY_MODEL)))


@query("hybrid_routing", EVIDENCE_SQL + f"""
routed AS (
  SELECT *, CASE WHEN own_label = 'contradicted' THEN 'fast_contradiction'
                 WHEN own_label = 'supported' AND own_conf >= 0.95 THEN 'fast_exact_match' ELSE 'heavy' END AS route,
    greatest(1, floor(len(claim) / 3.0)) / 1000000.0 * 0.15 + floor({OUTPUT_CHARS} / 3.0) / 1000000.0 * 0.60 AS cost
  FROM scored)
SELECT route, CAST(count(*) AS BIGINT) AS claims,
  round(sum(CASE WHEN route = 'heavy' THEN 0 ELSE cost END), 9) AS usd_saved,
  round(sum(CASE WHEN route = 'heavy' THEN cost ELSE 0 END), 9) AS usd_spent,
  CAST(count(*) FILTER (WHERE route = 'heavy' AND len(claim) > 60 OR route <> 'heavy' AND own_label = 'supported') AS BIGINT) AS supported
FROM routed GROUP BY route""")
def hybrid_routing(spark: SparkSession, sf: str) -> DataFrame:
    def heavy(rest: DataFrame) -> DataFrame:
        # stands for a model: long claims count as supported
        return rest.withColumn("label", F.when(F.length("claim") > 60, F.lit("supported"))
                               .otherwise(F.lit("unsupported")))

    routed = ground.route(with_cost(evidence_rows(spark, sf)), heavy)
    return routed.groupBy("route").agg(
        F.count("*").alias("claims"), F.round(F.sum("usd_saved"), 9).alias("usd_saved"),
        F.round(F.sum("usd_spent"), 9).alias("usd_spent"),
        F.count_if(F.col("label") == "supported").alias("supported"))
