"""Review queries: label quality is annotator one, a rule on the document is annotator two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions import fixed, modeljson, text, truth
from trustframe.functions.session import read_table
from trustframe.operators import generate, ground, review
from trustframe.plans import sqltext as S
from trustframe.plans.ground_queries import GOLD_SQL, OUTPUT_CHARS, RISK_SQL, aligned, samples, with_cost
from trustframe.plans.rag_queries import rounded
from trustframe.plans.registry import query


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with two annotators, an adjudicator, a seed label and a probability."""
    labels, docs = read_table(spark, sf, "labels"), read_table(spark, sf, "documents")
    joined = labels.join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    one = (F.when(F.col("toxic") == 1, F.lit("contradicted")).when(F.col("quality") == 1, F.lit("supported"))
           .otherwise(F.lit("unsupported")))
    two = (F.when(F.col("n_chars") < 150, F.lit("contradicted")).when(F.col("n_chars") > 700, F.lit("supported"))
           .otherwise(F.lit("unsupported")))
    return joined.select(
        "doc_id", "lang", "n_chars", "quality", "toxic", one.alias("annotator_1"), two.alias("annotator_2"),
        F.when(F.col("lang") == "en", two).otherwise(one).alias("adjudicated"),
        F.when(F.col("quality") == 1, F.lit("supported")).otherwise(F.lit("unsupported")).alias("seed_label"),
        F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"))


ANNOTATED = """
WITH a0 AS (
  SELECT l.doc_id, d.lang, d.n_chars, quality, toxic,
    CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS annotator_1,
    CASE WHEN n_chars < 150 THEN 'contradicted' WHEN n_chars > 700 THEN 'supported' ELSE 'unsupported' END AS annotator_2,
    CASE WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS seed_label,
    least(1.0::DOUBLE, n_chars / 4000.0::DOUBLE) AS p
  FROM labels l JOIN documents d USING (doc_id)),
annotated AS (SELECT *, CASE WHEN lang = 'en' THEN annotator_2 ELSE annotator_1 END AS adjudicated FROM a0)
"""


@query("annotator_agreement", ANNOTATED + """,
cells AS (SELECT annotator_1 AS a, annotator_2 AS b, count(*) AS n FROM annotated GROUP BY 1, 2),
m AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS agreed FROM cells),
e AS (SELECT sum(x.na * y.nb) AS product FROM (SELECT a, sum(n) AS na FROM cells GROUP BY 1) x
      JOIN (SELECT b, sum(n) AS nb FROM cells GROUP BY 1) y ON x.a = y.b)
SELECT CAST(n AS BIGINT) AS n, CAST(agreed AS BIGINT) AS agreed, round(agreed / n, 9) AS percent_agreement,
  round((agreed / n - product / (n * n)) / (1 - product / (n * n)), 9) AS kappa FROM m, e""")
def annotator_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(review.agreement(annotated(spark, sf), "annotator_1", "annotator_2"))


FINAL = ANNOTATED + """,
final AS (SELECT *, CASE WHEN annotator_1 = annotator_2 THEN annotator_1 ELSE adjudicated END AS final_label,
  CASE WHEN annotator_1 = annotator_2 THEN 'agreement' ELSE 'adjudication' END AS final_source FROM annotated)
"""


@query("adjudicated_labels", FINAL + """
SELECT doc_id, final_label, final_source, final_label <> seed_label AS changed_from_seed FROM final""")
def adjudicated_labels(spark: SparkSession, sf: str) -> DataFrame:
    return review.adjudicate(annotated(spark, sf)).select("doc_id", "final_label", "final_source", "changed_from_seed")


@query("adjudication_merge", FINAL + """
SELECT final_label, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE final_source = 'adjudication') AS BIGINT) AS adjudicated,
  CAST(count(*) FILTER (WHERE final_label <> seed_label) AS BIGINT) AS changed FROM final GROUP BY 1""")
def adjudication_merge(spark: SparkSession, sf: str) -> DataFrame:
    return review.adjudication_summary(review.adjudicate(annotated(spark, sf)))


@query("mcnemar_counts", FINAL + """,
d AS (SELECT annotator_1 = final_label AS a, annotator_2 = final_label AS b FROM final),
c AS (SELECT count(*) FILTER (WHERE a AND b) AS both_right, count(*) FILTER (WHERE a AND NOT b) AS only_a,
  count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS both_wrong FROM d)
SELECT CAST(both_right AS BIGINT) AS both_right, CAST(only_a AS BIGINT) AS only_a, CAST(only_b AS BIGINT) AS only_b,
  CAST(both_wrong AS BIGINT) AS both_wrong,
  round(least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - (CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END)
     - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2))) FROM (SELECT unnest(range(0, least(only_a, only_b) + 1)) AS k))), 9) AS p_value
FROM c""")
def mcnemar_counts(spark: SparkSession, sf: str) -> DataFrame:
    frame = review.adjudicate(annotated(spark, sf)).select(
        (F.col("annotator_1") == F.col("final_label")).alias("a"), (F.col("annotator_2") == F.col("final_label")).alias("b"))
    return review.mcnemar(frame, "a", "b").withColumn("p_value", F.round("p_value", 9))


BINS = ANNOTATED + """,
bins AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_probability,
  avg(toxic) AS outcome_rate FROM annotated GROUP BY 1)
"""


@query("reliability_bins", BINS + """
SELECT bin, CAST(n AS BIGINT) AS n, round(mean_probability, 9) AS mean_probability,
  round(outcome_rate, 9) AS outcome_rate FROM bins""")
def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(review.reliability_bins(annotated(spark, sf), "p", "toxic"))


@query("calibration_ece", BINS + """
SELECT round(sum(n * abs(outcome_rate - mean_probability)) / sum(n), 9) AS ece, CAST(sum(n) AS BIGINT) AS n FROM bins""")
def calibration_ece(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(review.expected_calibration_error(annotated(spark, sf), "p", "toxic"))


SCORES = FINAL + """,
scores AS (SELECT *, round(1 - CASE WHEN annotator_2 = final_label THEN p ELSE greatest(0.01, 1 - p) / 2 END, 9) AS score FROM final),
quantile AS (SELECT score AS q_hat, n, position FROM (
  SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n,
    least(greatest(1, CAST(ceil((count(*) OVER () + 1) * 0.9) AS BIGINT)), count(*) OVER ()) AS position FROM scores) WHERE rn = position)
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    frame = review.adjudicate(annotated(spark, sf))
    return frame.withColumn("score", F.round(review.nonconformity(
        F.col("annotator_2"), F.col("p"), F.col("final_label")), 9))


@query("conformal_quantile", SCORES + "SELECT CAST(n AS BIGINT) AS n, CAST(position AS BIGINT) AS position, q_hat FROM quantile")
def conformal_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return review.conformal_quantile(scored(spark, sf), "score")


@query("conformal_coverage", SCORES + """,
probs AS (SELECT s.doc_id, s.final_label, s.annotator_2, c.cls,
    CASE WHEN c.cls = s.annotator_2 THEN s.p ELSE greatest(0, 1 - s.p) / 2 END AS prob, q.q_hat
  FROM scores s, quantile q, (VALUES ('supported'), ('unsupported'), ('contradicted')) c(cls)),
sets AS (SELECT doc_id, final_label, count(*) FILTER (WHERE 1 - prob <= q_hat) AS k,
    coalesce(bool_or(cls = final_label) FILTER (WHERE 1 - prob <= q_hat), false) AS hit,
    any_value(annotator_2 = final_label) AS own FROM probs GROUP BY 1, 2),
done AS (SELECT final_label, CASE WHEN k = 0 THEN own ELSE hit END AS hit, greatest(k, 1) AS size FROM sets)
SELECT coalesce(final_label, 'all') AS gold, CAST(count(*) AS BIGINT) AS n, round(avg(hit::INT), 9) AS coverage,
  round(avg(size), 9) AS mean_set_size FROM done GROUP BY ROLLUP (final_label)""")
def conformal_coverage(spark: SparkSession, sf: str) -> DataFrame:
    frame = scored(spark, sf)
    quantile = review.conformal_quantile(frame, "score").select("q_hat", F.lit(1).alias("one"))
    sets = frame.withColumn("one", F.lit(1)).join(quantile, "one").select(
        F.col("final_label").alias("gold"),
        ground.prediction_set(F.col("annotator_2"), F.col("p"), F.col("q_hat")).alias("set"))
    return rounded(review.conformal_coverage(sets))


@query("decision_outcomes", ANNOTATED + """,
d AS (SELECT CASE annotator_1 WHEN 'supported' THEN 'TRUE' WHEN 'contradicted' THEN 'FALSE' ELSE 'UNDECIDABLE' END AS e,
  CASE annotator_2 WHEN 'supported' THEN 'TRUE' WHEN 'contradicted' THEN 'FALSE' ELSE 'UNDECIDABLE' END AS o, lang FROM annotated)
SELECT lang, CAST(count(*) AS BIGINT) AS sample_count, round(avg((e = o)::INT), 9) AS accuracy,
  round(avg((e <> 'TRUE' AND o = 'TRUE')::INT), 9) AS false_allow_rate,
  round(avg((e = 'TRUE' AND o = 'FALSE')::INT), 9) AS false_block_rate,
  round(coalesce(avg(CASE WHEN e = 'UNDECIDABLE' THEN (o = 'UNDECIDABLE')::INT END), 0), 9) AS useful_abstention_rate,
  round(coalesce(avg(CASE WHEN e <> 'UNDECIDABLE' THEN (o = 'UNDECIDABLE')::INT END), 0), 9) AS harmful_abstention_rate
FROM d GROUP BY 1""")
def decision_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    frame = annotated(spark, sf).select(
        "lang", review.expected_from_label(F.col("annotator_1")).alias("expected"),
        truth.label_decision(F.col("annotator_2")).alias("observed"))
    return rounded(review.decision_metrics(frame, ["lang"]))


@query("decision_confusion", ANNOTATED + """
SELECT annotator_1, annotator_2, CAST(count(*) AS BIGINT) AS n FROM annotated GROUP BY 1, 2""")
def decision_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return review.confusion(annotated(spark, sf), "annotator_1", "annotator_2")


@query("label_map", ANNOTATED + """,
m AS (SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'error' WHEN annotator_1 = 'unsupported' AND n_chars > 2000
    THEN 'partially_unsupported' ELSE annotator_1 END AS label,
  CASE WHEN n_chars > 2000 THEN 'verified' WHEN n_chars > 1000 THEN 'probable' WHEN n_chars > 300 THEN 'possible' ELSE 'other' END AS word FROM annotated)
SELECT doc_id, CASE label WHEN 'supported' THEN 'TRUE' WHEN 'contradicted' THEN 'FALSE' ELSE 'UNDECIDABLE' END AS decision,
  CASE label WHEN 'supported' THEN 'allow' WHEN 'contradicted' THEN 'block' WHEN 'unsupported' THEN 'abstain'
    WHEN 'partially_unsupported' THEN 'warn' ELSE 'escalate' END AS action, label AS status,
  CASE word WHEN 'verified' THEN 1.0 WHEN 'probable' THEN 0.8 WHEN 'possible' THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM m""")
def label_map(spark: SparkSession, sf: str) -> DataFrame:
    frame = annotated(spark, sf)
    label = (F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit("error"))
             .when((F.col("annotator_1") == "unsupported") & (F.col("n_chars") > 2000), F.lit("partially_unsupported"))
             .otherwise(F.col("annotator_1")))
    word = (F.when(F.col("n_chars") > 2000, F.lit("verified")).when(F.col("n_chars") > 1000, F.lit("probable"))
            .when(F.col("n_chars") > 300, F.lit("possible")).otherwise(F.lit("other")))
    return frame.withColumn("label", label).select(
        "doc_id", truth.label_decision(F.col("label")).alias("decision"),
        truth.label_action(F.col("label")).alias("action"), truth.label_status(F.col("label")).alias("status"),
        truth.confidence_score(word).alias("confidence"))


@query("gold_filter", """
SELECT d.doc_id, lower(trim(d.lang)) AS lang, l.quality FROM documents d JOIN labels l USING (doc_id)
WHERE lower(trim(d.lang)) = 'en'""")
def gold_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    lang = F.lower(F.trim("lang"))
    return (docs.filter(lang == "en").select("doc_id", lang.alias("lang"))
            .join(labels.select("doc_id", "quality"), "doc_id"))


@query("pilot_metrics", """
WITH e AS (SELECT event_type AS workflow, CASE WHEN value < 10 THEN 'TRUE' WHEN value < 30 THEN 'FALSE' ELSE 'UNDECIDABLE' END AS e,
  CASE WHEN user_id < 60 THEN 'TRUE' WHEN user_id < 100 THEN 'FALSE' ELSE 'UNDECIDABLE' END AS o,
  CAST(props->>'$.k' AS INTEGER) AS k, value FROM events)
SELECT workflow, CAST(count(*) AS BIGINT) AS sample_count, round(avg((e <> 'TRUE' AND o = 'TRUE')::INT), 9) AS false_allow_rate,
  round(avg((e = 'TRUE' AND o = 'FALSE')::INT), 9) AS false_block_rate,
  round(avg(CASE WHEN e = 'UNDECIDABLE' THEN (o = 'UNDECIDABLE')::INT END), 9) AS useful_abstention_rate,
  round(avg((k > 20)::INT), 9) AS proof_lookup_success_rate, round(avg(value), 9) AS audit_minutes_before_avg,
  round(avg(k / 10.0), 9) AS audit_minutes_after_avg, round((avg(value) - avg(k / 10.0)) / avg(value), 9) AS audit_time_delta_pct,
  round(sum(k) / 60.0, 9) AS setup_hours, round(avg(CASE WHEN k > 50 THEN 1 + k / 25.0 END), 9) AS usefulness_avg
FROM e GROUP BY 1""")
def pilot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    v, u = F.col("value"), F.col("user_id")
    reviews = read_table(spark, sf, "events").select(
        F.col("event_type").alias("workflow"),
        F.when(v < 10, F.lit("TRUE")).when(v < 30, F.lit("FALSE")).otherwise(F.lit("UNDECIDABLE")).alias("expected_decision"),
        F.when(u < 60, F.lit("TRUE")).when(u < 100, F.lit("FALSE")).otherwise(F.lit("UNDECIDABLE")).alias("observed_decision"),
        (k > 20).alias("proof_lookup_ok"), v.alias("audit_minutes_before"), (k / 10.0).alias("audit_minutes_after"),
        k.alias("setup_minutes"), F.when(k > 50, 1 + k / 25.0).alias("usefulness_score"))
    return rounded(review.pilot_metrics(reviews))


@query("sample_profile", """
SELECT lang, CAST(count(*) AS BIGINT) AS samples, round(avg(len(text)), 6) AS mean_answer_chars,
  CAST(min(len(text)) AS INTEGER) AS min_answer_chars, CAST(max(len(text)) AS INTEGER) AS max_answer_chars
FROM documents GROUP BY 1""")
def sample_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return docs.groupBy("lang").agg(
        F.count("*").alias("samples"), F.round(F.avg(F.length("text")), 6).alias("mean_answer_chars"),
        F.min(F.length("text")).alias("min_answer_chars"), F.max(F.length("text")).alias("max_answer_chars"))


@query("dataset_profile", ANNOTATED + """
SELECT coalesce(lang, 'all') AS lang, coalesce(annotator_1, 'all') AS label, CAST(count(*) AS BIGINT) AS samples,
  CAST(min(n_chars) AS BIGINT) AS min_chars, round(avg(n_chars), 6) AS mean_chars, CAST(max(n_chars) AS BIGINT) AS max_chars
FROM annotated GROUP BY GROUPING SETS ((lang), (annotator_1), (lang, annotator_1), ())""")
def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    frame = annotated(spark, sf)
    sets = frame.groupingSets([["lang"], ["annotator_1"], ["lang", "annotator_1"], []], "lang", "annotator_1").agg(
        F.count("*").alias("samples"), F.min("n_chars").alias("min_chars"),
        F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.max("n_chars").alias("max_chars"))
    return sets.select(F.coalesce("lang", F.lit("all")).alias("lang"),
                       F.coalesce("annotator_1", F.lit("all")).alias("label"),
                       "samples", "min_chars", "mean_chars", "max_chars")


DECLARED = [("en", 620), ("fr", 145), ("de", 100), ("it", 12)]


@query("manifest_reconcile", "WITH declared(value, declared) AS (VALUES " + ", ".join(
    f"('{v}', {n})" for v, n in DECLARED) + """), actual AS (SELECT lang AS value, count(*) AS actual FROM documents GROUP BY 1)
SELECT value, CAST(coalesce(actual, 0) AS BIGINT) AS actual, CAST(coalesce(declared, 0) AS BIGINT) AS declared,
  coalesce(actual, 0) = coalesce(declared, 0) AS matches FROM actual FULL JOIN declared USING (value)""")
def manifest_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    declared = spark.createDataFrame(DECLARED, "value string, declared bigint")
    return review.reconcile(read_table(spark, sf, "documents"), "lang", declared)


COST_SQL = GOLD_SQL + f""",
claim_costs AS (
  SELECT a.conv_id, a.turn, a.pos, a.label AS lex_label, s.own_conf AS lex_conf, coalesce(a.gold_label, 'unsupported') AS gold_label,
    greatest(1, floor(len(s.claim) / 3.0)) / 1000000.0 * 0.15 + floor({OUTPUT_CHARS} / 3.0) / 1000000.0 * 0.60 AS cost,
    CAST('0x' || substr(md5(concat_ws(':', a.conv_id::VARCHAR, a.turn::VARCHAR, a.pos::VARCHAR)), 1, 8) AS BIGINT) % 100 AS h
  FROM aligned a JOIN scored s USING (conv_id, turn, pos)),
decided AS (SELECT *, CASE WHEN h < 85 THEN gold_label WHEN gold_label = 'supported' THEN 'unsupported' ELSE 'supported' END AS heavy_label FROM claim_costs),
cells AS (SELECT g.i AS step, g.i / 100.0::DOUBLE AS threshold, gold_label, cost,
    lex_label = 'contradicted' OR (lex_label = 'supported' AND round(lex_conf, 8) >= g.i / 100.0::DOUBLE) AS cheap, lex_label, heavy_label
  FROM decided, range(0, 101) g(i)),
preds AS (SELECT step, threshold, gold_label, CASE WHEN cheap THEN lex_label ELSE heavy_label END AS pred, CASE WHEN cheap THEN 0 ELSE cost END AS cost FROM cells),
f1 AS (SELECT step, avg(f) AS f1_score FROM (
    SELECT p.step, l.label, 2.0::DOUBLE * count(*) FILTER (WHERE pred = label AND gold_label = label)
        / nullif(count(*) FILTER (WHERE pred = label) + count(*) FILTER (WHERE gold_label = label), 0) AS f
    FROM preds p, (VALUES ('supported'), ('unsupported'), ('contradicted')) l(label) GROUP BY 1, 2) WHERE f IS NOT NULL GROUP BY 1),
spent AS (SELECT step, threshold, sum(cost) AS cost_usd FROM preds GROUP BY 1, 2),
curve AS (SELECT threshold, round(cost_usd, 9) AS cost_usd, round(f1_score, 9) AS f1_score, round(cost_usd, 9) <= 0.045 AS feasible
  FROM f1 JOIN spent USING (step))
"""


def cost_curve(spark: SparkSession, sf: str) -> DataFrame:
    runs = with_cost(aligned(spark, sf))
    gold = F.coalesce("gold_label", F.lit("unsupported"))
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ("conv_id", "turn", "pos")])
    wrong = F.when(gold == "supported", F.lit("unsupported")).otherwise(F.lit("supported"))
    runs = runs.select(
        F.col("label").alias("lex_label"), F.col("confidence").alias("lex_conf"), gold.alias("gold_label"), "cost",
        F.when(generate.keyed_number(key, 100) < 85, gold).otherwise(wrong).alias("heavy_label"))
    return review.cost_sweep(runs, 0.045)


@query("hybrid_cost_sweep", COST_SQL + "SELECT * FROM curve")
def hybrid_cost_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return cost_curve(spark, sf)


@query("hybrid_cost_best", COST_SQL + """
SELECT threshold, cost_usd, f1_score, feasible FROM curve
ORDER BY feasible DESC, CASE WHEN feasible THEN -f1_score ELSE 0 END, cost_usd, threshold LIMIT 1""")
def hybrid_cost_best(spark: SparkSession, sf: str) -> DataFrame:
    return review.best_run(cost_curve(spark, sf))


RATES = [("BRL", 5.0), ("EUR", 0.9), ("USD", 1.0)]


@query("cost_roi", """
WITH c AS (SELECT doc_id, lang, greatest(1, floor(len(text) / 4.0)) / 1000000.0 * 5.0 + 20 / 1000000.0 * 15.0 AS cost,
  CASE WHEN lang IN ('fr', 'de', 'es') THEN 'EUR' ELSE 'BRL' END AS currency, len(text) < 1000 AS cheap FROM documents),
r(currency, per_usd) AS (VALUES """ + ", ".join(f"('{c}', {r}::DOUBLE)" for c, r in RATES) + """)
SELECT lang, round(sum(CASE WHEN cheap THEN cost ELSE 0 END), 9) AS usd_saved, round(sum(CASE WHEN cheap THEN 0 ELSE cost END), 9) AS usd_spent,
  round(100.0 * sum(CASE WHEN cheap THEN cost ELSE 0 END) / sum(cost), 6) AS roi_percent,
  round(any_value(per_usd) * sum(CASE WHEN cheap THEN 0 ELSE cost END), 9) AS converted
FROM c JOIN r USING (currency) GROUP BY 1""")
def cost_roi(spark: SparkSession, sf: str) -> DataFrame:
    from trustframe.functions import costs
    docs = read_table(spark, sf, "documents")
    length = F.length("text")
    cost = costs.inference_cost(costs.text_tokens(length, F.col("lang")), F.lit(20), F.lit("openai/GPT-4o"))
    frame = docs.select(
        "lang", F.when(length < 1000, cost).otherwise(F.lit(0.0)).alias("usd_saved"),
        F.when(length < 1000, F.lit(0.0)).otherwise(cost).alias("usd_spent"))
    totals = review.roi(frame, ["lang"]).withColumn(
        "currency", F.when(F.col("lang").isin("fr", "de", "es"), F.lit("EUR")).otherwise(F.lit("BRL")))
    rates = spark.createDataFrame(RATES, "currency string, per_usd double")
    out = costs.convert(totals, rates, "usd_spent", "currency")
    return out.select("lang", F.round("usd_saved", 9).alias("usd_saved"), F.round("usd_spent", 9).alias("usd_spent"),
                      F.round("roi_percent", 6).alias("roi_percent"), F.round("converted", 9).alias("converted"))


@query("quality_gate", RISK_SQL + """
SELECT round(avg(raw), 9) AS support_rate_raw, round(avg(risk), 9) AS risk, avg(raw) >= 0.5 AND avg(risk) <= 0.4 AS passed FROM risks""")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    report = ground.evaluate(samples(spark, sf), ["conv_id", "turn"])
    return rounded(review.quality_gate(report, {"support_rate_raw": 0.5}, {"risk": 0.4}))


@query("decomposer_profile", f"""
WITH d AS (SELECT 'claims' AS decomposer, len({S.claims('text')}) AS n FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT 'points', len({S.points('text', 10)}) FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT 'stops', len({S.stops('text')}) FROM conversations WHERE role = 'assistant')
SELECT decomposer, CAST(count(*) AS BIGINT) AS answers, round(avg(n), 9) AS mean_claims FROM d GROUP BY 1""")
def decomposer_profile(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations").filter("role = 'assistant'")
    ways = {"claims": text.claims(F.col("text")), "points": text.sentences_at_points(F.col("text"), 10),
            "stops": text.sentences_at_stops(F.col("text"))}
    rows = turns.select(F.explode(F.array(*[
        text.record(decomposer=F.lit(k), n=F.size(v)) for k, v in ways.items()])).alias("d")).select("d.*")
    return rows.groupBy("decomposer").agg(F.count("*").alias("answers"), F.round(F.avg("n"), 9).alias("mean_claims"))


OUTPUT_SQL = """
WITH raw AS (
  SELECT conv_id, turn, text, role, len(text) % 5 AS form, CASE WHEN len(text) % 3 = 0 THEN 'TRUE' WHEN len(text) % 3 = 1 THEN 'FALSE' ELSE 'UNDECIDABLE' END AS d,
    regexp_extract(text, '[\\p{L}]+') AS word FROM conversations),
outputs AS (SELECT *, CASE form WHEN 0 THEN '{"answer":"' || word || '","decision":"' || d || '"}'
    WHEN 1 THEN 'Result: ```json' || chr(10) || '{"answer":"' || word || '","decision":"' || lower(d) || '"}' || chr(10) || '```'
    WHEN 2 THEN 'prefix {"answer":"' || word || '","decision":"' || d || '"} suffix' WHEN 3 THEN word || ' ' || d
    ELSE '{"answer":"","decision":"' || d || '"}' END AS output FROM raw),
parsed AS (SELECT *, CASE WHEN form IN (0, 1, 2) AND word <> '' THEN 'valid' ELSE 'malformed' END AS parse_status,
    CASE WHEN form IN (0, 1, 2) AND word <> '' THEN word ELSE '' END AS answer,
    CASE WHEN form IN (0, 1, 2) AND word <> '' THEN d ELSE 'UNDECIDABLE' END AS decision FROM outputs)
"""


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Model texts made from the turns in five shapes, then parsed."""
    n = F.length("text")
    d = F.when(n % 3 == 0, F.lit("TRUE")).when(n % 3 == 1, F.lit("FALSE")).otherwise(F.lit("UNDECIDABLE"))
    word = F.regexp_extract("text", r"[\p{L}]+", 0)

    def body(decision, answer):
        return F.concat(F.lit('{"answer":"'), answer, F.lit('","decision":"'), decision, F.lit('"}'))

    output = (F.when(n % 5 == 0, body(d, word))
              .when(n % 5 == 1, F.concat(F.lit("Result: ```json\n"), body(F.lower(d), word), F.lit("\n```")))
              .when(n % 5 == 2, F.concat(F.lit("prefix "), body(d, word), F.lit(" suffix")))
              .when(n % 5 == 3, F.concat(word, F.lit(" "), d)).otherwise(body(d, F.lit(""))))
    turns = read_table(spark, sf, "conversations").withColumn("output", output)
    return turns.withColumn("p", text.parse_decision(F.col("output"))).select(
        "conv_id", "turn", "role", "text", "p.*")


@query("model_output_parse", OUTPUT_SQL + "SELECT conv_id, turn, answer, decision, parse_status FROM parsed")
def model_output_parse(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("conv_id", "turn", "answer", "decision", "parse_status")


HYPOTHESES_SQL = """
WITH raw AS (SELECT conv_id, turn, len(text) % 9 AS form, len(text) AS n, regexp_extract(text, '[\\p{L}]+') AS word FROM conversations),
outcome AS (SELECT *, CASE WHEN form = 3 THEN 'multiple_blocks' WHEN form IN (4, 5, 8) THEN 'invalid_schema' WHEN form = 6 THEN 'no_sentinels' END AS error_type,
  CASE form WHEN 3 THEN '2 blocks' WHEN 4 THEN 'missing meta' WHEN 5 THEN 'facts 1 lacks object' WHEN 6 THEN 'no JSON found' WHEN 8 THEN 'rules is no list' END AS error_message FROM raw)
SELECT conv_id, turn, error_type, error_message, CASE WHEN error_type IS NULL THEN 1 END AS n_facts, CASE WHEN error_type IS NULL THEN word END AS subject,
  CASE WHEN error_type IS NULL THEN CASE WHEN form = 7 THEN repeat('[', 50) || n || repeat(']', 50) ELSE '{"a":"}","n":' || n || '}' END END AS object,
  CASE WHEN error_type IS NULL THEN '{"turn":' || turn || '}' END AS meta FROM outcome"""


@query("hypothesis_parse", HYPOTHESES_SQL)
def hypothesis_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Hypotheses in marked, fenced, bare, repeated and faulty blocks made from the turns."""
    n = F.length("text")
    form, word = n % 9, F.regexp_extract("text", r"[\p{L}]+", 0)
    value = F.when(form == 7, F.concat(F.repeat(F.lit("["), 50), n, F.repeat(F.lit("]"), 50))).otherwise(
        F.concat(F.lit('{"n": '), n, F.lit(', "a": "}"}')))
    fact = F.concat(F.lit('{"relation": "r", "subject": "'), word, F.lit('", "object": '), value, F.lit("}"))
    facts = F.when(form == 5, F.concat(fact, F.lit(', {"subject": "s", "relation": "r"}'))).otherwise(fact)
    rules = F.when(form == 8, F.lit("{}")).otherwise(F.lit('[{"head": "h", "body": ["b", {"c": 1}]}]'))
    meta = F.when(form == 4, F.lit("")).otherwise(F.concat(F.lit(', "meta": {"turn": '), F.col("turn"), F.lit("}")))
    body = F.concat(F.lit('{"facts": ['), facts, F.lit('], "rules": '), rules, meta, F.lit("}"))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    output = (F.when(form == 0, F.concat(F.lit("so {x} begin_hypotheses_json\n"), body, F.lit("\nEND_HYPOTHESES_JSON {}")))
              .when(form.isin(1, 4), fenced).when(form == 3, F.concat(fenced, F.lit(" and "), fenced))
              .when(form == 6, word).otherwise(F.concat(F.lit("we say {that} "), body, F.lit(' and {"more": 1}'))))
    parsed_rows = read_table(spark, sf, "conversations").withColumn("p", modeljson.parse_hypotheses(output))
    fact0 = F.get("p.facts", F.lit(0))
    return parsed_rows.select("conv_id", "turn", "p.error_type", "p.error_message", F.when(
        F.col("p.facts").isNotNull(), F.size("p.facts")).alias("n_facts"), fact0["subject"].alias("subject"),
        fact0["object"].alias("object"), "p.meta")


@query("model_run_report", OUTPUT_SQL + f""",
guarded AS (SELECT *, 'what about the premium plan and retention' AS q, lower(text) || CASE WHEN len(text) % 2 = 0 THEN ' must not premium retention' ELSE ' premium' END AS ev FROM parsed),
g AS (SELECT *, CASE WHEN parse_status <> 'valid' THEN 'UNDECIDABLE' WHEN decision <> 'TRUE' THEN decision
   WHEN contains(ev, 'must not') OR contains(ev, 'not allowed') OR contains(ev, 'forbidden') OR contains(ev, 'prohibited') OR contains(ev, 'cannot') THEN 'FALSE'
   WHEN NOT contains(ev, 'retention') THEN 'UNDECIDABLE' ELSE decision END AS gd FROM guarded)
SELECT CAST(count(*) AS BIGINT) AS cases, round(avg((decision = 'FALSE')::INT), 9) AS raw_accuracy, round(avg((gd = 'FALSE')::INT), 9) AS guarded_accuracy,
  CAST(count(*) FILTER (WHERE gd <> decision) AS BIGINT) AS guardrail_applied, CAST(count(*) FILTER (WHERE parse_status = 'valid') AS BIGINT) AS valid_parses,
  (SELECT string_agg(DISTINCT role, ',' ORDER BY role) FROM g WHERE role <> 'system') AS providers_used, 'partial' AS status FROM g""")
def model_run_report(spark: SparkSession, sf: str) -> DataFrame:
    evidence = F.concat(F.lower("text"), F.when(F.length("text") % 2 == 0, F.lit(" must not premium retention"))
                        .otherwise(F.lit(" premium")))
    outputs = parsed(spark, sf).select(
        F.col("decision").alias("raw_decision"), "parse_status", F.lit("FALSE").alias("expected_decision"),
        text.guarded_decision(F.col("decision"), F.col("parse_status"),
                              F.lit("what about the premium plan and retention"), evidence).alias("guarded_decision"),
        (F.col("role") != "system").alias("succeeded"), F.col("role").alias("provider"))
    return rounded(review.run_report(outputs))


@query("model_fact_parse", """
WITH w AS (SELECT conv_id, turn, regexp_extract(text, '[\\p{L}]+') AS a, len(text) AS n FROM conversations)
SELECT conv_id, turn, a AS content, CASE WHEN n % 3 = 0 THEN 'rule' WHEN n % 3 = 1 THEN 'numeric' ELSE 'definition' END AS fact_type,
  CASE WHEN n % 2 = 0 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM w WHERE n % 5 <> 0""")
def model_fact_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Fact lists in model texts, some of them not JSON, parsed back into facts."""
    n, word = F.length("text"), F.regexp_extract("text", r"[\p{L}]+", 0)
    kind = F.when(n % 3 == 0, F.lit("RULE")).when(n % 3 == 1, F.lit("Numeric")).otherwise(F.lit("OTHER"))
    item = F.concat(F.lit('Facts: [{"content":"'), word, F.lit('","type":"'), kind, F.lit('"'),
                    F.when(n % 2 == 0, F.lit(',"confidence":0.9')).otherwise(F.lit("")), F.lit("}] end"))
    output = F.when(n % 5 == 0, F.concat(F.lit("no list, "), word)).otherwise(item)
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", F.explode(text.parse_fact_list(output)).alias("f"))
    return rows.select("conv_id", "turn", "f.content", "f.fact_type", "f.confidence")


JUDGE_RULES = [("FALSE", ["token", "="], []), ("TRUE", ["that", "with"], ["token", "@"])]


@query("rule_judged_answers", """
WITH j AS (SELECT lang, CASE WHEN contains(lower(text), 'token') AND contains(lower(text), '=') THEN 'FALSE'
  WHEN contains(lower(text), 'that') AND contains(lower(text), 'with') AND NOT contains(lower(text), 'token') AND NOT contains(lower(text), '@') THEN 'TRUE'
  ELSE 'UNDECIDABLE' END AS decision FROM documents)
SELECT lang, decision, CAST(count(*) AS BIGINT) AS answers FROM j GROUP BY 1, 2""")
def rule_judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("lang", review.judge_by_rules(F.col("text"), JUDGE_RULES).alias("decision"))
    return docs.groupBy("lang", "decision").agg(F.count("*").alias("answers"))


PERTURB_SQL = f"""
WITH src AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS sid, text AS answer FROM conversations WHERE role = 'assistant'),
swapped AS (SELECT sid, regexp_split_to_array(answer, '\\b\\d+\\b') AS gaps, regexp_extract_all(answer, '\\b\\d+\\b') AS nums, answer FROM src),
out AS (
  SELECT sid, answer, array_to_string([gaps[i] || CASE WHEN i > len(nums) THEN '' ELSE coalesce((try_cast(nums[i] AS BIGINT) + 10 +
      CAST('0x' || substr(md5(sid || ':' || nums[i]), 1, 8) AS BIGINT) % 91)::VARCHAR, nums[i]) END FOR i IN range(1, len(gaps) + 1)], '') AS number_swap,
    regexp_replace(answer, '^(\\S+) ', '\\1 não ') AS negation FROM swapped)
SELECT sid || '_perturb_' || s.strategy AS id, s.strategy, CASE s.strategy WHEN 'number_swap' THEN number_swap WHEN 'negation' THEN negation
  WHEN 'pt_telemarketing' THEN {S.q(fixed.TELEMARKETING_PREFIX)} || lower(substr(answer, 1, 1)) || substr(answer, 2)
  WHEN 'language_induced_hallucination' THEN answer ELSE {S.q(fixed.CONFLICT_ANSWER)} END AS answer
FROM out, (VALUES ('number_swap'), ('negation'), ('pt_telemarketing'), ('language_induced_hallucination'), ('conflicting_context')) s(strategy)"""


@query("perturb_samples", PERTURB_SQL)
def perturb_samples(spark: SparkSession, sf: str) -> DataFrame:
    out = generate.perturb(perturb_source(spark, sf), "sid", [s for s in fixed.PERTURBATIONS if s != "injection"])
    return out.select("id", "strategy", "answer")


def perturb_source(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations").filter("role = 'assistant'")
    sid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.select(sid.alias("sid"), F.col("text").alias("answer"), F.transform(
        text.claims(F.col("text")), lambda c: text.record(text=c, label=F.lit("supported"))).alias("gold"))


@query("perturb_injection")
def perturb_injection(spark: SparkSession, sf: str) -> DataFrame:
    out = generate.perturb(perturb_source(spark, sf), "sid", ["injection"])
    return out.select("id", "answer", "unsupported_start", "unsupported_end", F.size("gold").alias("gold_claims"))


@query("retrieval_cases", """
SELECT b.item_id::VARCHAR || '-' || k.t AS case_id, k.t AS case_type,
  'What does the policy say about ' || regexp_extract(b.text, '^[^.,]*') || CASE WHEN k.t = 'unanswerable' THEN ' in another region' ELSE '' END || '?' AS query,
  CASE k.t WHEN 'unanswerable' THEN '' WHEN 'partial' THEN b.item_id::VARCHAR || '-policy,' || b.item_id::VARCHAR || '-exception' ELSE b.item_id::VARCHAR || '-policy' END AS relevant,
  CASE k.t WHEN 'supported' THEN 'TRUE' WHEN 'contradicted' THEN 'FALSE' ELSE 'UNDECIDABLE' END AS expected_decision
FROM benchmark b, (VALUES ('supported'), ('contradicted'), ('partial'), ('unanswerable')) k(t)""")
def retrieval_cases(spark: SparkSession, sf: str) -> DataFrame:
    items = read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), F.regexp_extract("text", "^[^.,]*", 0).alias("topic"),
        F.col("text").alias("policy"), F.reverse("text").alias("exception"))
    return generate.retrieval_cases(items).select(
        "case_id", "case_type", "query", F.array_join("relevant_document_ids", ",").alias("relevant"), "expected_decision")
