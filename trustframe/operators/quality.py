"""Output quality of an answer to a question: issues, scores, validity and retry guidance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import fixed, text, truth

LEAST_RELEVANCE = 0.6
LEAST_OVERALL = 0.5


def contradicts_itself(answer: Column) -> Column:
    """Whether a negated and a plain sentence share three words. Stops at the first such pair."""
    facts = F.transform(text.sentences_at_points(F.lower(answer)), lambda s: text.record(
        negated=text.contains_any(s, fixed.CONSISTENCY_NEGATIONS),
        words=text.space_word_set(s, fixed.CONSISTENCY_NEGATIONS)))
    return text.let(facts, lambda f: F.exists(
        F.filter(f, lambda s: s["negated"]),
        lambda a: F.exists(F.filter(f, lambda s: ~s["negated"]),
                           lambda b: F.size(F.array_intersect(a["words"], b["words"])) >= 3)))


def relevance(query_words: Column, answer_words: Column, answer: Column, topics: list[str] | None) -> Column:
    covered = F.size(F.array_intersect(query_words, answer_words)) / F.size(query_words)
    on_topic = F.lit(1.0)
    if topics:
        on_topic = text.count_contained(F.lower(answer), [t.lower() for t in topics]) / len(topics)
    return F.when(F.size(query_words) == 0, F.lit(1.0)).otherwise(
        F.round(0.6 * covered + 0.4 * on_topic, 9))


def _issue(when: Column, kind: str, severity: Column, suggestion: Column) -> Column:
    return F.when(when, text.record(kind=F.lit(kind), severity=severity.cast("double"), suggestion=suggestion))


def assess(frame: DataFrame, query: str, answer: str, violations: str | None = None,
           hallucinations: str | None = None, topics: list[str] | None = None) -> DataFrame:
    """Add issues, five scores, overall, decision, validity and retry guidance.

    ``violations`` names a scanned violations column, ``hallucinations`` an array of unverified
    claims (strings), when those layers are wanted.
    """
    q, a = F.col(query), F.col(answer)
    frame = (frame.withColumn("_qw", text.space_word_set(q, fixed.RELEVANCE_STOPWORDS))
             .withColumn("_aw", text.space_word_set(a, fixed.RELEVANCE_STOPWORDS))
             .withColumn("_words", F.size(text.space_words(a)))
             .withColumn("_sentences", F.size(text.sentences_at_points(a)))
             .withColumn("_parts", F.regexp_count(F.lower(q), F.lit(fixed.QUESTION_PARTS)))
             .withColumn("_inconsistent", contradicts_itself(a)))
    frame = frame.withColumn("relevance", relevance(F.col("_qw"), F.col("_aw"), a, topics))
    rel, words = F.col("relevance"), F.col("_words")
    missing = F.array_join(F.slice(F.array_sort(F.array_except("_qw", "_aw")), 1, 5), ", ")
    hedged = text.count_contained(F.lower(a), fixed.HEDGING_WORDS) > 3
    advised = text.contains_any(F.lower(q), fixed.DISCLAIMER_TOPICS) & ~text.contains_any(
        F.lower(a), fixed.DISCLAIMER_TERMS)
    first = F.array(
        _issue(rel < LEAST_RELEVANCE, "low_relevance", F.round(1 - rel, 9), F.concat(F.lit("Incluir termos: "), missing)),
        _issue(rel < 0.3, "off_topic", F.lit(0.9), F.lit("Reformular resposta focando na pergunta original")))
    last = F.array(
        _issue(F.col("_inconsistent"), "inconsistent", F.lit(0.7), F.lit("Revisar afirmações contraditórias")),
        _issue(hedged, "excessive_hedging", F.lit(0.4), F.lit("Ser mais assertivo onde apropriado")),
        _issue(words < 10, "incomplete_response", F.lit(0.6), F.lit("Elaborar mais a resposta")),
        _issue((F.col("_parts") > 1) & (words < 50), "incomplete_response", F.lit(0.5),
               F.lit("Verificar se todas as partes da pergunta foram abordadas")),
        _issue(advised, "missing_disclaimer", F.lit(0.5),
               F.lit("Adicionar aviso para consultar profissional qualificado")))
    lists = [first]
    if hallucinations:
        lists.append(F.transform(hallucinations, lambda c: text.record(
            kind=F.lit("hallucination"), severity=F.lit(0.8), suggestion=c)))
    if violations:
        lists.append(F.transform(violations, lambda v: text.record(
            kind=F.lit("compliance_violation"),
            severity=F.when(v["severity"].isin("critical", "high"), F.lit(0.9)).otherwise(F.lit(0.6)),
            suggestion=v["remediation"])))
    lists.append(last)
    frame = frame.withColumn("issues", F.filter(F.concat(*lists), lambda i: i.isNotNull()))

    def of(*kinds: str) -> Column:
        return F.transform(F.filter("issues", lambda i: i["kind"].isin(*kinds)), lambda i: i["severity"])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    def remaining(*kinds: str) -> Column:
        values = of(*kinds)
        return F.when(F.size(values) > 0, 1 - total(values) / F.size(values)).otherwise(F.lit(1.0))

    def unit(value: Column) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 9)

    per_sentence = words / F.greatest("_sentences", F.lit(1))
    frame = (frame
             .withColumn("relevance_score", unit(remaining("low_relevance", "off_topic")))
             .withColumn("completeness_score", unit(remaining("incomplete_response")))
             .withColumn("clarity_score", unit(1 - F.abs(per_sentence - 15) / 30))
             .withColumn("factuality_score", unit(1 - 0.3 * total(of("hallucination")) - 0.1 * total(of("excessive_hedging"))))
             .withColumn("consistency_score", unit(remaining("inconsistent"))))
    overall = F.lit(0.0)
    for name, weight in fixed.QUALITY_WEIGHTS.items():
        overall = overall + F.col(f"{name}_score") * weight
    frame = frame.withColumn("overall", F.round(overall, 9))
    o = F.col("overall")
    severe = F.exists("issues", lambda i: i["severity"] >= 0.8)
    if violations:
        severe = severe | F.exists(violations, lambda v: v["severity"].isin("critical", "high"))
    frame = frame.withColumn("_severe", severe)
    unsure = (F.size("issues") > 0) & (o < LEAST_OVERALL + 0.2)
    state = (F.when(F.col("_severe"), truth.from_bool(F.lit(False), F.lit(0.9)))
             .when(o < LEAST_OVERALL, truth.state(o, 1 - o, F.lit(0.1)))
             .when(unsure, truth.undecidable(o)).otherwise(truth.from_bool(F.lit(True), o)))
    frame = frame.withColumn("is_valid", ~F.col("_severe") & (o >= LEAST_OVERALL)).withColumn("state", state)
    frame = frame.withColumn("decision", F.when(F.col("_severe"), F.lit("FALSE")).when(
        (o >= LEAST_OVERALL) & unsure, F.lit("UNDECIDABLE")).when(
        o >= LEAST_OVERALL, F.lit("TRUE")).otherwise(truth.collapse(F.col("state"))))
    top = F.slice(F.array_sort(F.transform("issues", lambda i, n: text.record(
        rank=-i["severity"], place=n, suggestion=i["suggestion"]))), 1, 3)
    guidance = F.array_join(F.transform(top, lambda i: i["suggestion"]), " | ")
    frame = frame.withColumn("retry_guidance", F.when(~F.col("is_valid"), F.when(
        F.size("issues") > 0, guidance).otherwise(F.lit("Melhorar qualidade geral da resposta"))))
    return frame.drop("_qw", "_aw", "_words", "_sentences", "_parts", "_inconsistent", "_severe")
