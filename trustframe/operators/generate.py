"""Test data from existing samples: perturbed answers and generated retrieval cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import fixed, text


def keyed_number(key: Column, bound: int) -> Column:
    """Repeatable number below ``bound`` from a text key."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(bound))


def negate(col: Column) -> Column:
    """Put a negation after the first word of a text with more than one word."""
    return F.regexp_replace(col, r"^(\S+) ", "$1 não ")


def swap_numbers(col: Column, key: Column) -> Column:
    """Add 10 to 100 to every whole number; the same key and number give the same noise."""
    gaps = F.split(col, r"\b\d+\b")
    numbers = F.regexp_extract_all(col, F.lit(r"\b\d+\b"), F.lit(0))

    def changed(n: Column) -> Column:
        noise = keyed_number(F.concat_ws(":", key, n), 91) + 10
        plain = F.try_add(n.try_cast("bigint"), noise)
        return F.coalesce(plain.cast("string"), n)

    pieces = F.zip_with(gaps, numbers, lambda g, n: F.concat(
        F.coalesce(g, F.lit("")), F.when(n.isNull(), F.lit("")).otherwise(changed(n))))
    return F.array_join(pieces, "")


def injected_sentence(col: Column, key: Column) -> Column:
    """A false sentence about a name-like word of the text, picked by key."""
    words = F.transform(F.split(text.squeeze(col), " "), lambda w: F.regexp_replace(
        w, r"^[.,;:?!()]+|[.,;:?!()]+$", ""))
    names = F.filter(words, lambda w: (F.length(w) > 5) & F.rlike(w, F.lit(r"^\p{Lu}")))
    long = F.filter(words, lambda w: F.length(w) > 6)
    pool = F.when(F.size(names) > 0, names).when(F.size(long) > 0, long).otherwise(
        F.array(F.lit(fixed.INJECTION_FALLBACK)))
    entity = text.let(pool, lambda p: F.get(p, F.pmod(keyed_number(key, 1_000_003), F.size(p)).cast("int")))
    forms = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after"))
                      for a, b in (s.split("{}") for s in fixed.INJECTED_SENTENCES)])
    form = F.get(forms, keyed_number(F.concat(key, F.lit(":form")), len(fixed.INJECTED_SENTENCES)).cast("int"))
    return F.concat(form["before"], entity, form["after"])


def _replace_all(col: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, "(?i)" + p[0], p[1]), pairs, col)


def telemarketing(col: Column) -> Column:
    """Wordy gerund style; a fixed opening when nothing else applies."""
    done = _replace_all(col, fixed.TELEMARKETING)
    opened = F.concat(F.lit(fixed.TELEMARKETING_PREFIX), F.lower(F.substring(col, 1, 1)),
                      F.substring(col, 2, 1 << 30))
    return F.when(done == col, opened).otherwise(done)


def false_cognates(col: Column) -> Column:
    done = _replace_all(col, fixed.FALSE_COGNATES)
    return F.when(done == col, _replace_all(col, fixed.FALSE_COGNATE_WORDS)).otherwise(done)


def perturb(samples: DataFrame, key: str, strategies: list[str] | None = None) -> DataFrame:
    """Every sample under every strategy, with its gold claims and unsupported spans rebuilt.

    ``samples`` has the key, ``answer`` and ``gold`` (array of text, label). The strategies are a
    fixed short list, so each sample grows by a constant factor and nothing is shuffled.
    """
    chosen = strategies or fixed.PERTURBATIONS
    unknown = set(chosen) - set(fixed.PERTURBATIONS)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    rows = samples.withColumn("strategy", F.explode(text.words_array(chosen)))
    k, strategy, answer = F.col(key).cast("string"), F.col("strategy"), F.col("answer")
    sentence = injected_sentence(answer, k)
    new_answer = (F.when(strategy == "number_swap", swap_numbers(answer, k))
                  .when(strategy == "negation", negate(answer))
                  .when(strategy == "injection", F.concat(answer, sentence))
                  .when(strategy == "pt_telemarketing", telemarketing(answer))
                  .when(strategy == "language_induced_hallucination", false_cognates(answer))
                  .otherwise(F.lit(fixed.CONFLICT_ANSWER)))

    def claim(c: Column) -> Column:
        changed = (F.when(strategy == "number_swap", swap_numbers(c["text"], k))
                   .when(strategy == "negation", negate(c["text"]))
                   .when(strategy == "pt_telemarketing", telemarketing(c["text"]))
                   .when(strategy == "language_induced_hallucination", false_cognates(c["text"]))
                   .otherwise(c["text"]))
        turned = ((strategy == "number_swap") & (changed != c["text"])) | strategy.isin(
            "negation", "language_induced_hallucination")
        return text.record(text=changed, label=F.when(turned, F.lit("contradicted")).otherwise(c["label"]))

    def one(body: Column, label: str) -> Column:
        return F.array(text.record(text=body, label=F.lit(label)))

    gold = (F.when(strategy == "conflicting_context", one(F.lit(fixed.CONFLICT_ANSWER), "contradicted"))
            .when(strategy == "injection", F.concat(F.transform("gold", claim), one(F.trim(sentence), "unsupported")))
            .otherwise(F.transform("gold", claim)))
    out = rows.select(
        F.concat_ws("_", k, F.lit("perturb"), strategy).alias("id"), F.col(key), "strategy",
        new_answer.alias("new_answer"), gold.alias("gold"), "answer")
    injected = F.col("strategy") == "injection"
    return out.select(
        "id", key, "strategy", F.col("new_answer").alias("answer"), "gold",
        F.when(injected, F.length("answer")).alias("unsupported_start"),
        F.when(injected, F.length("new_answer")).alias("unsupported_end"),
        F.when(F.col("strategy") == "conflicting_context", F.array(*[
            F.struct(F.lit(d).alias("doc_id"), F.lit(t).alias("text")) for d, t in fixed.CONFLICT_CONTEXTS])
               ).alias("contexts"))


CASE_TYPES = ["supported", "contradicted", "partial", "unanswerable"]


def retrieval_cases(scenarios: DataFrame) -> DataFrame:
    """Four cases per scenario (id, topic, policy, exception): what differs is gold and decision."""
    kind = F.col("case_type")
    rows = scenarios.withColumn("case_type", F.explode(text.words_array(CASE_TYPES)))
    doc = F.concat(F.col("id").cast("string"), F.lit("-policy"))
    other = F.concat(F.col("id").cast("string"), F.lit("-exception"))
    none = F.array().cast("array<string>")
    return rows.select(
        F.concat_ws("-", F.col("id").cast("string"), kind).alias("case_id"), "case_type",
        F.concat(F.lit("What does the policy say about "), "topic", F.when(
            kind == "unanswerable", F.lit(" in another region")).otherwise(F.lit("")), F.lit("?")).alias("query"),
        F.array(F.struct(doc.alias("document_id"), F.col("policy").alias("text")),
                F.struct(other.alias("document_id"), F.col("exception").alias("text"))).alias("documents"),
        F.when(kind == "unanswerable", none).when(kind == "partial", F.array(doc, other))
        .otherwise(F.array(doc)).alias("relevant_document_ids"),
        F.when(kind == "supported", F.lit("TRUE")).when(kind == "contradicted", F.lit("FALSE"))
        .otherwise(F.lit("UNDECIDABLE")).alias("expected_decision"))
