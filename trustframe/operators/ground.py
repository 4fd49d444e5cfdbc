"""Groundedness: claims of an answer, their evidence, propagation, spans and risk.

Evidence score of a claim in a context, 0 to 100: 100 when the context contains the claim; else the
share of the claim's distinct three-word runs (single words for claims under three words) that the
context has. It is a word-run score, not an edit alignment, so paraphrases may be labelled
differently than by an alignment score. Numbers are compared when the context has enough of the
claim's single words, because the number itself breaks the runs around it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import alignment, text
from trustframe.functions.session import cut_lineage

SUPPORT_AT = 75.0
NUMERIC_AT = 40.0
RISK_AT = 0.40
DAMPING = 0.15


def word_runs(words: Column) -> Column:
    """Distinct runs of three words, or the distinct words when there are fewer than three."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - 2),
                       lambda i: F.array_join(F.slice(words, i, 3), " "))
    return F.array_distinct(F.when(F.size(words) >= 3, runs).otherwise(words))


def split_answers(samples: DataFrame, keep: list[str], splitter=None) -> DataFrame:
    """One row per claim: the columns of ``keep``, ``pos`` and ``claim``.

    ``splitter`` is None for the library's own, a function from the column of answers to an array of claims, or a
    Python table function that yields (pos, claim), which is joined laterally.
    """
    if splitter is None or not hasattr(splitter, "returnType"):
        return text.each(samples, keep, (splitter or text.claims)(F.col("answer")), "claim", "pos")
    frame = samples.withColumn("_answer", F.col("answer"))
    return frame.lateralJoin(splitter(F.col("_answer").outer())).where(F.col("claim").isNotNull()).select(
        *keep, "pos", "claim")


def claim_rows(samples: DataFrame, keys: list[str], splitter=None) -> DataFrame:
    """One row per claim with its position; contexts are prepared once per sample.

    ``samples`` has the keys, ``answer`` and ``contexts`` (array of doc_id, text); ``splitter`` is that of
    ``split_answers``.
    """
    prepared = F.transform("contexts", lambda c: text.let(text.tokens(c["text"]), lambda w: text.record(
        doc_id=c["doc_id"], body=F.lower(c["text"]), runs=word_runs(w), words=F.array_distinct(w),
        numbers=text.numbers_with_units(c["text"]))))
    frame = samples.select(*keys, "answer", prepared.alias("prepared"))
    return split_answers(frame, [*keys, "answer", "prepared"], splitter)


def _scored_contexts(claim: Column, words: Column, runs: Column, prepared: Column) -> Column:
    body = F.lower(claim)

    def word_share(c: Column) -> Column:
        distinct = F.array_distinct(words)
        return F.when(F.size(distinct) > 0, F.round(
            100.0 * F.size(F.array_intersect(distinct, c["words"])) / F.size(distinct), 6)).otherwise(F.lit(0.0))

    def score(c: Column) -> Column:
        known = F.when(F.size(words) >= 3, c["runs"]).otherwise(c["words"])
        share = F.when(F.size(runs) > 0, 100.0 * F.size(F.array_intersect(runs, known)) / F.size(runs)
                       ).otherwise(F.lit(0.0))
        return F.when(F.contains(c["body"], body), F.lit(100.0)).otherwise(F.round(share, 6))

    return F.transform(prepared, lambda c, i: text.record(
        score=score(c), order=-i, word_share=word_share(c), doc_id=c["doc_id"], body=c["body"], words=c["words"],
        numbers=c["numbers"]))


def _label(score: Column, word_share: Column, claim_numbers: Column, context_numbers: Column) -> Column:
    conflict = (word_share >= NUMERIC_AT) & text.numeric_conflict(claim_numbers, context_numbers)
    return (F.when(conflict, F.lit("contradicted")).when(score >= SUPPORT_AT, F.lit("supported"))
            .otherwise(F.lit("unsupported")))


def evidence(claims: DataFrame) -> DataFrame:
    """Add label, confidence, best document and span, plus the label against each context."""
    frame = (claims.withColumn("claim_words", text.tokens(F.col("claim")))
             .withColumn("claim_runs", word_runs(F.col("claim_words")))
             .withColumn("claim_numbers", text.numbers_with_units(F.col("claim"))))
    frame = frame.withColumn("scored", _scored_contexts(
        F.col("claim"), F.col("claim_words"), F.col("claim_runs"), F.col("prepared")))
    best = F.array_max("scored")
    labels = F.transform("scored", lambda c: text.record(
        doc_id=c["doc_id"], label=_label(c["score"], c["word_share"], F.col("claim_numbers"), c["numbers"])))
    frame = frame.withColumn("best", best).withColumn("context_labels", labels)
    score = F.coalesce(F.col("best.score"), F.lit(0.0))
    label = F.coalesce(_label(score, F.col("best.word_share"), F.col("claim_numbers"), F.col("best.numbers")), F.lit("unsupported"))
    exact = F.position(F.lower("claim"), F.col("best.body"))
    met = F.array_intersect("claim_words", F.col("best.words"))
    starts = F.transform(met, lambda w: F.position(w, F.col("best.body")) - 1)
    ends = F.transform(met, lambda w: F.position(w, F.col("best.body")) - 1 + F.length(w))
    return (frame
            .withColumn("label", label)
            .withColumn("confidence", F.when(F.col("label") == "contradicted", F.col("best.word_share")).otherwise(score) / 100.0)
            .withColumn("evidence_doc", F.col("best.doc_id"))
            .withColumn("evidence_start", F.when(exact > 0, exact - 1).otherwise(F.array_min(starts)))
            .withColumn("evidence_end", F.when(exact > 0, exact - 1 + F.length("claim"))
                        .otherwise(F.array_max(ends)))
            .withColumn("depends", (F.col("pos") > 0) & text.depends_on_previous(F.col("claim")))
            .drop("claim_words", "claim_runs", "scored", "best", "prepared"))


def aligned_evidence(answers: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """Best partial alignment of each claim: keys, pos, claim, evidence_doc, edits, score, start and end.

    ``answers`` has the keys and ``claims`` (array), ``contexts`` the keys, ``doc_id`` and ``text``. Unlike the word
    runs of ``evidence``, an alignment bears misspelt and inserted words. Case doesn't count; places are those in the
    lower-cased text. The score is 100 less the share of the claim's characters that must be edited. Of several
    contexts the one with the fewest edits counts, of equal ones the smallest doc_id. A claim without any context has
    score 0 and no place. A context meets all claims of its answer as one row.
    """
    lowered = answers.select(*keys, F.transform("claims", F.lower).alias("claims"))
    pairs = lowered.join(contexts.select(*keys, "doc_id", F.lower("text").alias("text")), keys, "left")
    met = F.when(F.col("edits").isNotNull(), F.struct("edits", "doc_id", "start", "end"))
    best = alignment.align(pairs).groupBy(*keys, "pos").agg(F.first("claim").alias("claim"), F.min(met).alias("best"))
    share = 100.0 * (1 - F.col("best.edits") / F.greatest(F.length("claim"), F.lit(1)))
    return best.select(*keys, "pos", "claim", F.col("best.doc_id").alias("evidence_doc"), F.col("best.edits").alias("edits"),
                       F.coalesce(share, F.lit(0.0)).alias("score"), F.col("best.start").alias("start"),
                       F.col("best.end").alias("end"))


# ---------------------------------------------------------------------------- numbers across texts

def conflicting_numbers(texts: DataFrame, key: str, column: str, scope: list[str]) -> DataFrame:
    """Numbers of each text against those of all other texts of its scope.

    One row per (text, unit, value): ``n_same`` texts give that value for the unit, the text itself included,
    ``n_other`` give another one as well or instead, and ``low`` and ``high`` bound all values of the unit in the scope.
    Units must be equal after stop words are taken out. ``key`` names a text; null scopes count as one.

    No pairs are built: texts are counted per unit and per (unit, value), and the counts meet each mention by joins on
    these keys, which adaptive execution splits where a unit is very common.
    """
    numbers = texts.select(key, *scope, text.numbers_with_units(F.col(column)).alias("_numbers"))
    mentions = text.each(numbers, [key, *scope], F.array_distinct("_numbers"), "_n").select(
        key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in scope], F.col("_n.unit").alias("unit"),
        F.col("_n.value").alias("value"))
    mentions = cut_lineage(mentions.distinct())
    size = F.expr("try_cast(value AS decimal(38, 0))")
    per_text = mentions.groupBy(*scope, "unit", key).agg(
        F.count("*").alias("values"), F.min("value").alias("only"), F.min(size).alias("low"), F.max(size).alias("high"))
    per_unit = per_text.groupBy(*scope, "unit").agg(F.count("*").alias("n_texts"), F.min("low").alias("low"),
                                                    F.max("high").alias("high"))
    alone = per_text.where("values = 1").groupBy(*scope, "unit", F.col("only").alias("value")).agg(F.count("*").alias("n_only"))
    per_value = mentions.groupBy(*scope, "unit", "value").agg(F.count("*").alias("n_same")).join(
        alone, [*scope, "unit", "value"], "left").join(per_unit, [*scope, "unit"])
    counts = per_value.withColumn("n_other", F.col("n_texts") - F.coalesce("n_only", F.lit(0)))
    return mentions.join(counts.drop("n_only", "n_texts"), [*scope, "unit", "value"]).select(
        key, *scope, "unit", "value", "n_same", "n_other", "low", "high")


# ---------------------------------------------------------------------------- propagation

def propagate_chain(scored: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Pass labels and confidence down each run of dependent claims.

    Each claim depends at most on the one before it, so one ordered fold per answer is enough. The
    claims of one answer form one array; the answers, not the claims, are what Spark spreads.
    """
    carried = ["pos", "claim", "label", "confidence", "depends", *(extra or [])]
    grouped = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("items"))
    kind = scored.schema["label"].dataType.simpleString()

    def step(acc: Column, item: Column) -> Column:
        worse = (F.when(~item["depends"], item["label"])
                 .when(acc["label"] == "contradicted", F.lit("contradicted"))
                 .when((acc["label"] == "unsupported") & (item["label"] == "supported"), F.lit("unsupported"))
                 .otherwise(item["label"]))
        conf = F.when(item["depends"], item["confidence"] * (DAMPING + (1 - DAMPING) * acc["confidence"])
                      ).otherwise(item["confidence"])
        return text.record(label=worse, confidence=conf,
                           out=F.concat(acc["out"], F.array(text.record(l=worse, c=conf))))

    start = text.record(label=F.lit("supported"), confidence=F.lit(1.0),
                        out=F.array().cast(f"array<struct<l:{kind},c:double>>"))
    folded = grouped.withColumn("out", F.aggregate("items", start, step, lambda acc: acc["out"]))
    flat = folded.select(*keys, F.explode(F.arrays_zip("items", "out")).alias("x"))
    return flat.select(
        *keys, *[F.col(f"x.items.{c}").alias(c) for c in carried if c not in ("label", "confidence")],
        F.col("x.items.label").alias("own_label"), F.col("x.items.confidence").alias("own_confidence"),
        F.col("x.out.l").alias("label"), F.col("x.out.c").alias("confidence"))


def propagate_edges(claims: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Propagation over any dependency edges (keys, parent, child), cycles included, to the fixpoint.

    A child of several parents takes the worst label and, as its confidence, the value given by its
    last parent. Along last parents confidence is a chain of linear functions, so it is solved by
    doubling: each round joins a claim to what it depends on twice as far up, and the number of rounds
    grows with the logarithm of the depth. The worst label travels with it; other parents push theirs
    in between, until nothing changes.
    """
    rank = F.create_map(F.lit("supported"), F.lit(0), F.lit("unsupported"), F.lit(1),
                        F.lit("contradicted"), F.lit(2))
    words = F.array(F.lit("supported"), F.lit("unsupported"), F.lit("contradicted"))
    last = edges.groupBy(*keys, F.col("child").alias("claim_id")).agg(F.max("parent").alias("up"))
    own = claims.select(*keys, "claim_id", F.element_at(rank, F.col("label")).alias("rank"), "confidence")
    known = own.select(*keys, F.col("claim_id").alias("up"), F.lit(True).alias("there"))
    base = cut_lineage(own.join(last, [*keys, "claim_id"], "left").join(known, [*keys, "up"], "left").select(
        *keys, "claim_id", "rank", "confidence", F.when(F.col("there"), F.col("up")).alias("up")))
    far = _double(base.select(
        *keys, "claim_id", "rank", "up",
        F.when(F.col("up").isNull(), F.col("confidence")).otherwise(F.col("confidence") * DAMPING).alias("plus"),
        F.when(F.col("up").isNull(), F.lit(0.0)).otherwise(F.col("confidence") * (1 - DAMPING)).alias("times")), keys)
    confidence = far.select(*keys, "claim_id", F.col("plus").alias("confidence"))
    while True:
        worst = far.select(*keys, F.col("claim_id").alias("parent"), F.col("rank").alias("p_rank"))
        pushed = edges.join(worst, [*keys, "parent"]).groupBy(*keys, F.col("child").alias("claim_id")).agg(
            F.max("p_rank").alias("p_rank"))
        after = cut_lineage(far.select(*keys, "claim_id", "rank").join(pushed, [*keys, "claim_id"], "left").join(
            base.select(*keys, "claim_id", "up"), [*keys, "claim_id"]).select(
            *keys, "claim_id", "up", F.greatest("rank", F.coalesce("p_rank", F.lit(0))).alias("rank"),
            (F.coalesce("p_rank", F.lit(0)) > F.col("rank")).alias("moved")))
        if after.filter("moved").isEmpty():
            return after.join(confidence, [*keys, "claim_id"]).select(
                *keys, "claim_id", F.get(words, F.col("rank")).alias("label"), "confidence")
        far = _double(after.select(*keys, "claim_id", "rank", "up", F.lit(0.0).alias("plus"), F.lit(0.0).alias("times")), keys)


def _double(state: DataFrame, keys: list[str]) -> DataFrame:
    """Follows ``up`` to its end: the greatest rank on the way and the composed function of the confidence.

    On a cycle ``times`` shrinks with every round. It ends when all ends are reached, or when no rank
    changed in a whole round, after which none can, and no value changes any more.
    """
    while True:
        above = state.select(*keys, F.col("claim_id").alias("up"), F.col("up").alias("next"), F.col("rank").alias("a_rank"),
                             F.col("plus").alias("a_plus"), F.col("times").alias("a_times"))
        rank, plus = F.greatest("rank", F.coalesce("a_rank", F.lit(0))), F.col("plus") + F.col("times") * F.coalesce(
            "a_plus", F.lit(0.0))
        state = cut_lineage(state.join(above, [*keys, "up"], "left").select(
            *keys, "claim_id", rank.alias("rank"), plus.alias("plus"),
            (F.col("times") * F.coalesce("a_times", F.lit(0.0))).alias("times"), F.col("next").alias("up"),
            (rank > F.col("rank")).alias("changed"), (F.col("next").isNotNull() & (F.col("times") > 1e-12)).alias("open")))
        left = state.agg(F.bool_or("changed").alias("changed"), F.bool_or("open").alias("open"),
                         F.bool_or(F.col("up").isNotNull()).alias("far")).first()
        if not (left["far"] and (left["changed"] or left["open"])):
            return state.drop("changed", "open")


def link_orphans(claims: DataFrame, keys: list[str], least: float = 0.72) -> DataFrame:
    """Edges (keys, parent, child) from claims without any dependency to their most similar claim.

    Similarity is one minus the edit distance of the sorted words over the longer length. Pairs
    whose lengths alone rule the limit out are never measured. The pairs stay inside one answer.
    """
    sorted_words = F.array_join(F.array_sort(text.space_words(F.col("claim"))), " ")
    items = (claims.select(*keys, "pos", "depends", sorted_words.alias("words")).groupBy(*keys)
             .agg(F.array_sort(F.collect_list(F.struct("pos", "depends", "words"))).alias("items")))
    has_child = F.transform("items", lambda a: F.exists("items", lambda b: b["depends"] & (b["pos"] == a["pos"] + 1)))
    frame = items.withColumn("has_child", has_child)
    child = frame.select(*keys, "items", "has_child", F.explode("items").alias("child"))
    child = child.filter(~F.col("child.depends") & ~F.get("has_child", F.col("child.pos")))

    def similarity(a: Column, b: Column) -> Column:
        longer = F.greatest(F.length(a), F.length(b))
        possible = F.abs(F.length(a) - F.length(b)) <= longer * (1 - least)
        return F.when(possible, 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(-1.0))

    best = F.array_max(F.transform(
        F.filter("items", lambda b: b["pos"] != F.col("child.pos")),
        lambda b: text.record(similarity=similarity(b["words"], F.col("child.words")), order=-b["pos"])))
    return (child.withColumn("best", best).filter(F.col("best.similarity") >= least)
            .select(*keys, (-F.col("best.order")).alias("parent"), F.col("child.pos").alias("child"),
                    F.round("best.similarity", 9).alias("similarity")))


def graph_text(propagated: DataFrame, keys: list[str], style: str = "mermaid") -> DataFrame:
    """The claim graph of each answer as Mermaid or DOT text."""
    name = F.concat(F.lit("c"), F.col("pos") + 1)
    escaped = F.replace("claim", F.lit('"'), F.lit('\\"'))
    conf = F.format_number("confidence", 2)
    if style == "mermaid":
        node = F.concat(F.lit("    "), name, F.lit('["'), name, F.lit(": "), escaped, F.lit(" ("), "label",
                        F.lit(", conf: "), conf, F.lit(')"]'))
        edge = F.concat(F.lit("    c"), F.col("pos"), F.lit(" --> "), name)
        head, tail = ["graph TD"], []
    else:
        node = F.concat(F.lit("    "), name, F.lit(' [label="'), name, F.lit(": "), escaped, F.lit("\\n("),
                        "label", F.lit(", conf: "), conf, F.lit(')"];'))
        edge = F.concat(F.lit("    c"), F.col("pos"), F.lit(" -> "), name, F.lit(";"))
        head, tail = ["digraph G {", "    node [shape=box];"], ["}"]
    lines = (propagated.select(*keys, "pos", node.alias("node"), F.when(F.col("depends"), edge).alias("edge"))
             .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "node", "edge"))).alias("x")))
    nodes = F.transform("x", lambda r: r["node"])
    edges = F.filter(F.transform("x", lambda r: r["edge"]), lambda e: e.isNotNull())
    all_lines = F.concat(text.words_array(head), nodes, edges,
                         text.words_array(tail) if tail else F.array().cast("array<string>"))
    return lines.select(*keys, F.array_join(all_lines, "\n").alias("graph"))


# ---------------------------------------------------------------------------- sources in conflict

def adjudicate(frame: DataFrame) -> DataFrame:
    """Penalise claims that one context supports and another contradicts, unless the answer says so."""
    supports = F.filter("context_labels", lambda c: c["label"] == "supported")
    against = F.filter("context_labels", lambda c: c["label"] == "contradicted")
    conflict = (F.size(supports) > 0) & (F.size(against) > 0)
    warned = text.has_divergence_marker(F.col("answer")) | text.has_divergence_marker(F.col("claim"))
    status = (F.when(F.size("context_labels") < 2, F.lit("no_conflict_possible"))
              .when(conflict & ~warned, F.lit("arbitrary_unilateral_choice"))
              .when(conflict, F.lit("adjudicated_correctly")).otherwise(F.lit("consistent_sources")))
    frame = frame.withColumn("source_status", status)
    penalised = F.col("source_status") == "arbitrary_unilateral_choice"
    return (frame
            .withColumn("label", F.when(penalised, F.lit("contradicted")).otherwise(F.col("label")))
            .withColumn("confidence", F.when(penalised, F.greatest(F.lit(0.1), F.col("confidence") - 0.5))
                        .otherwise(F.col("confidence"))))


# ---------------------------------------------------------------------------- spans

def merge_intervals(intervals: Column) -> Column:
    """Merge overlapping or touching (start, end) intervals of one text."""
    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        merged = text.record(start=last["start"], end=F.greatest(last["end"], x["end"]))
        joins = (F.size(acc) > 0) & (x["start"] <= last["end"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))
                      ).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(intervals), F.array().cast("array<struct<start:int,end:int>>"), step)


def interval_length(intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0), lambda acc, x: acc + x["end"] - x["start"])


def interval_overlap(left: Column, right: Column) -> Column:
    """Characters that two sets of merged intervals share."""
    def shared(a: Column) -> Column:
        return F.aggregate(right, F.lit(0), lambda acc, b: acc + F.greatest(
            F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])))

    return F.aggregate(left, F.lit(0), lambda acc, a: acc + shared(a))


def unsupported_intervals(answer: Column, items: Column) -> Column:
    """Where the claims that are not supported stand in the answer with white space collapsed."""
    def found(body: Column) -> Column:
        return F.transform(F.filter(items, lambda c: c["label"] != "supported"), lambda c: text.let(
            F.position(F.lower(c["claim"]), body) - 1, lambda at: text.record(start=at, end=at + F.length(c["claim"]))))

    spans = text.let(F.lower(text.squeeze(answer)), found)  # the answer is read once, not for each claim
    return merge_intervals(F.filter(spans, lambda s: s["start"] >= 0))


def span_f1(predicted: Column, gold: Column) -> Column:
    """Character F1 of predicted intervals against gold intervals."""
    p, g = interval_length(predicted), interval_length(gold)
    hit = interval_overlap(predicted, gold)
    return (F.when((p == 0) & (g == 0), F.lit(1.0)).when((p == 0) | (g == 0) | (hit == 0), F.lit(0.0))
            .otherwise(2.0 * hit / (p + g)))


# ---------------------------------------------------------------------------- scores per answer

def support_scores(labelled: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Support rate and label counts per answer."""
    total = F.count("*")
    return labelled.groupBy(*keys).agg(
        total.alias("claims"),
        *[F.count_if(F.col(label) == name).alias(name) for name in ("supported", "contradicted", "unsupported")],
        (F.count_if(F.col(label) == "supported") / total).alias("support_rate"))


def abstention_risk(support_rate: Column, contradicted: Column, unsupported_rate: Column) -> Column:
    mixed = 0.7 * (1 - support_rate) + 0.3 * unsupported_rate
    return F.when(contradicted > 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)))


def prediction_set(label: Column, confidence: Column, q_hat: Column) -> Column:
    """Classes whose probability reaches 1 - q_hat, or the predicted class alone."""
    rest = F.greatest(F.lit(0.0), 1 - confidence) / 2
    classes = text.words_array(["supported", "unsupported", "contradicted"])
    chosen = F.filter(classes, lambda c: 1 - F.when(c == label, confidence).otherwise(rest) <= q_hat)
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.array(label))


def evaluate(samples: DataFrame, keys: list[str], q_hat: float = 0.70) -> DataFrame:
    """Groundedness of every answer: one row with support, conflict, span and risk values."""
    scored = evidence(claim_rows(samples, keys))
    propagated = propagate_chain(scored, keys, ["context_labels", "answer"])
    judged = adjudicate(propagated).withColumn(
        "set_size", F.size(prediction_set(F.col("label"), F.col("confidence"), F.lit(q_hat))))

    def of(value: str) -> Column:
        return F.count_if(F.col("source_status") == value)

    conflicts = of("arbitrary_unilateral_choice") + of("adjudicated_correctly")
    per = judged.groupBy(*keys).agg(
        F.count("*").alias("claims"), F.any_value("answer").alias("answer"),
        (F.count_if(F.col("own_label") == "supported") / F.count("*")).alias("support_rate_raw"),
        (F.count_if(F.col("label") == "supported") / F.count("*")).alias("support_rate_propagated"),
        F.count_if(F.col("own_label") == "contradicted").alias("contradicted"),
        conflicts.alias("conflicting_claims"), of("arbitrary_unilateral_choice").alias("penalized_claims"),
        F.avg("set_size").alias("mean_set_size"), F.min("confidence").alias("least_confidence"),
        F.collect_list(F.struct("claim", "label")).alias("items"))
    # an answer without any claim is a row too: nothing in it is supported
    none = F.lit(0).cast("bigint")
    per = samples.select(*keys, F.col("answer").alias("whole")).join(per, keys, "left").select(
        *keys, *[F.coalesce(c, none).alias(c) for c in ("claims", "contradicted", "conflicting_claims", "penalized_claims")],
        F.col("whole").alias("answer"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in (
            "support_rate_raw", "support_rate_propagated", "mean_set_size", "least_confidence")],
        F.coalesce("items", F.array().cast(per.schema["items"].dataType)).alias("items"))
    spans = unsupported_intervals(F.coalesce("answer", F.lit("")), F.col("items"))
    return (per.withColumn("spans", spans)
            .withColumn("unsupported_chars", interval_length(F.col("spans")))
            .withColumn("total_chars", F.length(text.squeeze(F.col("answer"))))
            .withColumn("unsupported_rate", F.when(F.col("total_chars") > 0, F.col("unsupported_chars") / F.col("total_chars"))
                        .otherwise(F.lit(0.0)))
            .withColumn("risk", abstention_risk(F.col("support_rate_raw"), F.col("contradicted"),
                                                F.col("unsupported_rate")))
            .withColumn("recommend_abstention", F.col("risk") >= RISK_AT)
            .withColumn("source_score", F.when(F.col("conflicting_claims") > 0,
                        1 - F.col("penalized_claims") / F.col("conflicting_claims")).otherwise(F.lit(1.0)))
            .drop("items"))


# ---------------------------------------------------------------------------- gold labels

def align_gold(claims: DataFrame, least: float = 0.60) -> DataFrame:
    """Best gold claim of each claim by edit similarity above ``least``; null when there is none.

    ``claims`` has ``claim`` and ``gold`` (array of text, label). Lengths rule pairs out first; the edits of the others
    are counted in blocks of pairs.
    """
    def similarity(gold: Column, i: Column) -> Column:
        longer = F.greatest(F.length("claim"), F.length(gold))
        return F.coalesce(F.round(1 - F.get(F.col("_edits"), i) / longer, 9), F.lit(0.0))

    claims = claims.withColumn("_edits", alignment.close_edits(
        F.col("claim"), F.transform("gold", lambda g: g["text"]), least))
    best = F.array_max(F.transform("gold", lambda g, i: text.record(
        similarity=similarity(g["text"], i), order=-i, text=g["text"], label=g["label"])))
    frame = claims.withColumn("_best", best)
    hit = F.col("_best.similarity") > least
    return (frame.withColumn("gold_label", F.when(hit, F.col("_best.label")))
            .withColumn("gold_similarity", F.when(hit, F.col("_best.similarity"))).drop("_best", "_edits"))


def gold_scores(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of the supported class per answer."""
    said, true = F.col("label") == "supported", F.col("gold_label") == "supported"
    known = F.col("gold_label").isNotNull()
    counts = aligned.groupBy(*keys).agg(
        F.count_if(said & known & true).alias("tp"),
        F.count_if(said & ~F.coalesce(known & true, F.lit(False))).alias("fp"),
        F.count_if(~said & known & true).alias("fn"))
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


# ---------------------------------------------------------------------------- routing

def route(scored: DataFrame, heavy: Callable[[DataFrame], DataFrame], exact_at: float = 0.95) -> DataFrame:
    """Let the cheap labels stand where they decide and send only the rest to ``heavy``.

    Numeric contradictions and near-exact matches are final. ``scored`` carries ``cost``, the price
    of a heavy call; it is saved or spent. ``heavy`` takes and returns a frame with label and
    confidence, so a model runs in Arrow batches over the remainder only.
    """
    fast = (F.when(F.col("label") == "contradicted", F.lit("fast_contradiction"))
            .when((F.col("label") == "supported") & (F.col("confidence") >= exact_at), F.lit("fast_exact_match"))
            .otherwise(F.lit("heavy")))
    routed = scored.withColumn("route", fast)
    zero = F.lit(0.0)
    cheap = (routed.filter("route <> 'heavy'").withColumn("usd_saved", F.col("cost")).withColumn("usd_spent", zero))
    rest = (heavy(routed.filter("route = 'heavy'")).withColumn("usd_saved", zero)
            .withColumn("usd_spent", F.col("cost")))
    return cheap.unionByName(rest)


def lexical_backend(claims: DataFrame) -> DataFrame:
    """The default backend: labels from the evidence score."""
    return evidence(claims)

