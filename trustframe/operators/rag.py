"""Retrieval evaluation: ranking, context assembly, stage metrics and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.functions import vectors

SCORE_DIGITS = 9


def score_pairs(case_documents: DataFrame) -> DataFrame:
    """Cosine per (case, document) of a frame with ``query_vector`` and ``document_vector``.

    Norms that the frame brings as ``query_norm`` and ``document_norm`` are not computed again; that
    saves work when a vector takes part in many pairs.
    """
    for side in ("query", "document"):
        if f"{side}_norm" not in case_documents.columns:
            case_documents = case_documents.withColumn(f"{side}_norm", vectors.norm(F.col(f"{side}_vector")))
    return (case_documents
            .withColumn("score", F.round(vectors.cosine(
                F.col("query_vector"), F.col("document_vector"),
                F.col("query_norm"), F.col("document_norm")), SCORE_DIGITS))
            .drop("query_vector", "document_vector", "query_norm", "document_norm"))


def top_documents(scored: DataFrame, k: int) -> DataFrame:
    """The first ``k`` documents of each case by score, ties by id, with their rank.

    A rank filter on ``row_number`` is cut per partition before the shuffle, so a case with very
    many documents sends at most ``k`` rows per task.
    """
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), F.asc("document_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def first_relevant_rank(scored: DataFrame) -> DataFrame:
    """Rank of the best relevant document of each case in the full ranking.

    It is one plus the number of documents that sort before the best relevant one: two
    aggregations, so no case is ever sorted as a whole.
    """
    best = (scored.filter("relevant").groupBy("case_id").agg(F.min_by(
        F.struct("score", "document_id"), F.struct((-F.col("score")).alias("s"), "document_id")).alias("best")))
    ahead = (F.col("score") > F.col("best.score")) | (
        (F.col("score") == F.col("best.score")) & (F.col("document_id") < F.col("best.document_id")))
    return (scored.select("case_id", "document_id", "score").join(best, "case_id")
            .groupBy("case_id").agg((F.count_if(ahead) + 1).alias("first_rank")))


def context_scores(context: Column, relevant: Column) -> dict[str, Column]:
    """Precision, recall and duplicate share of a context against the relevant ids."""
    unique = F.array_distinct(context)
    hits = F.size(F.array_intersect(unique, relevant))
    return {
        "precision": F.when(F.size(unique) > 0, hits / F.size(unique)).otherwise(F.lit(0.0)),
        "recall": F.when(F.size(relevant) > 0, hits / F.size(relevant)).otherwise(F.lit(0.0)),
        "duplicate_rate": F.when(F.size(context) > 0,
                                 (F.size(context) - F.size(unique)) / F.size(context)).otherwise(F.lit(0.0)),
    }


def case_results(cases: DataFrame, scored: DataFrame, k: int = 3, policy: str = "declared",
                 min_similarity: float = 0.40, relative: float = 0.85) -> DataFrame:
    """One row per case with pre-, during- and post-retrieval values.

    ``cases`` has case_id, relevant (ids), retrieved (declared ids, may be null) and may have
    expected_decision and observed_decision; the latter may come from any column or Arrow function
    that judges the answer. ``scored`` has case_id, document_id, score, relevant.
    """
    return searched_results(cases, top_documents(scored, max(k, 1)), first_relevant_rank(scored), k, policy,
                            min_similarity, relative)


def searched_results(cases: DataFrame, top: DataFrame, first: DataFrame, k: int = 3, policy: str = "declared",
                     min_similarity: float = 0.40, relative: float = 0.85) -> DataFrame:
    """``case_results`` from the best documents and first relevant ranks that a search has found."""
    if policy not in ("declared", "adaptive"):
        raise ValueError("policy must be 'declared' or 'adaptive'")
    if k < 1 or not 0.0 <= relative <= 1.0 or min_similarity < -1.0:
        raise ValueError("k, relative or min_similarity out of range")
    ranked = (top.groupBy("case_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "document_id", "score"))).alias("top")))
    frame = (cases.join(ranked, "case_id", "left").join(first, "case_id", "left")
             .withColumn("top", F.coalesce("top", F.array().cast(ranked.schema["top"].dataType))))
    for name in ("expected_decision", "observed_decision"):
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(None).cast("string"))
    top_ids = F.transform("top", lambda t: t["document_id"])
    top1 = F.coalesce(F.get("top", 0)["score"], F.lit(0.0))
    floor = F.greatest(F.lit(min_similarity), top1 * relative)
    frame = (frame.withColumn("top1_similarity", top1)
             .withColumn("candidate", F.when(F.size(F.coalesce("retrieved", F.array())) > 0,
                                             F.col("retrieved")).otherwise(top_ids)))
    adaptive = F.transform(F.filter("top", lambda t: t["score"] >= floor), lambda t: t["document_id"])
    frame = frame.withColumn("context", F.col("candidate") if policy == "declared" else adaptive)
    candidate = context_scores(F.col("candidate"), F.col("relevant"))
    context = context_scores(F.col("context"), F.col("relevant"))
    return frame.select(
        "case_id", "expected_decision", "observed_decision", "relevant", "candidate", "context", "top",
        F.arrays_overlap(top_ids, "relevant").cast("double").alias("hit_at_k"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"), "top1_similarity",
        *[v.alias(f"candidate_{n}") for n, v in candidate.items()],
        *[v.alias(f"context_{n}") for n, v in context.items()])


def stage_metrics(results: DataFrame) -> DataFrame:
    """All stage means in one aggregation, each over its own denominator."""
    has_gold, has_context = F.size("relevant") > 0, F.size("context") > 0
    has_candidate = F.size("candidate") > 0
    judged = F.col("expected_decision").isNotNull() & F.col("observed_decision").isNotNull()

    def mean(value, where=F.lit(True)):
        column = F.col(value) if isinstance(value, str) else value
        return F.coalesce(F.avg(F.when(where, column)), F.lit(0.0))

    return results.agg(
        F.count("*").alias("sample_count"),
        mean("hit_at_k", has_gold).alias("hit_at_k"),
        mean("reciprocal_rank", has_gold).alias("mrr"),
        mean("top1_similarity").alias("top1_similarity"),
        F.count_if(has_gold).alias("evaluable_queries"),
        mean("context_precision", has_context).alias("context_precision"),
        mean("context_recall", has_gold).alias("context_recall"),
        mean("context_duplicate_rate", has_context).alias("duplicate_rate"),
        mean("context_recall", has_gold).alias("evidence_coverage"),
        mean("candidate_precision", has_candidate).alias("candidate_context_precision"),
        mean("candidate_recall", has_gold).alias("candidate_context_recall"),
        mean("candidate_duplicate_rate", has_candidate).alias("candidate_duplicate_rate"),
        mean(F.size("context").cast("double")).alias("context_size"),
        mean((~has_context).cast("double")).alias("context_abstention_rate"),
        F.count_if(has_context).alias("context_evaluable_cases"),
        mean((F.col("expected_decision") == F.col("observed_decision")).cast("double"), judged)
        .alias("decision_accuracy"))


def threshold_grid(first: float = 0.20, last: float = 0.80, step: float = 0.01) -> list[float]:
    return [round(first + i * step, 4) for i in range(int(round((last - first) / step)) + 1)]


def threshold_curve(results: DataFrame, thresholds: list[float], relative: float = 0.85) -> DataFrame:
    """Context precision, recall, F1 and abstention at every threshold.

    A case's context only changes where the threshold passes one of its top-k scores. So each case
    gives at most k+1 changes, placed on the grid, instead of one row per threshold; the curve is
    the cumulative sum of the changes over the grid.
    """
    if not thresholds:
        raise ValueError("at least one threshold is needed")
    grid = sorted(set(thresholds))
    count = len(grid)
    top1 = F.coalesce(F.get("top", 0)["score"], F.lit(0.0))
    grid_array = F.array(*[F.lit(t) for t in grid])
    kept = F.filter("top", lambda t: t["score"] >= top1 * relative)
    size, gold = F.col("size"), F.size("relevant")
    # the context of size s holds for grid positions from the (s+1)-th score up to the s-th score
    passed = F.transform(F.col("kept"), lambda t: F.size(F.filter(grid_array, lambda g: g <= t["score"])))
    frame = (results.select("case_id", "relevant", "hit_at_k", "reciprocal_rank", kept.alias("kept"))
             .withColumn("passed", passed)
             .withColumn("hit_flags", F.transform(
                 "kept", lambda t: F.array_contains("relevant", t["document_id"]).cast("int"))))
    states = frame.select(
        "relevant", "hit_at_k", "reciprocal_rank", "passed", "hit_flags",
        F.explode(F.sequence(F.lit(0), F.size("kept"))).alias("size"))
    first = F.when(size == F.size("passed"), F.lit(0)).otherwise(F.get("passed", size))
    after = F.when(size == 0, F.lit(count)).otherwise(F.get("passed", size - 1))
    hits = F.aggregate(F.slice("hit_flags", 1, size), F.lit(0), lambda a, x: a + x)
    states = (states.withColumn("first", first).withColumn("after", after).withColumn("hits", hits)
              .filter(F.col("first") < F.col("after")))
    measures = {
        "with_context": (size > 0).cast("double"),
        "precision_sum": F.when(size > 0, F.col("hits") / size).otherwise(F.lit(0.0)),
        "recall_sum": F.when(gold > 0, F.col("hits") / gold).otherwise(F.lit(0.0)),
        "useful": ((size == 0) & (gold == 0)).cast("double"),
        "harmful": ((size == 0) & (gold > 0)).cast("double"),
        "size_sum": size.cast("double"),
    }
    changes = (states.select(*[m.alias(n) for n, m in measures.items()], F.explode(F.array(
        F.struct(F.col("first").alias("at"), F.lit(1).alias("sign")),
        F.struct(F.col("after").alias("at"), F.lit(-1).alias("sign")))).alias("e"))
        .groupBy(F.col("e.at").alias("position"))
        .agg(*[F.sum(F.col(n) * F.col("e.sign")).alias(n) for n in measures]))
    spark = results.sparkSession
    points = spark.createDataFrame([(i, t) for i, t in enumerate(grid)], "position int, threshold double")
    # at most one row per grid point from here on
    upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    sums = (points.join(changes, "position", "left")
            .select("position", "threshold", *[F.sum(F.coalesce(F.col(n), F.lit(0.0))).over(upto).alias(n)
                                               for n in measures]))
    totals = results.agg(
        F.count("*").alias("cases"), F.count_if(F.size("relevant") > 0).alias("with_gold"),
        F.coalesce(F.avg(F.when(F.size("relevant") > 0, F.col("hit_at_k"))), F.lit(0.0)).alias("hit_at_k"),
        F.coalesce(F.avg(F.when(F.size("relevant") > 0, F.col("reciprocal_rank"))), F.lit(0.0)).alias("mrr"),
        F.lit(1).alias("one"))

    def share(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    joined = sums.withColumn("one", F.lit(1)).join(totals, "one")
    joined = (joined
              .withColumn("context_precision", F.round(share(F.col("precision_sum"), F.round("with_context")), 9))
              .withColumn("context_recall", F.round(share(F.col("recall_sum"), F.col("with_gold")), 9)))
    p, r = F.col("context_precision"), F.col("context_recall")
    return joined.select(
        "threshold", "context_precision", "context_recall",
        F.round(share(2 * p * r, p + r), 9).alias("context_f1"),
        F.round(share(F.round(F.col("useful") + F.col("harmful")), F.col("cases")), 9).alias("abstention_rate"),
        F.round(share(F.round("useful"), F.col("cases") - F.col("with_gold")), 9).alias("useful_abstention_rate"),
        F.round(share(F.round("harmful"), F.col("with_gold")), 9).alias("harmful_abstention_rate"),
        F.round(share(F.round("size_sum"), F.col("cases")), 9).alias("mean_context_size"),
        F.round("with_context").cast("bigint").alias("precision_evaluable_cases"),
        F.col("with_gold").alias("recall_evaluable_queries"),
        F.round("hit_at_k", 9).alias("hit_at_k"), F.round("mrr", 9).alias("mrr"))


def recommend_threshold(curve: DataFrame) -> DataFrame:
    """The point with the best F1, then precision, then least harmful abstention, then threshold."""
    key = F.struct("context_f1", "context_precision", (-F.col("harmful_abstention_rate")).alias("calm"),
                   "threshold")
    best = F.max_by(F.struct("threshold", "context_f1", "context_precision", "harmful_abstention_rate"), key)
    return curve.agg(best.alias("b")).select("b.*")
