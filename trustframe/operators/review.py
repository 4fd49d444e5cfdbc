"""Review metrics: decisions, calibration, conformal sets, agreement, gates and costs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.session import cut_lineage
from trustframe.operators.ordered import order_statistic


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def expected_from_label(label: Column) -> Column:
    """Decision that a seed label asks for."""
    open_labels = ["unsupported", "partially_unsupported", "missing_authorization", "wrong_tenant"]
    return (F.when(F.contains(label, F.lit("undecidable")) | label.isin(open_labels), F.lit("UNDECIDABLE"))
            .when(label.isin("contradicted", "deny", "policy_violation"), F.lit("FALSE"))
            .otherwise(F.lit("TRUE")))


def judge_by_rules(answer: Column, rules: list[tuple[str, list[str], list[str]]]) -> Column:
    """Decision of the first rule whose texts all stand in the answer and whose others do not."""
    lower, out = F.lower(answer), None
    for decision, needed, barred in rules:
        fits = F.lit(True)
        for words, wanted in ((needed, True), (barred, False)):
            for w in words:
                found = F.contains(lower, F.lit(w))
                fits = fits & (found if wanted else ~found)
        out = F.when(fits, F.lit(decision)) if out is None else out.when(fits, F.lit(decision))
    return out.otherwise(F.lit("UNDECIDABLE"))


def decision_metrics(frame: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, false allow/block and abstention rates of (expected, observed) decisions."""
    e, o = F.col("expected"), F.col("observed")
    n = F.count("*")
    open_cases, useful = F.count_if(e == "UNDECIDABLE"), F.count_if((e == "UNDECIDABLE") & (o == "UNDECIDABLE"))
    closed, harmful = F.count_if(e != "UNDECIDABLE"), F.count_if((e != "UNDECIDABLE") & (o == "UNDECIDABLE"))
    return frame.groupBy(*(keys or [])).agg(
        n.alias("sample_count"), share(F.count_if(e == o), n).alias("accuracy"),
        share(F.count_if((e != "TRUE") & (o == "TRUE")), n).alias("false_allow_rate"),
        share(F.count_if((e == "TRUE") & (o == "FALSE")), n).alias("false_block_rate"),
        share(useful, open_cases).alias("useful_abstention_rate"),
        share(harmful, closed).alias("harmful_abstention_rate"))


def confusion(frame: DataFrame, left: str, right: str) -> DataFrame:
    return frame.groupBy(left, right).agg(F.count("*").alias("n"))


def pilot_metrics(reviews: DataFrame) -> DataFrame:
    """Per workflow: error rates, proof look-ups, audit time saved, set-up hours, usefulness."""
    e, o, n = F.col("expected_decision"), F.col("observed_decision"), F.count("*")
    before, after = F.avg("audit_minutes_before"), F.avg("audit_minutes_after")
    return reviews.groupBy("workflow").agg(
        n.alias("sample_count"),
        (F.count_if((e != "TRUE") & (o == "TRUE")) / n).alias("false_allow_rate"),
        (F.count_if((e == "TRUE") & (o == "FALSE")) / n).alias("false_block_rate"),
        share(F.count_if((e == "UNDECIDABLE") & (o == "UNDECIDABLE")), F.count_if(e == "UNDECIDABLE"))
        .alias("useful_abstention_rate"),
        (F.count_if("proof_lookup_ok") / n).alias("proof_lookup_success_rate"),
        before.alias("audit_minutes_before_avg"), after.alias("audit_minutes_after_avg"),
        share(before - after, before).alias("audit_time_delta_pct"),
        (F.sum("setup_minutes") / 60.0).alias("setup_hours"),
        F.avg("usefulness_score").alias("usefulness_avg"))


# ---------------------------------------------------------------------------- calibration

def reliability_bins(frame: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Count, mean probability and outcome rate per bin; the last bin includes 1."""
    p = F.col(probability)
    return (frame.filter((p >= 0) & (p <= 1))
            .withColumn("bin", F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int"))
            .groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_probability"),
                                F.avg(F.col(outcome).cast("double")).alias("outcome_rate")))


def expected_calibration_error(frame: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    per = reliability_bins(frame, probability, outcome, bins)
    gap = F.abs(F.col("outcome_rate") - F.col("mean_probability"))
    return per.agg(share(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def nonconformity(label: Column, confidence: Column, gold: Column) -> Column:
    """One minus the probability given to the gold class."""
    missed = F.greatest(F.lit(0.01), 1 - confidence) / 2
    return 1 - F.when(label == gold, confidence).otherwise(missed)


def conformal_quantile(scores: DataFrame, column: str, alpha: float = 0.1) -> DataFrame:
    """One row (n, position, q_hat): the finite-sample quantile as an exact order statistic."""
    n = scores.count()
    if n == 0:
        return scores.sparkSession.createDataFrame([(0, 0, 1.0)], "n bigint, position bigint, q_hat double")
    position = min(max(1, math.ceil((n + 1) * (1 - alpha))), n)
    found = order_statistic(scores, column, position)
    return found.select(F.lit(n).cast("bigint").alias("n"), F.lit(position).cast("bigint").alias("position"),
                        F.col(column).alias("q_hat"))


def conformal_coverage(frame: DataFrame) -> DataFrame:
    """Coverage and set size, overall (gold 'all') and per gold class. Needs ``gold``, ``set``."""
    hit = F.array_contains("set", F.col("gold")).cast("double")
    return (frame.rollup("gold").agg(F.count("*").alias("n"), F.avg(hit).alias("coverage"),
                                     F.avg(F.size("set")).alias("mean_set_size"))
            .withColumn("gold", F.coalesce("gold", F.lit("all"))))


# ---------------------------------------------------------------------------- agreement

def agreement(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Percent agreement and Cohen's kappa from the confusion counts of two annotators."""
    cells = cut_lineage(frame.groupBy(a, b).agg(F.count("*").alias("n")))  # one row per pair of labels
    left = cells.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("nb"))
    chance = (left.join(right, "label").agg(F.sum(F.col("na") * F.col("nb")).alias("product"))
              .withColumn("one", F.lit(1)))
    totals = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0))
                       .alias("agreed")).withColumn("one", F.lit(1))
    observed = F.col("agreed") / F.col("n")
    expected = F.coalesce("product", F.lit(0)) / (F.col("n") * F.col("n"))
    return totals.join(chance, "one").select(
        "n", "agreed", observed.alias("percent_agreement"),
        F.when(expected == 1, F.lit(1.0)).otherwise((observed - expected) / (1 - expected)).alias("kappa"))


def adjudicate(frame: DataFrame) -> DataFrame:
    """Final label: what both annotators say, else the adjudicator; with its source and change."""
    agreed = F.col("annotator_1") == F.col("annotator_2")
    final = F.when(agreed, F.col("annotator_1")).otherwise(F.col("adjudicated"))
    return (frame.withColumn("final_label", final)
            .withColumn("final_source", F.when(agreed, F.lit("agreement")).otherwise(F.lit("adjudication")))
            .withColumn("changed_from_seed", final != F.col("seed_label")))


def adjudication_summary(adjudicated: DataFrame) -> DataFrame:
    return adjudicated.groupBy("final_label").agg(
        F.count("*").alias("n"), F.count_if(F.col("final_source") == "adjudication").alias("adjudicated"),
        F.count_if("changed_from_seed").alias("changed"))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _two_sided(b: int, c: int) -> float:
    """Twice the lower binomial tail at one half; terms are added until they no longer matter."""
    n, k, total = b + c, min(b, c), 0.0
    if n == 0:
        return 1.0
    while k >= 0:
        term = math.exp(_log_choose(n, k) - n * math.log(2.0))
        total += term
        if term < total * 1e-18:
            break
        k -= 1
    return min(1.0, 2.0 * total)


def mcnemar(frame: DataFrame, a_correct: str, b_correct: str) -> DataFrame:
    """Discordant counts of two systems and the exact two-sided p value."""
    @F.pandas_udf("double")
    def exact(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([_two_sided(int(x), int(y)) for x, y in zip(b, c)])

    a, b = F.col(a_correct), F.col(b_correct)
    counts = frame.agg(F.count_if(a & b).alias("both_right"), F.count_if(a & ~b).alias("only_a"),
                       F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("both_wrong"))
    return counts.withColumn("p_value", exact("only_a", "only_b"))


# ---------------------------------------------------------------------------- cost and gates

def cost_sweep(runs: DataFrame, budget: float, steps: int = 100) -> DataFrame:
    """Cost and macro F1 at every threshold 0 .. 1 of the cheap path, and whether it fits the budget.

    ``runs`` has lex_label, lex_conf, heavy_label, gold_label and cost. A supported claim is cheap
    up to its confidence, so every run changes side at one grid point at most. Runs are counted by
    that point and their labels, and the curve is the cumulative sum over the grid.
    """
    contradicted = F.col("lex_label") == "contradicted"
    supported = F.col("lex_label") == "supported"
    last = F.when(contradicted, F.lit(steps)).when(
        supported, F.floor(F.round(F.col("lex_conf") * steps, 6))).otherwise(F.lit(-1)).cast("int")
    cells = (runs.withColumn("last_cheap", last)
             .groupBy("last_cheap", "lex_label", "heavy_label", "gold_label")
             .agg(F.count("*").alias("n"), F.sum("cost").alias("cost")))
    cells = cut_lineage(cells)  # at most steps x labels^3 rows, read for the scores and for the cost
    grid = cells.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    cheap = F.col("step") <= F.col("last_cheap")
    pred = F.when(cheap, F.col("lex_label")).otherwise(F.col("heavy_label"))
    grid = grid.withColumn("pred", pred).withColumn("spent", F.when(cheap, F.lit(0.0)).otherwise(F.col("cost")))
    labels = grid.select("step", "n", "spent", F.explode(F.array_distinct(F.array("pred", "gold_label"))).alias("label"),
                         "pred", "gold_label")
    per_label = labels.groupBy("step", "label").agg(
        F.sum(F.when((F.col("pred") == F.col("label")) & (F.col("gold_label") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("gold_label") == F.col("label"), F.col("n")).otherwise(0)).alias("true"))
    f1 = per_label.groupBy("step").agg(
        F.avg(share(2.0 * F.col("tp"), F.col("said") + F.col("true"))).alias("f1_score"))
    cost = grid.groupBy("step").agg(F.sum("spent").alias("cost_usd"))
    return f1.join(cost, "step").select(
        (F.col("step") / steps).alias("threshold"), F.round("cost_usd", 9).alias("cost_usd"),
        F.round("f1_score", 9).alias("f1_score"), (F.round("cost_usd", 9) <= budget).alias("feasible"))


def best_run(curve: DataFrame) -> DataFrame:
    """Best F1 within budget, then the cheapest; without any in budget, the cheapest of all."""
    row = F.struct("threshold", "cost_usd", "f1_score", "feasible")
    within = F.max_by(F.when(F.col("feasible"), row), F.when(F.col("feasible"), F.struct(
        "f1_score", (-F.col("cost_usd")).alias("c"), (-F.col("threshold")).alias("t"))))
    cheapest = F.min_by(row, F.struct("cost_usd", "threshold"))
    return curve.agg(F.coalesce(within, cheapest).alias("b")).select("b.*")


def quality_gate(scores: DataFrame, minimums: dict[str, float], maximums: dict[str, float] | None = None) -> DataFrame:
    """Means of the score columns and whether all of them keep their limits."""
    maximums = maximums or {}
    means = scores.agg(*[F.avg(c).alias(c) for c in {**minimums, **maximums}])
    passed = F.lit(True)
    for name, limit in minimums.items():
        passed = passed & (F.col(name) >= limit)
    for name, limit in maximums.items():
        passed = passed & (F.col(name) <= limit)
    return means.withColumn("passed", passed)


def roi(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Saved and spent dollars and the saved share of what all heavy calls would have cost."""
    saved, spent = F.sum("usd_saved"), F.sum("usd_spent")
    return costs.groupBy(*keys).agg(
        saved.alias("usd_saved"), spent.alias("usd_spent"),
        share(100.0 * saved, saved + spent).alias("roi_percent"))


def run_report(outputs: DataFrame) -> DataFrame:
    """Recorded model runs: raw and guarded accuracy, parse status, providers and run status."""
    judged = F.col("expected_decision").isNotNull()
    ok, valid, n = F.count_if("succeeded"), F.count_if(F.col("parse_status") == "valid"), F.count("*")
    right = (F.col("raw_decision") == F.col("expected_decision")).cast("double")
    guarded = (F.col("guarded_decision") == F.col("expected_decision")).cast("double")
    return outputs.agg(
        n.alias("cases"), F.coalesce(F.avg(F.when(judged, right)), F.lit(0.0)).alias("raw_accuracy"),
        F.coalesce(F.avg(F.when(judged, guarded)), F.lit(0.0)).alias("guarded_accuracy"),
        F.count_if(F.col("guarded_decision") != F.col("raw_decision")).alias("guardrail_applied"),
        valid.alias("valid_parses"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("succeeded"), F.col("provider")))), ",").alias("providers_used"),
        F.when((ok == n) & (valid == n), F.lit("completed")).when(ok == 0, F.lit("failed"))
        .otherwise(F.lit("partial")).alias("status"))


def reconcile(frame: DataFrame, column: str, declared: DataFrame) -> DataFrame:
    """Actual counts of ``column`` against a manifest of (value, declared)."""
    actual = frame.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("actual"))
    both = actual.join(declared, "value", "full_outer")
    a, d = F.coalesce("actual", F.lit(0)), F.coalesce("declared", F.lit(0))
    return both.select("value", a.alias("actual"), d.alias("declared"), (a == d).alias("matches"))
