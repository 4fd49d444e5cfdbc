"""Three-valued states: probability triples, their algebra and decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustframe.functions import fixed


def state(p_true: Column, p_false: Column, p_und: Column) -> Column:
    """Normalised triple; all zero means UNDECIDABLE."""
    total = p_true + p_false + p_und
    return F.when(total > 0, F.struct((p_true / total).alias("p_true"), (p_false / total).alias("p_false"),
                                      (p_und / total).alias("p_und"))
                  ).otherwise(F.struct(F.lit(0.0).alias("p_true"), F.lit(0.0).alias("p_false"),
                                       F.lit(1.0).alias("p_und")))


def from_bool(value: Column, confidence: Column) -> Column:
    rest = 1 - confidence
    return state(F.when(value, confidence).otherwise(rest),
                 F.when(value, rest).otherwise(confidence), F.lit(0.0))


def undecidable(true_lean: Column) -> Column:
    return state(true_lean * 0.4, (1 - true_lean) * 0.4, F.lit(0.6))


def from_word(word: Column) -> Column:
    """TRUE, FALSE or UNDECIDABLE as a certain state."""
    return state((word == "TRUE").cast("double"), (word == "FALSE").cast("double"),
                 (word == "UNDECIDABLE").cast("double"))


def negate(s: Column) -> Column:
    return state(s["p_false"], s["p_true"], s["p_und"])


def conjoin(a: Column, b: Column) -> Column:
    p_true = a["p_true"] * b["p_true"]
    p_false = a["p_false"] + b["p_false"] - a["p_false"] * b["p_false"]
    return state(p_true, p_false, F.greatest(F.lit(0.0), 1 - p_true - p_false))


def disjoin(a: Column, b: Column) -> Column:
    p_true = a["p_true"] + b["p_true"] - a["p_true"] * b["p_true"]
    p_false = a["p_false"] * b["p_false"]
    return state(p_true, p_false, F.greatest(F.lit(0.0), 1 - p_true - p_false))


def implies(a: Column, b: Column) -> Column:
    return disjoin(negate(a), b)


def conjoin_all(s: Column) -> Column:
    """Aggregate: AND over a group, in closed form."""
    p_true = F.product(s["p_true"])
    p_false = 1 - F.product(1 - s["p_false"])
    return state(p_true, p_false, F.greatest(F.lit(0.0), 1 - p_true - p_false))


def disjoin_all(s: Column) -> Column:
    """Aggregate: OR over a group, in closed form."""
    p_true = 1 - F.product(1 - s["p_true"])
    p_false = F.product(s["p_false"])
    return state(p_true, p_false, F.greatest(F.lit(0.0), 1 - p_true - p_false))


def weaken(s: Column, confidence: Column) -> Column:
    """Scale a conclusion by its rule's confidence; the lost part goes to the other values."""
    p_true = s["p_true"] * confidence
    rest, other = 1 - p_true, s["p_false"] + s["p_und"]
    p_false = F.when(other > 0, s["p_false"] * rest / other).otherwise(rest / 2)
    return F.when(confidence >= 1, s).otherwise(state(p_true, p_false, 1 - p_true - p_false))


def collapse(s: Column) -> Column:
    """Most likely value; ties go to TRUE, then FALSE."""
    return (F.when((s["p_true"] >= s["p_false"]) & (s["p_true"] >= s["p_und"]), F.lit("TRUE"))
            .when(s["p_false"] >= s["p_und"], F.lit("FALSE")).otherwise(F.lit("UNDECIDABLE")))


def decide(s: Column, true_at: float = 0.6, false_at: float = 0.6, margin: float = 0.05) -> Column:
    """Value that reaches its threshold and leads the others by the margin."""
    def wins(p, others, at):
        return (p >= at) & (p - F.greatest(*others) >= margin)

    return (F.when(wins(s["p_true"], [s["p_false"], s["p_und"]], true_at), F.lit("TRUE"))
            .when(wins(s["p_false"], [s["p_true"], s["p_und"]], false_at), F.lit("FALSE"))
            .otherwise(F.lit("UNDECIDABLE")))


def decide_probability(p: Column, threshold: float = 0.7) -> Column:
    return (F.when(p >= threshold, F.lit("TRUE")).when(p <= 1 - threshold, F.lit("FALSE"))
            .otherwise(F.lit("UNDECIDABLE")))


def _label_part(label: Column, part: int) -> Column:
    pairs = [F.lit(x) for row in fixed.LABEL_DECISIONS for x in (row[0], row[part])]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(label)))


def label_decision(label: Column) -> Column:
    return _label_part(label, 1)


def label_action(label: Column) -> Column:
    return _label_part(label, 2)


def label_status(label: Column) -> Column:
    return _label_part(label, 3)


def decision_label(decision: Column) -> Column:
    return (F.when(decision == "TRUE", F.lit("supported")).when(decision == "FALSE", F.lit("contradicted"))
            .when(decision == "UNDECIDABLE", F.lit("unsupported")))


def confidence_score(word: Column) -> Column:
    pairs = [F.lit(x) for row in fixed.CONFIDENCE_SCORES for x in row]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(word)), F.lit(0.0))


def search_verdict(score: Column) -> Column:
    """Ladder from the best evidence score to (supported, confidence, status)."""
    def rung(supported: bool, confidence: Column, status: str) -> Column:
        return F.struct(F.lit(supported).alias("supported"), confidence.alias("confidence"),
                        F.lit(status).alias("status"))

    return (F.when(score.isNull(), rung(False, F.lit(0.0), "uncertain"))
            .when(score >= 0.85, rung(True, score, "verified"))
            .when(score >= 0.6, rung(True, score * 0.9, "verified"))
            .when(score >= 0.4, rung(False, F.lit(0.5), "uncertain"))
            .otherwise(rung(False, 1 - score, "contradicted")))


def local_verdict(score: Column) -> Column:
    best = F.coalesce(score, F.lit(0.0))
    return F.struct((best >= 0.5).alias("supported"), best.alias("confidence"),
                    F.when(best >= 0.5, F.lit("verified")).otherwise(F.lit("uncertain")).alias("status"))
