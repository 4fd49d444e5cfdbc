"""Toxicity scores from class-conditional Kneser-Ney models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from trustframe.llm.characters import (
    BITS,
    WORDS_HELD,
    WORDS_SCORED,
    WordScores,
    kneser_ney,
    probability,
    word_grams,
    word_sums,
    words_of,
)
from trustframe.llm.common import Bitmap, release, released, slices, stored, text_slices

#: Runs of so many classes are counted; those of up to SHARED are shared by both class models.
ORDER, SHARED = 5, 2
FEATURES = ("toxic_part", "ordinary_part", "passage")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic and text of the documents with a label of 0 or 1.

    Most other texts are dropped before the shuffle; the join is exact.
    """
    given = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key")) \
        .agg(F.max("toxic").cast("int").alias("toxic"))

    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    sifted = Bitmap(given.select("key")).rows(texts, "doc_id")
    return sifted.join(given, F.col("doc_id") == F.col("key")).select("doc_id", "toxic", "text")


def gram_counts(texts: DataFrame) -> DataFrame:
    """Occurrences in toxic and in ordinary texts of each run of classes: code, t, o. Tasks count words first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            every = list(held[0] | held[1])
            for at in range(0, len(every), 4 * WORDS_SCORED):
                words = every[at:at + 4 * WORDS_SCORED]
                codes, owner = word_grams(words, ORDER)
                kinds, inverse = np.unique(codes, return_inverse=True)
                sums = [np.bincount(inverse, np.array([own[word] for word in words])[owner]).astype(np.int64)
                        for own in held]
                yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(sums[1]),
                                                  pa.array(sums[0])], names=["code", "t", "o"])
            for own in held:
                own.clear()

        for batch in released(batches):
            for a, b in text_slices(batch["text"], 1 << 19):
                for text, toxic in zip(*(batch[c].slice(a, b - a).to_pylist() for c in ("text", "toxic")), strict=True):
                    held[toxic].update(words_of(text))
                if len(held[0]) + len(held[1]) > WORDS_HELD:
                    yield from flush()
        yield from flush()
        release()

    counts = texts.select("toxic", "text").mapInArrow(count, "code long, t long, o long")
    return counts.groupBy("code").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o"))


class Ratios:
    """Log ratio of toxic to ordinary probability of runs of classes, in sorted arrays of codes; 0 for all other runs."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        self.codes, self.logs = codes, logs

    def words(self, words: list[str]) -> np.ndarray:
        codes, owner = word_grams(words, ORDER)
        logs = np.zeros(len(codes), np.float32)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            logs = np.where(self.codes[at] == codes, self.logs[at], np.float32(0))
        return word_sums(logs[:, None], owner, len(words))


class Model:
    """All runs with a ratio (code, log), broadcast in parts by ranges of codes of about ``entries`` runs.

    Ranges are joined from 2^12 spans of 2^18 codes each, so with the given ``entries`` no part is larger. A model of one part
    is broadcast once.
    """

    def __init__(self, runs: DataFrame, entries: int):
        self.runs, self.shared, self.ranges = runs, None, []
        spans = runs.groupBy(F.shiftright("code", 18).alias("span")).count().orderBy("span").collect()
        for begin, end in slices((x["count"] for x in spans), entries):
            held = spans[begin:end]
            if held:
                self.ranges.append((held[0]["span"] << 18, held[-1]["span"] + 1 << 18))

    def part(self, k: int) -> Broadcast:
        if self.shared is None or len(self.ranges) > 1:
            low, high = self.ranges[k] if self.ranges else (0, 0)
            found = self.runs.where((F.col("code") >= low) & (F.col("code") < high)).toArrow()
            codes, logs = (found[x].to_numpy() for x in ("code", "log"))
            order = np.argsort(codes)
            self.shared = self.runs.sparkSession.sparkContext.broadcast(
                Ratios(codes[order].astype(np.uint64), logs[order]))
        return self.shared


def _suffix(n: int) -> Column:
    return F.col("code").bitwiseAND(F.lit((1 << BITS * n) - 1))


def _discounts(level: DataFrame) -> tuple[Row, dict[str, float]]:
    """Sums of both counts, and the Kneser-Ney discounts of both."""
    row = level.agg(*[F.sum(x).alias(x) for x in "to"],
                    *[F.count_if(F.col(x) == n).alias(f"{x}{n}") for x in "to" for n in (1, 2)]).first()
    return row, {x: min(0.9, max(0.1, row[f"{x}1"] / max(1, row[f"{x}1"] + 2 * row[f"{x}2"]))) for x in "to"}


def _in_context(level: DataFrame) -> DataFrame:
    """Adds sums and kinds of both counts in the context of each run, which has at most 2^BITS runs."""
    context = Window.partitionBy(F.shiftrightunsigned("code", BITS))
    return level.withColumns({f"all_{x}": F.sum(x).over(context) for x in "to"} | {
        f"kinds_{x}": F.sum((F.col(x) > 0).cast("long")).over(context) for x in "to"})


def _interpolated(level: DataFrame, discounts: dict[str, float], below: DataFrame, n: int) -> DataFrame:
    """code, p_t, p_o: probabilities of order n from a level with its contexts and from those of order n - 1."""
    def value(x: str) -> Column:
        count, total, d = F.col(x), F.col(f"all_{x}"), discounts[x]
        seen = F.when(count > 0, (count - d) / total).otherwise(0.0)
        weight = F.when(total > 0, d * F.col(f"kinds_{x}") / total).otherwise(1.0)
        return (seen + weight * F.col(f"below_{x}")).alias(f"p_{x}")

    lower = below.toDF("suffix", "below_t", "below_o")
    return level.join(lower, _suffix(n - 1) == F.col("suffix")).select("code", *map(value, "to"))


def train(texts: DataFrame, least: float = 4.0, entries: int = 1 << 22) -> Model | None:
    """Log ratios from all runs of all given (toxic, text); None without both classes.

    Runs longer than SHARED are counted by class, shorter ones over both. A run whose classes differ by less than
    ``least`` standard deviations from what is usual in its context backs off to what both share, so its ratio is 1
    and it isn't kept; so does a run that was never seen. Counts, discounts and contexts of all orders above SHARED
    are tables, so nothing is left out at any size; ``entries`` only says how many ratios are broadcast at a time.
    """
    levels = {ORDER: stored(gram_counts(texts), "runs")}
    sums, discounts = _discounts(levels[ORDER])
    if not sums["t"] or not sums["o"]:
        return None
    discounts = {ORDER: discounts}
    for n in range(ORDER - 1, SHARED, -1):  # a class is counted by the different contexts it follows
        levels[n] = stored(levels[n + 1].groupBy(_suffix(n).alias("code")).agg(
            *[F.count_if(F.col(x) > 0).alias(x) for x in "to"]), "runs")
        discounts[n] = _discounts(levels[n])[1]
    shared = levels[SHARED + 1].groupBy(_suffix(SHARED).alias("code")).count().orderBy("code").toArrow()
    codes = shared["code"].to_numpy().astype(np.uint64)  # at most 2^12
    both = probability(kneser_ney(codes, shared["count"].to_numpy(), SHARED), codes).tolist()
    values = texts.sparkSession.createDataFrame([(int(c), p, p) for c, p in zip(codes, both, strict=True)],
                                                "code long, p_t double, p_o double")
    for n in range(SHARED + 1, ORDER):
        values = _interpolated(_in_context(levels[n]), discounts[n], values, n)
    n, prior = F.col("t") + F.col("o"), sums["t"] / (sums["t"] + sums["o"])
    usual = (F.col("all_t") + prior / 2) / (F.col("all_t") + F.col("all_o") + 0.5)
    differs = F.abs(F.col("t") - n * usual) >= least * F.sqrt(n * usual * (1 - usual))
    kept = _interpolated(_in_context(levels[ORDER]).where(differs), discounts[ORDER], values, ORDER)
    return Model(stored(kept.select("code", (F.log("p_t") - F.log("p_o")).cast("float").alias("log")), "ratios"), entries)


def _word_logs(shared: Broadcast) -> Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]:
    """For a batch with texts: each row's number and the log ratios of its words, if it has any, from one part of a
    model and from the parts before it, which stand in ``word_logs``."""
    scores = WordScores(shared.value.words, 1)

    def logs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        before = batch["word_logs"] if "word_logs" in batch.schema.names else None
        for a, b in text_slices(batch["text"], 1 << 19):
            texts = batch["text"].slice(a, b - a).to_pylist()
            for k, rows in enumerate(scores.rows([words_of(x) for x in texts]), a):
                if len(rows):
                    own = scores.matrix[rows, 0]
                    yield k, own if before is None else own + before[k].values.to_numpy()

    return logs


def _add_part(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Adds one part of a model to ``word_logs``."""
    rest = [c for c in docs.columns if c != "word_logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = _word_logs(shared)
        for batch in released(batches):
            sizes, values = np.zeros(len(batch), np.int32), [np.zeros(0, np.float32)]
            for k, found in logs(batch):
                sizes[k] = len(found)
                values.append(found)
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), held], names=[*rest, "word_logs"])

    return docs.mapInArrow(run, docs.select(rest).schema.add("word_logs", ArrayType(FloatType())))


def features(docs: DataFrame, model: Model | None, window: int) -> DataFrame:
    """Adds length-normalised log ratios: ``toxic_part`` and ``ordinary_part``, the means per word of the ratios above and
    below 0, and ``passage``, the mean of those above 0 in the window where it is largest.

    A model of several parts is looked up part by part, and what is found for the words is written in between, so that
    a task holds one part at a time.
    """
    rest = docs.columns
    schema = docs.select(rest).schema
    for k in range(len(model.ranges) - 1 if model is not None else 0):
        shared = model.part(k)
        docs = stored(_add_part(docs, shared), "word-logs")
        shared.destroy()
    shared = model.part(-1) if model is not None else None

    def measure(values: np.ndarray) -> tuple[float, float, float]:
        above = np.concatenate([[0.0], np.cumsum(np.maximum(values, 0), dtype=float)])
        width = min(window, len(values))
        return (above[-1] / len(values), float(np.minimum(values, 0).mean()),
                (above[width:] - above[:-width]).max() / width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = _word_logs(shared) if shared is not None else None
        for batch in released(batches):
            out = np.zeros((len(batch), len(FEATURES)))
            for k, found in logs(batch) if logs is not None else ():
                out[k] = measure(found)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), *map(pa.array, out.T.copy())],
                                             names=[*rest, *FEATURES])

    for name in FEATURES:
        schema = schema.add(name, "double")
    return docs.mapInArrow(run, schema)


def _inputs() -> list[Column]:
    return [F.log(F.col("toxic_part") + 0.01), F.log(F.col("passage") + 0.01), -F.col("ordinary_part")]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept of a logistic regression, by Newton steps over standardised columns."""
    middle, width = x.mean(0), x.std(0) + 1e-9
    x = np.column_stack([(x - middle) / width, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - y) + ridge * weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), gradient)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(weights[:-1] / width, weights[-1] - (weights[:-1] * middle / width).sum())


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic weights and intercept where more of a toxic ratio (the first two inputs) never lowers the score."""
    used = list(range(x.shape[1]))
    while True:
        *weights, start = _logistic(x[:, used], y).tolist()
        wrong = min((w, k) for w, k in zip([*weights, 0.0], [*used, -1], strict=True) if k < 2)
        if wrong[0] >= 0:
            found = dict(zip(used, weights, strict=True))
            return [*(found.get(k, 0.0) for k in range(x.shape[1])), start]
        used.remove(wrong[1])


def score(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, window: int = 16, sample: int = 20_000,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, the log ratios behind the score, and the columns
    named in ``carry``.

    Learned are all documents with a label whose crc32(doc_id) mod ``fold`` isn't ``held``: three quarters give the
    models of the letters of words for both classes; of the last quarter at most ``sample`` documents, chosen by a
    hash, turn the length-normalised log-likelihood ratios into a score by a logistic regression. The ratio of the
    most toxic ``window`` words is one of them, so a passage counts in a long text too. Null and empty texts have
    ratios of 0. If a class has no learned text, all scores are 0. A document with several labels counts as toxic if
    one says so. Repeated rows give repeated results; a null doc_id is not held out and not learned from.
    """
    def remainder() -> Column:
        return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.pmod(remainder(), F.lit(fold)) == held, F.lit(False)).alias("held_out"),
                       F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry if c != "text"]).alias("carried"))
    learned = labels.select("doc_id", "toxic").where("toxic IN (0, 1)").where(F.pmod(remainder(), F.lit(fold)) != held)
    tuning = F.pmod(F.floor(remainder() / fold), F.lit(4)) == 0
    model = train(labelled(base, learned.where(~tuning)))
    probability = F.lit(0.0)
    for chosen in (learned.where(tuning), learned):  # all learned documents, if the last quarter has one class only
        known = features(labelled(base, chosen), model, window).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        fit = known.select(*[c.alias(f"x{k}") for k, c in enumerate(_inputs())], "toxic").toArrow()
        y = fit["toxic"].to_numpy().astype(float)
        if len(np.unique(y)) == 2:
            *weights, start = _fit(np.column_stack([fit[f"x{k}"].to_numpy() for k in range(len(_inputs()))]), y)
            total = F.lit(start)
            for weight, column in zip(weights, _inputs(), strict=True):
                total = total + F.lit(weight) * column
            probability = 1 / (1 + F.exp(-total))
            break
    return features(base, model, window).select(
        "doc_id", "held_out", probability.alias("score"), (probability >= 0.5).cast("int").alias("predicted"), *FEATURES,
        *[F.col(c) if c == "text" else F.col("carried")[c].alias(c) for c in carry])
