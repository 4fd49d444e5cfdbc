"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.functions.session import cut_lineage
from trustframe.llm.characters import (
    WORDS_HELD,
    WordScores,
    kneser_ney,
    probability,
    word_grams,
    word_sums,
    words_of,
)
from trustframe.llm.common import text_slices

#: Runs of four classes of six bits: a language has at most 2**24 of them.
ORDER = 4


class Model:
    """Languages with their models, and the log-probabilities of every run of classes seen in any of them.

    Runs are 24-bit codes, so a language has at most 2**24 of them however large the corpus is.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.orders = [kneser_ney(*counts[lang], ORDER) for lang in self.langs]
        self.known = np.unique(np.concatenate([x[ORDER].codes for x in self.orders] or [np.zeros(0, np.uint64)]))
        self.logs = self._logs(self.known)
        self.scale, self.limits = 1.0, np.full(len(self.langs), np.inf)

    def _logs(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([np.log(probability(x, codes)) for x in self.orders], 1).astype(np.float32) \
            if self.orders else np.zeros((len(codes), 0), np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        codes, owner = word_grams(words, ORDER)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        found = self.known[at] == codes
        logs = self.logs[at]
        if not found.all():
            logs[~found] = self._logs(codes[~found])
        return word_sums(logs, owner, len(words))


def entropies(model: Model, scores: WordScores, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in nats per predicted class for each text and language, and the number of classes."""
    words = [lettered(text) for text in texts]
    rows = scores.rows(words)
    sizes = np.array([sum(map(len, x)) + len(x) for x in words], np.int64)
    total = np.stack([scores.matrix[x].sum(0, dtype=float) for x in rows]) if rows \
        else np.zeros((0, len(model.langs)))
    return -total / np.maximum(1, sizes)[:, None], sizes


def lettered(text: str | None) -> list[str]:
    """Words with at least one letter; number signs such as a half or a raised two are none."""
    return [w for w in words_of(text) if w.isalpha() or any(map(str.isalpha, w))]


def gram_counts(learned: DataFrame) -> DataFrame:
    """Counts of runs of four classes by language: lang, code, n. Tasks count words first, then their runs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                if not words:
                    continue
                codes, owner = word_grams(list(words), ORDER)
                weights = np.fromiter(words.values(), np.int64, len(words))[owner]
                kinds, inverse = np.unique(codes, return_inverse=True)
                sums = np.bincount(inverse, weights).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()),
                                                  pa.array(kinds.astype(np.int32)), pa.array(sums)],
                                                 names=["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(lettered(text))
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from flush()
        yield from flush()

    return learned.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(learned: DataFrame) -> Model:
    """Model of all given (lang, text). What reaches the driver is one row per language and code."""
    table = gram_counts(learned).toArrow()
    langs, codes, counts = (table[x].to_numpy() for x in ("lang", "code", "n"))
    parts = {}
    for lang in np.unique(langs.astype(str)) if len(langs) else ():
        own = langs == lang
        order = np.argsort(codes[own])
        parts[str(lang)] = codes[own][order].astype(np.uint64), counts[own][order]
    return Model(parts)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Adds entropy array<double> by language, letters long, to (any columns, text); text is dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]
    kind = docs.select(rest).schema.add("entropy", T.ArrayType(T.DoubleType())).add("letters", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(shared.value.words, len(shared.value.langs))
        for batch in batches:
            parts = [entropies(shared.value, scores, batch["text"].slice(a, b - a).to_pylist())
                     for a, b in text_slices(batch["text"], 2 << 20)]
            values = np.concatenate([x[0] for x in parts]) if parts else np.zeros((0, 0))
            sizes = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(list(values), pa.list_(pa.float64())),
                                              pa.array(sizes)], names=[*rest, "entropy", "letters"])

    return docs.mapInArrow(run, kind)


SCALES = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)

#: Ranks that the first bound of a limit may be off, as a share, and texts of a language that do without a bound.
OFF, UNBOUND = 1e-5, 1_000_000


def calibrate(model: Model, learned: DataFrame, kept: float) -> None:
    """Sets the scale of the scores and the rejection limits from all learned rows: lang, entropy, letters.

    The scale makes the known languages likeliest; a text is rejected when it fits its language worse than all but
    1 - ``kept`` of that language's own texts. Only the few entropies beyond a bound are sorted for that.
    """
    place = F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")).cast("int")
    rows = learned.where("letters > 0").withColumn("place", place).where("place > 0").select(
        "lang", "entropy", F.element_at("entropy", F.col("place")).alias("own"))
    least = F.array_min("entropy")

    def loss(scale: float) -> Column:
        parts = F.aggregate("entropy", F.lit(0.0), lambda s, x: s + F.exp(scale * (least - x)))
        return F.avg(F.log(parts) + scale * (F.col("own") - least))

    losses = rows.agg(*[loss(x) for x in SCALES]).first()
    if losses[0] is None:
        return
    model.scale = SCALES[int(np.argmin(list(losses)))]
    bounds = rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.percentile_approx("own", max(0.0, kept - 2 * OFF), int(1 / OFF)).alias("bound"))
    beyond = (F.col("n") <= UNBOUND) | (F.col("own") >= F.col("bound"))
    # ranks are counted from the top; the limit lies between two of them
    place = (F.col("n") - 1) * F.lit(kept)
    tail = rows.join(bounds, "lang").where(beyond).withColumn("at", F.col("n") - F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("own"))))
    ends = tail.where((F.col("at") == F.floor(place)) | (F.col("at") == F.ceil(place)))
    found = ends.groupBy("lang").agg(F.min("own").alias("low"), F.max("own").alias("high"),
                                     F.first(place - F.floor(place)).alias("part")).collect()
    for x in found:
        model.limits[model.langs.index(x["lang"])] = x["low"] + (x["high"] - x["low"]) * x["part"]


def _hash(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def identify(docs: DataFrame, fold: int = 3, held: int = 1, kept: float = 0.999) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of ``docs``.

    Models are learned from all texts with a language whose crc32(doc_id) mod ``fold`` isn't ``held``; a null doc_id
    isn't held out. The language with the lowest cross-entropy per class wins, the first in order on a tie. Texts
    that are null or without a letter give ``und`` with score 0, and so do all texts if there is nothing to learn
    from. The score is the winner's share after calibration on all learned documents; ``rejected`` marks texts that fit
    even their best language badly. Repeated rows give repeated results.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"),
                       F.coalesce(F.pmod(_hash(), F.lit(fold)) == held, F.lit(False)).alias("held_out"))
    learned = base.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL")
    model = train(learned.select("lang", "text"))
    if model.langs:
        # scored once, for the calibration and for the results
        found = cut_lineage(scored(base, model))
        calibrate(model, found.where("NOT held_out AND lang IS NOT NULL"), kept)
    else:
        found = base.select("doc_id", "held_out", F.array().cast("array<double>").alias("entropy"),
                            F.lit(0).cast("long").alias("letters"))
    best = F.array_min("entropy")
    place = F.array_position("entropy", best).cast("int")
    some = (F.col("letters") > 0) & (F.size("entropy") > 0)
    share = 1 / F.aggregate("entropy", F.lit(0.0), lambda s, x: s + F.exp(F.lit(model.scale) * (best - x)))
    return found.select(
        "doc_id", "held_out",
        F.when(some, F.element_at(F.array(*map(F.lit, model.langs or ["und"])), place)).otherwise("und")
        .alias("lang_pred"),
        F.when(some, share).otherwise(0.0).alias("score"),
        F.when(some, best > F.element_at(F.array(*[F.lit(float(x)) for x in model.limits] or [F.lit(0.0)]), place))
        .otherwise(True).alias("rejected"))
