"""Document fingerprints by a randomised embedding of edit distance into Hamming distance."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.llm.common import mix, stored

#: Bits of a fingerprint, and of the character classes and steps that the shared walk is drawn for.
BITS = 256
CLASSES, PERIOD = 256, 4096
#: Code points walked at a time, or one text if it is longer.
BATCH = 2 << 20
PRINTED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


@functools.cache
def _pauses() -> np.ndarray:
    """How many steps the walk stays at a character of each class that it reaches at each step of the period.

    At every step a coin of that class and step, the same for all texts, decides whether the walk goes on to the
    next character.
    """
    coins = np.random.default_rng(4).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    coins[:, -1] = 1
    ahead = np.where(coins == 1, np.arange(PERIOD), PERIOD)
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1]
    return (ahead - np.arange(PERIOD) + 1).astype(np.uint16).ravel()


@functools.cache
def _records(bit: int) -> np.ndarray:
    """Steps whose random number is smaller than those of all steps before them, drawn from record to record: the
    sampled step of a walk of n steps is the last of these below n. Two walks thus mostly sample the same step, also
    if they differ in length."""
    draw = np.random.default_rng([4, bit])
    steps, least = [0], draw.random()
    while steps[-1] < 1 << 31:
        steps.append(steps[-1] + 1 + int(np.log(draw.random()) / np.log1p(-least)))
        least *= draw.random()
    return np.array(steps)


@functools.cache
def _pause_list() -> list[int]:
    return _pauses().tolist()


#: With fewer texts left a walk goes on text by text, where a step costs less than an array operation.
FEW = 48


def walk(classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steps: np.ndarray | None = None) -> np.ndarray:
    """The step at which the walk of each text reaches each of its characters, and for each text the step after its
    last (texts are stored one after another with one free slot behind each). ``steps`` are where the walks begin."""
    pauses, reached = _pauses(), np.zeros(len(classes), np.int32)
    order = np.argsort(-sizes, kind="stable")
    at, length = starts[order], sizes[order]
    step = np.zeros(len(order), np.int64) if steps is None else steps[order].astype(np.int64)
    alive, done = len(order), 0
    while True:
        while alive and length[alive - 1] <= done:
            alive -= 1
        if alive <= FEW:
            break
        here, now = at[:alive] + done, step[:alive]
        reached[here] = now
        now += pauses[classes[here] * np.int64(PERIOD) + (now & (PERIOD - 1))]
        done += 1
    lookup, mask = _pause_list(), PERIOD - 1
    for row in range(alive):
        now, line = int(step[row]), []
        for base in (classes[at[row] + done:at[row] + length[row]] * np.int64(PERIOD)).tolist():
            line.append(now)
            now += lookup[base + (now & mask)]
        reached[at[row] + done:at[row] + length[row]] = line
        step[row] = now
    reached[at + length] = step
    return reached


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """All records one bit after another, each list padded with its last step, for a search over all bits at once."""
    lists = [_records(bit) for bit in range(BITS)]
    width = max(map(len, lists))
    padded = np.stack([np.append(x, np.full(width - len(x), np.iinfo(np.int64).max)) for x in lists])
    return padded, np.arange(BITS)


def _sampled(total: int) -> np.ndarray:
    padded, rows = _tables()
    return padded[rows, (padded < total).sum(1) - 1]


def bits_of(points: np.ndarray, reached: np.ndarray) -> np.ndarray:
    """The fingerprint of one text as BITS truth values: a bit of the hash of the sampled step and of the four
    characters at which the walk stands then; all 0 for an empty text."""
    n = len(points)
    if not n:
        return np.zeros(BITS, bool)
    steps = _sampled(int(reached[n]))
    place = np.searchsorted(reached[:n], steps.astype(np.int32), "right") - 1
    padded = np.append(points.astype(np.uint64), np.zeros(3, np.uint64))
    gram = padded[place] | padded[place + 1] << np.uint64(21) | padded[place + 2] << np.uint64(42)
    gram = mix(gram) ^ padded[place + 3] ^ (steps.astype(np.uint64) << np.uint64(24))
    return (mix(gram + np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(bool)


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points and classes of the texts with one free slot behind each, where each begins, and its length."""
    sizes = np.array([len(x) for x in texts], np.int64)
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, (points * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8), np.cumsum(sizes + 1) - sizes - 1, sizes


def fingerprints(texts: list[str], tails: list[str] | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the texts, one row of truth values each.

    With ``tails`` also those of the texts whose last characters are replaced: the last quarter goes and the tail
    comes. Their walks go on from where the quarter begins.
    """
    points, classes, starts, sizes = _laid_out(texts)
    reached = walk(classes, starts, sizes)
    own = np.zeros((len(texts), BITS), bool)
    for row, (a, n) in enumerate(zip(starts, sizes, strict=True)):
        own[row] = bits_of(points[a:a + n], reached[a:a + n + 1])
    if tails is None:
        return own
    kept = sizes - sizes // 4
    more, more_classes, begins, lengths = _laid_out(tails)
    after = walk(more_classes, begins, lengths, reached[starts + kept])
    changed = np.zeros((len(texts), BITS), bool)
    for row, (a, k, b, n) in enumerate(zip(starts, kept, begins, lengths, strict=True)):
        changed[row] = bits_of(np.concatenate([points[a:a + k], more[b:b + n]]),
                               np.concatenate([reached[a:a + k], after[b:b + n + 1]]))
    return own, changed


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, about 0 for unrelated ones, of which half of the bits agree by chance."""
    return np.maximum(0.0, 2 * (a == b).mean(-1) - 1)


def _hex(bits: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in np.packbits(bits, axis=1)]


def _follow(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, bool, int | None]]:
    for batch in rows:
        yield from zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["halo"].to_pylist(),
                       batch["range"].to_pylist(), strict=True)


def _compare(group: list[tuple[int | None, str]], after: str) -> pa.RecordBatch:
    ids, texts = [x[0] for x in group], [x[1] for x in group]
    following = [*texts[1:], after]
    tails = [y[:len(x) // 4] for x, y in zip(texts, following, strict=True)]
    edited = [x[:len(x) - len(x) // 4] + y for x, y in zip(texts, tails, strict=True)]
    own, changed = fingerprints([*texts, after], [*tails, after[:len(after) // 4]])
    changed = changed[:-1]
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()),
        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]),
        pa.array(_hex(own[:-1])), pa.array(_hex(changed)), pa.array(likeness(own[:-1], changed)),
        pa.array(likeness(own[:-1], own[1:]))], names=[x.split()[0] for x in PRINTED.split(", ")])


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows in order of doc_id within ranges of it, each range followed by the first row of the next one.

    Bounds of the ranges come from a summary of the ids. The first text after a range is found by its id, so only
    one text per range is sent twice.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("double").alias("x"))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = sorted({int(x) for x in known.approxQuantile("x", shares, 0.2 / ranges)}) if shares else []
    ranged = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_place(bounds)))
    firsts = sorted((x["range"], x["doc_id"]) for x in ranged.groupBy("range").agg(
        F.min("doc_id").alias("doc_id")).collect())
    if not firsts:
        return ranged.withColumn("halo", F.lit(False))
    heads = docs.sparkSession.createDataFrame(
        [(*first, firsts[k - 1][0]) for k, first in enumerate(firsts)], "head int, first long, goes_to int")
    # one row per range, so never more than a few thousand
    halo = ranged.join(F.broadcast(heads), (F.col("range") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("first"))) \
        .groupBy("range", "doc_id", "goes_to").agg(F.min("text").alias("text")).select(
            "doc_id", "text", F.col("goes_to").alias("range"), F.lit(True).alias("halo"))
    return ranged.withColumn("halo", F.lit(False)).unionByName(halo)


def _place(bounds: list[int], width: int = 64) -> Column:
    """How many of the sorted bounds a doc_id reaches, found by blocks of them and then within one."""
    if not bounds:
        return F.lit(0)
    blocks = [bounds[k:k + width] for k in range(0, len(bounds), width)]

    def reached(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= F.col("doc_id")))

    block = reached(F.array(*[F.lit(x[0]).cast("long") for x in blocks]))
    inside = F.array(*[F.array(*[F.lit(y).cast("long") for y in x]) for x in blocks])
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + reached(F.element_at(inside, block)))


def fingerprint(docs: DataFrame, rows_per_range: int = 8000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The next document is that with the next larger doc_id, after the last the first; rows that repeat a doc_id follow
    each other in order of their texts, and rows without one stand before all others. A single document is its own
    next. A null text counts as empty; empty texts have the fingerprint of zeros. Equal texts have equal fingerprints.
    """
    rows = docs.count()
    ranges = max(1, min(4096, -(-rows // rows_per_range)))
    dealt = with_next(docs, ranges).repartition(ranges, "range").sortWithinPartitions("range", "halo", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, current = 0, None
        for doc_id, text, halo, range_ in _follow(batches):
            if held and (halo or range_ != current or size > BATCH):
                yield _compare(held, text)
                held, size = [], 0
            if not halo:
                held.append((doc_id, text))
                size += len(text)
            current = range_
        if held:
            yield _compare(held, "")

    return dealt.mapInArrow(run, PRINTED)


def members(texts: DataFrame) -> DataFrame:
    """doc_id, stands: for each row the least doc_id with the same text, by a hash of the whole text; null counts as empty."""
    keyed = texts.select("doc_id", _text_key().alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("doc_id").alias("stands")), "key").select("doc_id", "stands")


def _text_key() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def similar_pairs(printed: DataFrame, texts: DataFrame, bands: int = 40, band_bits: int = 12, least: float = 0.3,
                  distance: int = 200, seed: int = 9) -> DataFrame:
    """Pairs of different texts (a, b, distance) with an edit distance of at most ``distance``.

    Bit-sampled banding: each of ``bands`` bands takes ``band_bits`` random bits; texts that agree in a band and whose
    whole fingerprints have a likeness of at least ``least`` are verified by their edit distance, and so are all
    different texts of one fingerprint. Of each text the least doc_id stands for all its copies, see ``members``; a and b
    are equal if one doc_id has both texts. A band shared by many is compared in full, in a join that can be split. A
    pair is missed if it agrees in no band or is less like, mostly because one walk did not meet the other again.
    """
    draw = np.random.default_rng(seed)
    byte = [F.conv(F.substring("fingerprint", 2 * k + 1, 2), 16, 10).cast("int") for k in range(BITS // 8)]
    named = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _text_key().alias("key"))
    held = stored(printed.select("doc_id", "fingerprint").distinct().join(named.select("doc_id", "key"), "doc_id").select(
        "fingerprint", "key").distinct(), "keys")
    ones = held.select("fingerprint").distinct().withColumn("bytes", F.array(*byte))

    def bit(at: int) -> Column:
        return F.shiftright(F.element_at("bytes", at // 8 + 1), 7 - at % 8).bitwiseAND(F.lit(1)).cast("string")

    keys = F.array(*[F.concat(F.lit(f"{k}:"), *[bit(int(x)) for x in draw.choice(BITS, band_bits, replace=False)])
                     for k in range(bands)])
    banded = stored(ones.select("fingerprint", "bytes", F.explode(keys).alias("band")), "bands")
    pairs = banded.toDF("f", "bytes_f", "band").join(banded.toDF("g", "bytes_g", "band"), "band").where("f < g")
    differing = F.aggregate(F.zip_with("bytes_f", "bytes_g", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                            lambda s, x: s + x)
    close = pairs.where(1 - 2 * differing / BITS >= least).select("f", "g").distinct()
    met = close.join(held.toDF("f", "key_f"), "f").join(held.toDF("g", "key_g"), "g").select("key_f", "key_g").unionByName(
        held.toDF("f", "key_f").join(held.toDF("f", "key_g"), "f").select("key_f", "key_g"))
    ordered = met.where("key_f != key_g").select(F.least("key_f", "key_g").alias("key_f"),
                                                 F.greatest("key_f", "key_g").alias("key_g")).distinct()
    one = named.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    both = ordered.join(one.toDF("key_f", "id_f", "text_f"), "key_f").join(one.toDF("key_g", "id_g", "text_g"), "key_g")
    return both.withColumn("distance", F.levenshtein("text_f", "text_g", distance)).where("distance >= 0").select(
        F.least("id_f", "id_g").alias("a"), F.greatest("id_f", "id_g").alias("b"), "distance")
