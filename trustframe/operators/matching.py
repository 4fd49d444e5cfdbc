"""Exact text matching joins that avoid comparing every pair.

``match_sets`` joins word sets that share enough words, in one of two ways that give the same pairs.
By blocks, a task holds a block of right sets, of bounded size, and counts the words that each left
set passing by shares with them; only pairs that share enough leave it. By rare words, each left set is sorted by how
rare its words are on the right and joined only on the rarest ones: a pair that shares at least ``t``
of the ``m`` words that can match at all must share one of the first ``m - t + 1``. That moves a row
per candidate, so it is taken only where it moves fewer rows than the blocks do. No candidate is
capped or dropped. Where the right sets make a single block, ``greatest_met`` gives it to the left sets
instead, which then stay in their rows.

``contained_terms`` finds terms inside texts as substrings. A text holding a term also holds the
term's rarest character run, so a task that holds a block of terms looks only that run up in the texts
passing by; runs themselves are not moved.

Both work on distinct sets and texts, so copies are compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.functions import text
from trustframe.functions.session import cut_lineage

GRAM = 4

#: Right sets of a block, and numbers that a task holds at a time.
RIGHT_ROWS, CELLS = 1 << 13, 1 << 21

#: Bytes of words in a block that goes to every task.
HELD_BYTES = 1 << 24

#: Terms of a block, and characters of texts that a task holds at a time.
TERM_ROWS, CHARACTERS = 1 << 14, 1 << 20


def set_key(words: Column) -> Column:
    """Key of a word set, the same for every order of the words."""
    return F.md5(F.array_join(F.array_sort(words), "\x1f"))


def match_sets(left: DataFrame, right: DataFrame, need: Callable[[Column], Column]) -> DataFrame:
    """Pairs (left_key, right_key, n_left, n_right, overlap) with ``overlap >= need(n_left)``.

    Both sides have ``key`` and ``words`` (distinct words); ``need`` gives at least one.
    """
    return match_rows(_distinct_sets(left), right, need)


def _distinct_sets(frame: DataFrame) -> DataFrame:
    # sorted words, so that equal sets are equal rows and a hash aggregate removes the copies
    return frame.select("key", F.array_sort("words").alias("words")).filter(F.size("words") > 0).distinct()


def match_rows(left: DataFrame, right: DataFrame, need: Callable[[Column], Column]) -> DataFrame:
    """``match_sets`` for a left side with a key per row: each row is matched by itself, which saves a shuffle."""
    rights = cut_lineage(_distinct_sets(right).where("key IS NOT NULL").select(
        F.col("key").alias("right_key"), "words", F.size("words").alias("n_right")))
    lefts = left.where("key IS NOT NULL").where(F.size("words") > 0).select(
        F.col("key").alias("left_key"), "words", F.size("words").alias("n_left")).withColumn(
        "needed", _needed(F.col("n_left"), need))
    n_rights = rights.count()
    blocks = max(1, -(-n_rights // RIGHT_ROWS))
    if blocks > 1:
        lefts = cut_lineage(lefts.withColumn("set", set_key(F.col("words"))))
        right_words = text.each(rights, ["right_key"], F.col("words"), "word")
        sets = lefts.select(F.col("set").alias("left_key"), F.array_sort("words").alias("words"), "n_left", "needed").distinct()
        prefix, possible = _rare_words(sets, right_words)
        if (prefix.agg(F.sum("frequency")).first()[0] or 0) < lefts.count() * blocks + n_rights * _slots(lefts):
            pairs = _by_rare_words(prefix, possible, rights, right_words).withColumnRenamed("left_key", "set")
            return lefts.select("left_key", "set", "n_left").join(pairs, ["set", "n_left"]).select(
                "left_key", "right_key", "n_left", "n_right", "overlap")
    return _by_blocks(lefts, rights, blocks)


def _needed(size: Column, need: Callable[[Column], Column]) -> Column:
    return F.greatest(F.lit(1), need(size).cast("int"))


def _slots(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_blocks(lefts: DataFrame, rights: DataFrame, blocks: int) -> DataFrame:
    """Every left set meets every right block once. The left is dealt into slots, a copy of each block goes to each."""
    types = dict(lefts.dtypes) | dict(rights.dtypes)

    def none(name: str) -> Column:
        return F.lit(None).cast(types[name]).alias(name)

    asks = lefts.select("left_key", none("right_key"), "words", F.col("n_left").alias("size"), "needed")
    held = rights.select(none("left_key"), "right_key", "words", F.col("n_right").alias("size"), F.lit(0).alias("needed"))
    return _meeting(asks, "left_key", held, "right_key", blocks).mapInArrow(
        shared_words, f"left_key {types['left_key']}, right_key {types['right_key']}, n_left int, n_right int, overlap int")


def _meeting(asks: DataFrame, ask_key: str, held: DataFrame, held_key: str, blocks: int) -> DataFrame:
    """Rows of both sides by cell, the pair of a slot of asking rows and a block of held ones, which come first."""
    slots = _slots(asks)
    asks = asks.select("*", F.lit(True).alias("asks"), F.pmod(F.xxhash64(ask_key), F.lit(slots)).alias("slot"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    held = held.select("*", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
                       F.pmod(F.xxhash64(held_key), F.lit(blocks)).alias("block"))
    both = held.unionByName(asks).withColumn("cell", F.col("slot") * blocks + F.col("block")).drop("slot", "block")
    return both.repartitionById(slots, F.pmod("cell", F.lit(slots)).cast("int")).sortWithinPartitions("cell", "asks")


def shared_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function of rows that are sorted by cell, right sets first: the pairs that share enough words."""
    return _met(batches, Block)


def _met(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    """``pairs`` of every run of asking rows with a ``kind`` made of its cell's held rows."""
    cell, held, block = None, [], None
    for batch in batches:
        cells, asks = batch["cell"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1
        for first, last in zip([0, *cuts], [*cuts, len(cells)], strict=True):
            if first == last:
                continue
            if cells[first] != cell:
                cell, held, block = cells[first], [], None
            part = batch.slice(first, last - first)
            if not asks[first]:
                held.append(part)
            elif held:
                block = block or kind(pa.Table.from_batches(held).combine_chunks())
                yield from block.pairs(part)


def _flat(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of all words of the sets."""
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(words)), sizes), pc.list_flatten(words)


class Block:
    """Right sets by their words: for each word the rows that hold it."""

    def __init__(self, table: pa.Table):
        self.keys, self.sizes = table["right_key"].combine_chunks(), table["size"].combine_chunks()
        rows, words = _flat(pa.concat_arrays(table["words"].chunks))
        coded = words.dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy()
        rows, codes, self.words = rows[codes >= 0], codes[codes >= 0], coded.dictionary
        self.rows = rows[np.argsort(codes, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.words)))])

    def pairs(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Left sets against the block."""
        for mine, other, shared in self.meets(batch["words"], batch["needed"].to_numpy()):
            overlap, mine, other = pa.array(shared), pa.array(mine), pa.array(other)
            yield pa.RecordBatch.from_arrays(
                [batch["left_key"].take(mine), self.keys.take(other), batch["size"].take(mine), self.sizes.take(other),
                 overlap], names=["left_key", "right_key", "n_left", "n_right", "overlap"])

    def meets(self, lefts: pa.Array, needed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left row, right row, shared words) of the pairs that share enough, those of a left row together and in order.

        At most ``CELLS`` pairs and word hits, or those of one set, are held at a time.
        """
        rows, words = _flat(lefts)
        codes = pc.index_in(words, value_set=self.words, skip_nulls=True).fill_null(-1).to_numpy()
        rows, codes = rows[codes >= 0], codes[codes >= 0]
        sizes = self.starts[codes + 1] - self.starts[codes]
        hits = np.concatenate([[0], np.cumsum(sizes)])
        width = len(self.keys)
        step = max(1, CELLS // width)
        for first in range(0, len(lefts), step):
            last = min(first + step, len(lefts))
            shared = np.zeros((last - first) * width, np.int32)
            at, end = np.searchsorted(rows, [first, last])
            while at < end:
                to = at + max(1, int(np.searchsorted(hits[at + 1:end + 1], hits[at] + CELLS, "right")))
                size = sizes[at:to]
                place = np.arange(size.sum()) + np.repeat(self.starts[codes[at:to]] - hits[at:to] + hits[at], size)
                cells = np.repeat((rows[at:to] - first) * width, size) + self.rows[place]
                shared += np.bincount(cells, minlength=len(shared)).astype(np.int32)
                at = to
            shared = shared.reshape(last - first, width)
            mine, other = np.nonzero(shared >= needed[first:last, None])
            if len(mine):
                yield mine + first, other, shared[mine, other]


def held_rights(rights: DataFrame) -> pa.Table | None:
    """Right sets (key, words, further columns) as a table if they make one block of bounded size, else nothing."""
    rights = rights.where("key IS NOT NULL").where(F.size("words") > 0)
    count, size = rights.agg(F.count("*"), F.sum(F.octet_length(F.array_join("words", " ")))).first()
    if count > RIGHT_ROWS or (size or 0) > HELD_BYTES:
        return None
    return rights.withColumnRenamed("key", "right_key").withColumn("size", F.size("words")).toArrow()


def greatest_met(words: Column, need: Callable[[Column], Column], held: pa.Table, values: list[str]) -> Column:
    """Struct of the greatest of each of ``values`` (double) over the ``held`` right sets that share enough of ``words``.

    A value is null where no such set has one. ``words`` must not be null. Nothing is moved: the right sets go to
    the tasks of the left ones.
    """
    names = list(values)

    def greatest(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        block = Block(held) if held.num_rows else None
        columns = [held[v].combine_chunks() for v in names]
        sides = [(c.fill_null(-np.inf).to_numpy(), c.is_valid().to_numpy(zero_copy_only=False)) for c in columns]
        for lefts, needed in parts:
            best, there = np.full((len(names), len(lefts)), -np.inf), np.zeros((len(names), len(lefts)), bool)
            for mine, other, _ in block.meets(lefts, needed.to_numpy()) if block else ():
                starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                for i, (value, valid) in enumerate(sides):
                    best[i, mine[starts]] = np.maximum.reduceat(value[other], starts)
                    there[i, mine[starts]] = np.logical_or.reduceat(valid[other], starts)
            yield pa.StructArray.from_arrays(
                [pa.array(b, pa.float64(), mask=~t, from_pandas=False) for b, t in zip(best, there, strict=True)], names)

    kind = ", ".join(f"{v} double" for v in names)
    return F.arrow_udf(greatest, kind)(words, _needed(F.size(words), need))


def _rare_words(lefts: DataFrame, right_words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefix, possible): the words that sets are joined on, with their frequency, and the sets that can match."""
    frequency = right_words.groupBy("word").agg(F.count("*").alias("frequency"))
    sets = ["left_key", "n_left", "needed"]
    known = (text.each(lefts, sets, F.col("words"), "word")
             .join(frequency, "word").groupBy(*sets)
             .agg(F.array_sort(F.collect_list(F.struct("frequency", "word"))).alias("known")))
    # read again for the join and for the check
    possible = cut_lineage(known.filter(F.size("known") >= F.col("needed")))
    prefix = text.each(possible, ["left_key"], F.slice("known", 1, F.size("known") - F.col("needed") + 1), "k").select(
        "left_key", "k.word", "k.frequency")
    return prefix, possible


def _by_rare_words(prefix: DataFrame, possible: DataFrame, rights: DataFrame, right_words: DataFrame) -> DataFrame:
    candidates = prefix.join(right_words, "word").select("left_key", "right_key").distinct()
    checked = (candidates
               .join(possible.select("left_key", "n_left", "needed", F.transform("known", lambda k: k["word"]).alias("lw")), "left_key")
               .join(rights.select("right_key", "n_right", F.col("words").alias("rw")), "right_key")
               .withColumn("overlap", F.size(F.array_intersect("lw", "rw"))))
    return checked.filter(F.col("overlap") >= F.col("needed")).select(
        "left_key", "right_key", "n_left", "n_right", "overlap")


def share_needed(share: float) -> Callable[[Column], Column]:
    """Words to share so that they make up ``share`` of the left set."""
    return lambda n: F.ceil(F.round(n * share, 9))


def jaccard_needed(above: float = 0.5) -> Callable[[Column], Column]:
    """Words to share at least for a Jaccard similarity strictly above ``above``."""
    return lambda n: F.floor(F.round(n * above, 9)) + 1


def contained_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs (text_key, term) where the lowercase text holds the term.

    ``texts`` has text_key, body (lowercase); ``terms`` has term (lowercase, distinct, not empty).
    """
    terms = cut_lineage(terms.select("term").filter(F.length("term") > 0).distinct())
    bodies = texts.select("text_key", "body").where("text_key IS NOT NULL AND body IS NOT NULL").distinct()
    kind = dict(bodies.dtypes)["text_key"]
    asks = bodies.select("text_key", F.col("body").alias("value"))
    held = terms.select(F.lit(None).cast(kind).alias("text_key"), F.col("term").alias("value"))
    return _meeting(asks, "text_key", held, "value", max(1, -(-terms.count() // TERM_ROWS))).mapInArrow(
        found_terms, f"text_key {kind}, term string")


def found_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function of rows that are sorted by cell, terms first: the terms that the texts hold."""
    return _met(batches, Terms)


def _runs(points: np.ndarray, size: int) -> np.ndarray:
    """A number for the run of ``size`` characters from each place on; it may be shared, so finds are checked."""
    count = max(0, len(points) - size + 1)
    numbers = np.zeros(count, np.uint64)
    for k in range(size):
        numbers = numbers * np.uint64(0x110000) + points[k:k + count]
    return numbers


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts as numbers, and where each text begins, with the end."""
    points = np.array(memoryview("".join(texts).encode("utf-32-le", "surrogatepass")).cast("I"), np.uint64)
    return points, np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def _places(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, run) of all runs that lie inside one text."""
    points, starts = _points(texts)
    numbers = _runs(points, size)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[:len(numbers)]
    inside = np.arange(len(numbers)) + size <= starts[1:][owner]
    return owner[inside], numbers[inside]


class Terms:
    """Terms with the runs of ``GRAM`` characters in them; a shorter term is one run."""

    def __init__(self, table: pa.Table):
        terms = table["value"].to_pylist()
        self.groups = []
        for size in sorted({min(GRAM, len(t)) for t in terms}):
            own = [t for t in terms if min(GRAM, len(t)) == size]
            owner, numbers = _places(own, size)
            kinds, runs = np.unique(numbers, return_inverse=True)
            self.groups.append((size, own, kinds, owner, runs))

    def pairs(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, texts = batch["text_key"], batch["value"].to_pylist()
        ends = np.cumsum([len(x) for x in texts])
        first = 0
        while first < len(texts):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + CHARACTERS, "right")))
            found = self.found(texts[first:last])
            if found:
                places, terms = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.array(places) + first)), pa.array(terms, pa.string())],
                                                 names=["text_key", "term"])
            first = last

    def found(self, texts: list[str]) -> list[tuple[int, str]]:
        out = []
        for size, terms, kinds, owner, runs in self.groups:
            text_of, numbers = _places(texts, size)
            at = np.minimum(np.searchsorted(kinds, numbers), len(kinds) - 1)
            known = kinds[at] == numbers
            text_of, at = text_of[known], at[known]
            often = np.bincount(at, minlength=len(kinds))
            order = np.lexsort((often[runs], owner))  # each term's rarest run comes first
            _, where = np.unique(owner[order], return_index=True)
            rarest = runs[order][where]
            by_run: dict[int, list[str]] = {}
            for term, run in zip(terms, rarest.tolist(), strict=True):
                by_run.setdefault(run, []).append(term)
            chosen = np.zeros(len(kinds), bool)
            chosen[rarest] = True
            hits = np.unique(text_of[chosen[at]] * len(kinds) + at[chosen[at]])
            for place, run in zip((hits // len(kinds)).tolist(), (hits % len(kinds)).tolist(), strict=True):
                out += [(place, term) for term in by_run[run] if term in texts[place]]
        return out


def keyword_search(queries: DataFrame, facts: DataFrame, k: int = 5, min_score: float = 0.3,
                   scope: tuple[str, ...] = ()) -> DataFrame:
    """Top ``k`` facts per query by shared words over the larger set, or 0.9 for a keyword hit.

    ``queries`` has query_id, words, body (lowercase); ``facts`` has fact_id, words and may have
    keywords (array). Columns in ``scope`` (the tenant, say) must agree. Scores below ``min_score``
    are not results.
    """
    if scope:
        def mark(frame: DataFrame) -> DataFrame:
            marks = [F.coalesce(F.col(c), F.lit("\x00")) for c in scope]
            return frame.withColumn("words", F.transform("words", lambda w: F.concat_ws("\x1f", *marks, w)))

        queries, facts = mark(queries), mark(facts)
    f = facts.withColumn("key", set_key(F.col("words")))
    scored = (match_rows(queries.select(F.col("query_id").alias("key"), "words"), f, share_needed(min_score))
              .withColumn("score", F.round(F.col("overlap") / F.greatest("n_left", "n_right"), 9))
              .filter(F.col("score") >= min_score))
    by_words = (scored.join(f.select("fact_id", F.col("key").alias("right_key")), "right_key")
                .select(F.col("left_key").alias("query_id"), "fact_id", "score"))
    if "keywords" in facts.columns:
        words = facts.select("fact_id", *scope, F.explode("keywords").alias("term")).withColumn("term", F.lower("term"))
        texts = queries.select(F.md5("body").alias("text_key"), "body", "query_id", *scope)
        hits = contained_terms(texts, words).join(words, "term").join(
            texts.select("text_key", "query_id", *scope), ["text_key", *scope])
        by_words = (by_words.unionByName(hits.select("query_id", "fact_id", F.lit(0.9).alias("score")))
                    .groupBy("query_id", "fact_id").agg(F.max("score").alias("score")))
    return top_facts(by_words, k)


def top_facts(scored: DataFrame, k: int) -> DataFrame:
    """First ``k`` facts per query; the rank filter is cut per partition before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("fact_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
