"""Removal of passages that stand in earlier documents, with suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.llm.automaton import SuffixAutomaton
from trustframe.llm.common import SPACED, Bitmap, as_bytes, released, shingles, stored, text_slices, word_hashes

#: Words of an anchor; every window of at least this many words has one.
ANCHOR = 5
#: Least and most bits of a map of anchors that tasks hold: 8 MB and 32 MB.
ANCHOR_BITS, MOST_BITS = 26, 28
NO_DOC = np.iinfo(np.int64).max


def _runs(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of one text with the same anchor: text, anchor, first window, number of windows.

    ``words`` are those of all texts, ``bounds`` where each begins. The anchor of a window is the least hash of its
    runs of ANCHOR words, so equal windows have equal anchors, wherever they stand.
    """
    grams, windows = shingles(words, ANCHOR), len(words) - window + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    least = grams[:windows].copy()
    for k in range(1, window - ANCHOR + 1):
        np.minimum(least, grams[k:k + windows], out=least)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(text[:windows] == text[window - 1:])
    least, text = least[inside], text[inside]
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))[:len(inside)]
    count = np.diff(np.append(first, len(inside)))
    return text[first], least[first], inside[first] - bounds[:-1][text[first]], count


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some texts of a batch at a time: number of the first, word hashes, and where each text's words begin."""
    for a, b in text_slices(batch["text"], 1 << 20):
        yield a, *word_hashes(as_bytes(batch["text"].slice(a, b - a)), SPACED, False)


def anchors(docs: DataFrame, window: int, sift: Bitmap | None = None) -> DataFrame:
    """anchor, doc_id: the anchors of each text, only those in ``sift`` if given, which are left out where they are found."""
    held = sift.mask() if sift else None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            doc_ids = batch["doc_id"].to_numpy()
            for at, words, bounds in _chunks(batch):
                text, anchor, _, _ = _runs(words, bounds, window)
                if held:
                    kept = held(anchor)
                    text, anchor = text[kept], anchor[kept]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(doc_ids[at + text])],
                                                 names=["anchor", "doc_id"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(find, "anchor long, doc_id long")


def _pieces(docs: DataFrame, sift: Bitmap, window: int, worded: bool = False) -> DataFrame:
    """anchor, piece, doc_id, row_key, start, windows: the runs of windows whose anchor may be in ``sift``.

    ``piece`` is the hash of all words of the windows, as 32-bit hashes; if ``worded``, they are a column too.
    """
    held = sift.mask()
    names = ["anchor", "piece", "doc_id", "row_key", "start", "windows", "words"][:7 if worded else 6]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            doc_ids, row_keys = batch["doc_id"].to_numpy(), batch["row_key"].to_numpy()
            for at, words, bounds in _chunks(batch):
                text, anchor, first, count = _runs(words, bounds, window)
                found = np.flatnonzero(held(anchor))
                short = (words >> np.uint64(32)).astype("<u4").tobytes()
                text, first, count = text[found], first[found], count[found]
                begin = bounds[text] + first
                own = [short[4 * x:4 * y] for x, y in zip(begin.tolist(), (begin + count + window - 1).tolist(), strict=True)]
                columns = [pa.array(anchor[found].view(np.int64)), pa.array(map(hash_bytes, own), pa.int64()),
                           pa.array(doc_ids[at + text]), pa.array(row_keys[at + text]),
                           pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.binary())][:len(names)], names=names)

    schema = "anchor long, piece long, doc_id long, row_key long, start int, windows int"
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "row_key", "text").mapInArrow(
        cut, schema + ", words binary" if worded else schema)


def hash_bytes(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data), "little", signed=True)


def _single_windows(pieces: DataFrame, window: int) -> DataFrame:
    """Worded pieces cut into their windows, each with its own hash as the anchor; the words are left out."""
    names = ["anchor", "doc_id", "row_key", "start", "windows"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            rows: list[list] = [[], [], [], []]
            for doc_id, row_key, start, words in zip(*(batch[c].to_pylist() for c in ("doc_id", "row_key", "start", "words")),
                                                     strict=True):
                for k in range(len(words) // 4 - window + 1):
                    own = hash_bytes(words[4 * k:4 * (k + window)])
                    for column, value in zip(rows, (own, doc_id, row_key, start + k), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, t) for x, t in zip(rows, (*[pa.int64()] * 3, pa.int32()), strict=True)),
                 pa.array(np.ones(len(rows[0]), np.int32))], names=names)

    return pieces.select("doc_id", "row_key", "start", "words").mapInArrow(
        cut, "anchor long, doc_id long, row_key long, start int, windows int")


def first_documents(references: list[tuple[int, list[int]]], window: int) -> list[list[int]]:
    """For every window of every reference (doc_id, words), the smallest doc_id of a reference that has it.

    The references are added to one automaton, whose states learn the smallest document their runs end in. Then each
    is streamed through it: the state of the last ``window`` words, found by suffix links, answers for the window.
    """
    automaton, own = SuffixAutomaton(), {}
    for doc_id, words in references:
        for state in automaton.add(words):
            own[state] = min(doc_id, own.get(state, NO_DOC))
    least = [own.get(state, NO_DOC) for state in range(len(automaton.length))]
    for state in automaton.longest_first():
        link = automaton.link[state]
        if least[state] < least[link]:
            least[link] = least[state]
    following, link, length, answers = automaton.next, automaton.link, automaton.length, []
    for _, words in references:
        state = matched = 0
        found = []
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            while length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if matched >= window:
                found.append(least[state])
        answers.append(found)
    return answers


def _after_first(pieces: DataFrame, lows: DataFrame) -> DataFrame:
    """doc_id, row_key, starts of all windows of the pieces whose document isn't the first (``lows``) with their anchor."""
    later = pieces.select("anchor", "doc_id", "row_key", "start", "windows").join(
        lows.select("anchor", "low"), "anchor").where("doc_id > low")
    return later.select("doc_id", "row_key", F.sequence("start", F.col("start") + F.col("windows") - 1).alias("starts"))


def _anchor_map(found: DataFrame) -> Bitmap:
    """Map of a written column of anchors; it has eight bits per anchor, between 8 MB and 32 MB in all.

    With more anchors others pass more often. They cost rows, but nothing goes by them.
    """
    return Bitmap(found, min(max((8 * found.count()).bit_length(), ANCHOR_BITS), MOST_BITS), hashed=True)


def covered_windows(docs: DataFrame, window: int = 13, shard_pieces: int = 3000, anchor_pieces: int = 1000) -> DataFrame:
    """doc_id, row_key, starts: the first words of all windows that also start in a document with a smaller doc_id.

    ``docs`` has doc_id, text and row_key, a hash of the text, which tells rows of one doc_id apart. Repeated rows give
    their starts more than once.
    Anchors that stand in several documents are found first; only the words around them go on, and texts are read where
    they are, not moved. Equal windows have equal anchors. Where all pieces of an anchor are equal, each of their windows
    stands first in the smallest document that has the anchor, and no words are moved. The other pieces are dealt to
    shards by their anchor, so they meet all that can match them, and each shard's automaton has a bounded number of
    different pieces. An anchor with more than ``anchor_pieces`` different surroundings is split: its pieces are cut into
    single windows, which are compared by their own hash. Equal pieces are merged first, so copies cost one.
    """
    spread = anchors(docs, window).groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    repeated = stored(spread.where("low < high").select("anchor"), "repeated-anchors")
    pieces = stored(_pieces(docs, _anchor_map(repeated), window), "pieces")
    kinds = stored(pieces.groupBy("anchor").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("piece") == F.max("piece")).alias("alone"))
        .where("low < high").select("anchor", "low", "alone"), "kinds-of-anchors")
    found = _after_first(pieces, kinds.where("alone"))
    several = kinds.where("NOT alone").select("anchor")
    if several.isEmpty():
        return _starts(found)
    worded = stored(_pieces(docs, _anchor_map(several), window, worded=True), "worded-pieces")
    wide = stored(worded.select("anchor", "piece").distinct().groupBy("anchor").count().where(
        F.col("count") > anchor_pieces).select("anchor"), "wide-anchors")
    if not wide.isEmpty():
        single = stored(_single_windows(worded.join(wide, "anchor", "left_semi"), window), "single-windows")
        found = found.unionByName(_after_first(single, single.groupBy("anchor").agg(
            F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")))
        worded = worded.join(wide, "anchor", "left_anti")
    references = stored(worded.groupBy("anchor", "piece").agg(
        F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("words").alias("words")), "references")
    shards = max(1, -(-references.count() // shard_pieces))

    def search(table: pa.Table) -> pa.Table:
        _, which, mates = np.unique(table["anchor"].to_numpy(), return_inverse=True, return_counts=True)
        table = table.filter(pa.array(mates[which] > 1))  # the map lets a few others pass
        doc_ids, last = table["doc_id"].to_pylist(), table["last"].to_pylist()
        words = [np.frombuffer(x, "<u4").tolist() for x in table["words"].to_pylist()]
        met = first_documents(list(zip(doc_ids, words, strict=True)), window)
        later = [k for k, firsts in enumerate(met) if min(firsts) < last[k]]
        return pa.table({"piece": table["piece"].take(pa.array(later, pa.int64())),
                         "firsts": pa.array([met[k] for k in later], pa.list_(pa.int64()))})

    sharded = references.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    firsts = stored(sharded.groupBy("shard").applyInArrow(search, "piece long, firsts array<long>"), "firsts")
    places = worded.select("piece", "doc_id", "row_key", "start").join(firsts, "piece")
    starts = F.filter(F.transform("firsts", lambda first, k: F.when(first < F.col("doc_id"), k + F.col("start"))),
                      lambda x: x.isNotNull())
    return _starts(found.unionByName(places.select("doc_id", "row_key", starts.alias("starts")).where(F.size("starts") > 0)))


def _starts(found: DataFrame) -> DataFrame:
    """doc_id, row_key and all starts that were found for them."""
    return found.groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


CUT = ("doc_id", "n_words", "n_removed", "kept_sha256", "text", "carried")


def remove_repeats(docs: DataFrame, window: int = 13, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, the text that is kept, and the columns named in ``carry``, for each
    row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id. What
    is kept of a text that loses words is joined by single spaces; other texts stay as they are, null too, while the
    hash is always that of the words joined by single spaces. Texts shorter than the window lose nothing. Rows that
    repeat a doc_id don't make each other's windows repeated, and each loses words by its own text; a null doc_id
    neither loses words nor takes them from others.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(0).alias("carried"))
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    covered = stored(covered_windows(keyed, window), "covered")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(x, y - x) for b in released(batches) for x, y in text_slices(b["text"], 1 << 20)):
            out: list[list] = [[], [], [], []]
            for text, starts in zip(batch["text"].cast(pa.binary()), batch["starts"], strict=True):
                text = text.as_py()
                words = (text or b"").split()
                kept = words
                if starts.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    own = np.unique(starts.values.to_numpy())
                    change[own] += 1
                    change[own + window] -= 1
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
                joined = b" ".join(kept)
                values = (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(),
                          text if len(kept) == len(words) else joined)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]),
                 pa.array(out[3], pa.binary()).cast(pa.string()), batch["carried"]], names=list(CUT))

    schema = rows.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add(
        "kept_sha256", "string").add("text", "string").add("carried", rows.schema["carried"].dataType)
    touched = Bitmap(covered.select("doc_id"))
    ids = covered.select(F.col("doc_id").alias("covered_id"), "row_key", "starts")
    none = F.lit(None).cast("array<int>").alias("starts")
    same = (F.col("doc_id") == F.col("covered_id")) & (F.xxhash64("text") == F.col("row_key"))
    some = touched.rows(rows, "doc_id").join(ids, same, "left").select(
        "doc_id", "text", "starts", "carried")
    others = touched.rows(rows, "doc_id", inside=False).select("doc_id", "text", none, "carried")
    both = others.mapInArrow(cut, schema).unionByName(some.mapInArrow(cut, schema))
    return both.select(*CUT[:-1], *[F.col("carried")[c].alias(c) for c in carry])
