"""Best partial alignment: the place of a text that a claim can be turned into with the fewest edits.

An edit inserts, deletes or replaces one character; what stands before and after the place is free. The columns of the
usual table of distances are kept as differences in the bits of two integers, so one character of the text costs a few
integer operations whatever the claim's length, and no table is built.

``edit_distances`` does the same for whole texts, many pairs at a time in numpy arrays of 64-bit words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: What ``align`` adds for each claim.
ADDED = [StructField("pos", IntegerType()), StructField("claim", StringType()), StructField("edits", IntegerType()),
         StructField("start", IntegerType()), StructField("end", IntegerType())]

#: Words of the bit tables of claims, and characters of the texts, that are held at a time.
CELLS = 1 << 20


def _distances(pattern: str, text: Iterator[str], anchored: bool) -> Iterator[int]:
    """Edits between the pattern and what ends at each character; it begins anywhere, or at the first if anchored."""
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, top, first = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1), int(anchored)
    more, fewer, edits = full, 0, len(pattern)  # bits: where the column goes up or down by one
    for c in text:
        same = places.get(c, 0)
        across = (((same & more) + more) ^ more) | same
        rising, falling = fewer | (full & ~(across | more)), more & across
        edits += bool(rising & top) - bool(falling & top)
        rising, falling = (rising << 1 | first) & full, (falling << 1) & full
        below = same | fewer
        more, fewer = falling | (full & ~(below | rising)), rising & below
        yield edits


def best_place(pattern: str, text: str) -> tuple[int, int, int]:
    """(edits, start, end): the fewest edits, of these the first end, of these the shortest place.

    Characters count from 0, ``end`` is exclusive. An empty pattern stands at 0 with no edits.
    """
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    edits, end = len(pattern), 0
    for j, now in enumerate(_distances(pattern, text, False), 1):
        if now < edits:
            edits, end = now, j
    start = end
    if edits < len(pattern):
        backward = (text[j] for j in range(end - 1, -1, -1))
        start = next(end - n for n, now in enumerate(_distances(pattern[::-1], backward, True), 1) if now == edits)
    return edits, start, end


def align(pairs: DataFrame, claims: str = "claims", text: str = "text") -> DataFrame:
    """One row per claim of each row: the other columns of ``pairs``, then pos, claim, edits, start and end.

    ``claims`` is an array of strings, and the text it is compared with travels once for all of them. A null claim or
    text has null edits and no place; rows without claims give none. Other columns may not be named as those added.
    """
    kept = [c for c in pairs.columns if c not in (claims, text)]
    clash = {f.name for f in ADDED} & set(kept)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here; rename those of the input")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                body, found = batch[text][at].as_py(), []
                for pos, claim in enumerate(batch[claims][at].as_py() or []):
                    known = claim is not None and body is not None
                    found.append((pos, claim, *(best_place(claim, body) if known else (None, None, None))))
                if found:
                    row = batch.select(kept).take(pa.array([at] * len(found)))
                    made = [pa.array(v, t) for v, t in zip(zip(*found, strict=True), (
                        pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*row.columns, *made], names=[*kept, *[f.name for f in ADDED]])

    return pairs.mapInArrow(run, StructType([pairs.schema[c] for c in kept] + ADDED))


def _padded(points: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Matrix of the characters that start at ``begin``, a row for each text, filled up with ``pad``."""
    at = np.arange(width)
    inside = at < size[:, None]
    return np.where(inside, points[np.where(inside, begin[:, None] + at, 0)], pad)


def _bit_tables(claims: np.ndarray, kinds: int) -> np.ndarray:
    """(claim, word, character): the places of each character in each 64 characters of a claim, as bits."""
    rows, width = claims.shape
    tables = np.zeros((rows, width // 64, kinds + 1), np.uint64)
    row, word = np.ogrid[:rows, :width // 64]
    for k in range(64):
        tables[row, word, claims[:, k::64]] |= np.uint64(1 << k)
    tables[:, :, kinds] = 0  # what fills up is nowhere
    return tables


def _edits(tables: np.ndarray, claim: np.ndarray, size: np.ndarray, texts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Edits between claims, by their number in ``tables``, and texts, the longest first."""
    words, kinds = tables.shape[1:]
    flat, base, one = tables.ravel(), claim * (words * kinds), np.uint64(1)
    more, fewer = np.full((words, len(claim)), ~np.uint64(0)), np.zeros((words, len(claim)), np.uint64)
    edits, last, texts = size.astype(np.int64), ((size - 1) % 64).astype(np.uint64), np.ascontiguousarray(texts.T)
    for j in range(int(length[0])):
        n = int(np.searchsorted(-length, -j))  # the texts that go on
        places = base[:n] + texts[j, :n]
        up, down = np.full(n, one), np.zeros(n, np.uint64)
        for w in range(words):
            same, rise, fall = flat[places + w * kinds], more[w, :n], fewer[w, :n]
            below = same | fall
            same |= down
            across = (((same & rise) + rise) ^ rise) | same
            rising, falling = fall | ~(across | rise), rise & across
            if w == words - 1:
                edits[:n] += (rising >> last[:n] & one).astype(np.int64) - (falling >> last[:n] & one).astype(np.int64)
            rising, up = rising << one | up, rising >> np.uint64(63)
            falling, down = falling << one | down, falling >> np.uint64(63)
            more[w, :n], fewer[w, :n] = falling | ~(below | rising), rising & below
    return edits


def edit_distances(claims: list[str], texts: list[str], claim: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Edits that turn one whole text into another, for each pair of numbers of a claim and a text."""
    every = np.frombuffer("".join([*claims, *texts]).encode("utf-32-le"), np.uint32)
    known, points = np.unique(every, return_inverse=True)
    sizes = np.array([len(x) for x in [*claims, *texts]], np.int64)
    starts = np.cumsum(sizes) - sizes
    text = text + len(claims)
    edits = np.where(sizes[claim] == 0, sizes[text], sizes[claim])  # of pairs with an empty text
    words = -(-sizes[claim] // 64)
    order = np.lexsort((claim, words))
    order = order[(words[order] > 0) & (sizes[text[order]] > 0)]
    at = 0
    while at < len(order):
        wide = int(words[order[at]])
        end = int(np.searchsorted(words[order], wide, "right"))
        step = max(1, CELLS // (wide * (len(known) + 1)))
        while at < end:
            longest = np.maximum.accumulate(sizes[text[order[at:min(end, at + step)]]])
            held = max(1, int(np.count_nonzero(longest * np.arange(1, len(longest) + 1) <= CELLS)))
            own = order[at:at + held]
            own = own[np.argsort(-sizes[text[own]], kind="stable")]
            names, which = np.unique(claim[own], return_inverse=True)
            tables = _bit_tables(_padded(points, starts[names], sizes[names], 64 * wide, len(known)), len(known))
            length = sizes[text[own]]
            edits[own] = _edits(tables, which, sizes[claim[own]],
                                _padded(points, starts[text[own]], length, int(length[0]), len(known)), length)
            at += held
    return edits


def close_edits(claim: Column, texts: Column, least: float) -> Column:
    """For each of the array ``texts`` the edits that turn the claim into it; null for a null text or claim, and where the
    lengths alone rule a similarity of ``least`` out."""
    def run(claims: pa.Array, lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), sizes)
        known, which = flat.dictionary_encode(), np.arange(len(flat))
        length_a = pc.fill_null(pc.utf8_length(claims), -1).to_numpy()[owner].astype(np.int64)
        length_b = pc.fill_null(pc.utf8_length(flat), -1).to_numpy().astype(np.int64)
        possible = (length_a >= 0) & (length_b >= 0) & (
            np.abs(length_a - length_b) < np.maximum(length_a, length_b) * (1 - least))
        pairs = which[possible]
        edits = np.zeros(len(flat), np.int32)
        if len(pairs):
            named = pc.fill_null(known.indices, 0).to_numpy()[pairs]
            edits[pairs] = edit_distances(pc.fill_null(claims, "").to_pylist(),
                                          pc.fill_null(known.dictionary, "").to_pylist(), owner[pairs], named)
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(edits, mask=~possible), mask=lists.is_null())

    return F.arrow_udf(run, "array<int>")(claim, texts)
