"""Helpers shared by the operators: written tables, batches of texts and hashed words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.session import checkpoint_folder

#: Bytes hashed at a time; longer texts are cut between words, so memory stays bounded.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = np.random.default_rng(20240229)
_TABLE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder, and read back.

    Later steps start from the files, so a lost executor costs no recomputation of what came before.
    """
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task. After each, memory that is free by then goes back to the system.

    Python workers are kept for later tasks; without this each of them keeps the most that it ever held.
    """
    for batch in batches:
        yield batch
        del batch
        release()


def release() -> None:
    """Gives free memory of Arrow, and, where the C library can, that of NumPy and Python back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Bitmap:
    """A set of 64-bit numbers hashed into a fixed number of bits: no member is missed, a few others pass.

    Its size doesn't depend on the number of members. An exact join has to follow; the bitmap spares most other rows
    its shuffle.
    """

    def __init__(self, members: DataFrame, bits: int = 23, hashed: bool = False):
        """``members`` has one column of longs without nulls; if they are hashes already, their low bits are the slot."""
        self.size, self.hashed = 1 << bits, hashed
        words = members.select(self._slot(members.columns[0]).alias("slot")).groupBy(
            F.shiftright("slot", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits")).toArrow()
        bitmap = np.zeros(1 << bits - 6, np.int64)
        bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
        self.shared = members.sparkSession.sparkContext.broadcast(bitmap)

    def _slot(self, key: str) -> Column:
        return F.pmod(F.col(key) if self.hashed else F.xxhash64(key), F.lit(self.size))

    def mask(self) -> Callable[[np.ndarray], np.ndarray]:
        """Which of an array of hashes may be members, for use inside tasks; only if the members are hashes."""
        shared, low = self.shared, self.size - 1

        def held(hashes: np.ndarray) -> np.ndarray:
            at = hashes.view(np.int64) & low
            return (shared.value[at >> 6] >> (at & 63) & 1) == 1

        return held

    def rows(self, df: DataFrame, key: str, inside: bool = True) -> DataFrame:
        """Rows of ``df`` whose ``key`` may be a member, or the other rows; a null key is no member.

        Only the slots pass through Python; the rows stay where they are.
        """
        shared = self.shared

        def sift(slots: pa.Array) -> pa.Array:
            at = slots.to_numpy(zero_copy_only=False)
            return pa.array(((at >= 0) & ((shared.value[at >> 6] >> (at & 63) & 1) == 1)) == inside)

        slot = F.when(F.col(key).isNull(), F.lit(-1).cast("long")).otherwise(self._slot(key))
        return df.where(F.arrow_udf(sift, "boolean")(slot))


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in the given closed spans."""
    inside = np.zeros(256, bool)
    for low, high in spans:
        inside[low:high + 1] = True
    return inside


#: Bytes of words that white space separates, and of words of letters and digits (any byte over 127 counts).
SPACED = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(values: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values so that every bit depends on all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(PIECE + 1, base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors))
    return _POWERS


def _piece(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word in at most PIECE bytes."""
    power, inverse = _powers()
    word = inside[data].view(np.int8)
    edges = np.flatnonzero(np.diff(word, prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _cuts(data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~inside[data[at:end]])
            if not len(gaps):  # one word longer than a piece: its parts count as one word, see word_hashes
                yield at, end
                at = end
                continue
            end = at + int(gaps[-1]) + 1
        yield at, end
        at = end


def word_hashes(texts: list[bytes | None], inside: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and where each text's words begin (one more at the end).

    A text that is null or empty has no words. Words are runs of bytes in ``inside``, after A-Z are lowered if
    asked for. Words longer than PIECE bytes are hashed by parts.
    """
    joined = np.frombuffer(b"\n".join(x or b"" for x in texts) + b"\n", np.uint8)
    bounds = np.cumsum([0] + [len(x or b"") + 1 for x in texts])
    if lower:
        joined = _LOWER[joined]
    hashes, starts, open_part = [], [], False
    for at, end in _cuts(joined, inside):
        h, s = _piece(joined[at:end], inside)
        if open_part and len(s) and s[0] == 0 and len(h):
            hashes[-1][-1:] = mix(hashes[-1][-1:] + h[:1])
            h, s = h[1:], s[1:]
        open_part = bool(inside[joined[end - 1]])
        if len(h):
            hashes.append(h)
            starts.append(s + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = _BASE
    for k in range(width):
        total += words[k:k + n] * np.uint64(factor & 0xFFFFFFFFFFFFFFFF)
        factor = factor * 0xD1342543DE82EF95 + 2
    return mix(total)


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to about ``limit``; a larger item stands alone."""
    begin = total = at = 0
    for at, size in enumerate(sizes):
        if total and total + size > limit:
            yield begin, at
            begin, total = at, 0
        total += size
    if total or begin <= at:
        yield begin, at + 1


def text_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of a column of texts with about ``limit`` bytes each, found without making Python texts."""
    return slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
