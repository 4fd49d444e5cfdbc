"""Best-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.llm import tokenizer
from trustframe.llm.common import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", bin long, place long, fill long, carried boolean"


def token_pieces(docs: DataFrame, path: str, length: int, end_id: int) -> DataFrame:
    """One row per piece: the ids of a text, then ``end_id``, cut into ``length`` tokens only if longer.

    The first piece of a cut document takes the remainder, all others are full. A null text counts as empty and
    gives the piece of ``end_id`` alone; repeated rows give repeated pieces.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokenizer.vocabulary(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(vocabulary.ids(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) if len(ids) <= length else len(ids) % length or length
                edges = [0, *range(first, len(ids) + 1, length)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, value in zip(rows, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].data)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit(sizes: Iterable[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each size (largest first gives the best result), and the fill of each bin.

    Bins of equal room are found in constant time: one list per room, and a bit for each list with bins.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    bins, places, bits = [], [], 0
    for size in sizes:
        fitting = bits >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = rooms[room].pop()
            if not rooms[room]:
                bits ^= 1 << room
        else:
            room, bin_ = capacity, len(filled)
            filled.append(0)
        bins.append(bin_)
        places.append(filled[bin_])
        filled[bin_] += size
        room -= size
        rooms[room].append(bin_)
        bits |= 1 << room
    return bins, places, filled


def _carried(fills: np.ndarray, capacity: int, slack: int, most: int) -> np.ndarray:
    """Bins that go on to the next round: those with the most room, and none that is nearly full.

    After a best fit at most one bin of a group is at most half full. A merge of ``fan`` groups thus has at most
    ``fan`` bins that can be put into others, so the ``fan + 1`` roomiest bins of each group are all it needs.
    """
    chosen = np.zeros(len(fills), bool)
    chosen[np.argsort(fills, kind="stable")[:most]] = True
    return chosen & (fills < capacity - slack)


def pack(docs: DataFrame, path: str | None = None, length: int = 1024, end_id: int = 2, group_items: int = 20_000,
         fan: int = 16, slack: int = 8) -> DataFrame:
    """Hierarchical residual packing: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are spread over groups of about ``group_items`` and packed there by best fit, longest first. Bins with
    at most ``slack`` free tokens are final. The roomiest others go up a tree of groups, ``fan`` at a time, as items
    of further best-fit rounds, until one group is left. A group's size is bounded whatever the input's size or
    skew is. No documents give no rows. Ties and repeated rows are placed like any others, each on its own.
    """
    pieces = stored(token_pieces(docs, path or tokenizer.default_path(), length, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_items))

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True])
        bins, places, fills = best_fit(frame["length"].tolist(), length)
        chosen, which = _carried(np.array(fills), length, slack, fan + 1), np.array(bins)
        group = int(frame["packing_group"].iloc[0])
        return frame.drop(columns="packing_group").assign(bin=(group << 24) + which, place=places,
                                                          fill=np.array(fills)[which], carried=chosen[which])

    salted = pieces.withColumn("packing_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    packed = stored(salted.groupBy("packing_group").applyInPandas(local, PACKED), "packed")
    moves = _merge_rounds(packed, groups, length, fan, slack)
    if moves is not None:
        packed = packed.join(moves.withColumnRenamed("moved", "bin"), "bin", "left")
    else:
        packed = packed.withColumns({"root": F.lit(None).cast("long"), "base": F.lit(None).cast("long")})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         F.coalesce("root", "bin").alias("sequence_id"),
                         (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset"))


def _merge_rounds(packed: DataFrame, groups: int, length: int, fan: int, slack: int) -> DataFrame | None:
    """Where bins of the first round end up: moved, root, base. None if there was a single group."""
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "bin"], ascending=[False, True])
        bins, places, fills = best_fit(frame["fill"].tolist(), length)
        which = np.array(bins)
        roots = np.zeros(len(fills), np.int64)
        roots[which[::-1]] = frame["bin"].to_numpy()[::-1]  # the first bin put into a place names it
        chosen = _carried(np.array(fills), length, slack, fan + 1)
        return pd.DataFrame({"bin": frame["bin"], "root": roots[which], "base": places,
                             "fill": np.array(fills)[which], "carried": chosen[which]})

    def parent(level: int) -> Column:
        return F.shiftright("bin", 24 + level * (fan - 1).bit_length())

    bins = packed.where("place = 0 AND carried").select("bin", "fill")
    moves, level = None, 0
    while groups > 1:
        groups, level = -(-groups // fan), level + 1
        merged = stored(bins.groupBy(parent(level).alias("parent")).applyInPandas(
            merge, "bin long, root long, base long, fill long, carried boolean"), "merged")
        step = merged.select(F.col("bin").alias("moved"), "root", "base")
        if moves is not None:
            after = step.select(F.col("moved").alias("root"), F.col("root").alias("end"), F.col("base").alias("more"))
            moves = moves.join(after, "root", "left").select(
                "moved", F.coalesce("end", "root").alias("root"),
                (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        else:
            moves = step
        bins = merged.where("base = 0 AND carried").select(F.col("root").alias("bin"), "fill")
    return moves
