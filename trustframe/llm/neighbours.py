"""Nearest neighbours by inner product with a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustframe.llm.common import stored

CELL = ["tree", "leaf", "part", "share"]
#: Vectors and queries of a leaf that meet in one group; larger leaves are split into more groups.
GROUP_VECTORS, GROUP_QUERIES = 8192, 2048


class Forest(NamedTuple):
    """Complete binary trees: a projection and a threshold for each inner node, in heap order."""

    normals: np.ndarray
    thresholds: np.ndarray
    depth: int
    reach: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with one more component that makes all of them equally long, so that the nearest by inner product
        are the nearest by angle. Queries get 0 there."""
        rest = np.maximum(0.0, self.reach - (vectors * vectors).sum(1))
        return np.column_stack([vectors, np.sqrt(rest)])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        lifted = self.lifted(vectors)
        found = np.zeros((len(self.normals), len(vectors)), np.int64)
        for tree, (normals, thresholds) in enumerate(zip(self.normals, self.thresholds, strict=True)):
            node = found[tree]
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", lifted, normals[node]) >= thresholds[node]
                node[:] = 2 * node + 1 + right
        return found - (2 ** self.depth - 1)

    def probe(self, query: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The first ``probes`` leaves (tree, leaf) in order of the largest margin on the way that they are off by.

        One priority queue holds the open branches of all trees.
        """
        margins = self.normals @ np.append(query, 0.0) - self.thresholds
        inner, found = 2 ** self.depth - 1, []
        heap = [(0.0, tree, 0) for tree in range(len(self.normals))]
        while heap and len(found) < probes:
            off, tree, node = heapq.heappop(heap)
            while node < inner:
                margin = margins[tree, node]
                near = 2 * node + 1 + (margin >= 0)
                heapq.heappush(heap, (max(off, abs(margin)), tree, 4 * node + 3 - near))
                node = near
            found.append((tree, int(node - inner)))
        return found


def plant(sample: np.ndarray, trees: int, depth: int, reach: float, seed: int = 7) -> Forest:
    """Trees over a sample, of at most ``depth`` levels and with at least eight vectors a leaf.

    Each node projects on the widest of three differences of random pairs of its vectors and splits at the median.
    Nodes without two different vectors get a random projection.
    """
    depth = min(depth, max(1, len(sample) // 8).bit_length() - 1)
    draw = np.random.default_rng(seed)
    inner, width = 2 ** depth - 1, sample.shape[1] + 1
    forest = Forest(np.zeros((trees, inner, width)), np.zeros((trees, inner)), depth, reach)
    lifted = forest.lifted(sample)
    for tree in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            own = members.pop(node)
            tries = [draw.normal(size=width)]
            if len(own) > 1:
                pairs = (draw.choice(own, 2, replace=False) for _ in range(3))
                tries = [lifted[a] - lifted[b] for a, b in pairs] + tries
            best, projected = tries[-1] / np.linalg.norm(tries[-1]), None
            spread = -1.0
            for normal in tries[:-1]:
                if (size := np.linalg.norm(normal)) > 0:
                    along = lifted[own] @ (normal / size)
                    if along.std() > spread:
                        spread, best, projected = along.std(), normal / size, along
            projected = lifted[own] @ best if projected is None else projected
            middle = float(np.median(projected)) if len(own) else 0.0
            forest.normals[tree, node], forest.thresholds[tree, node] = best, middle
            members[2 * node + 1], members[2 * node + 2] = own[projected < middle], own[projected >= middle]
    return forest


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, width)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v, key of the vectors that take part: of the most usual length, without null, infinite or undefined
    components, and not zero; ``key`` is the same for equal vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    usual = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).select("n").first()
    return fine.where(F.size("v") == (usual["n"] if usual else 0)).withColumn("key", F.xxhash64("v"))


def _dealt(classes: DataFrame, forest: Forest, width: int, probes: int | None) -> DataFrame:
    """tree, leaf, key, v: of each vector the leaves it lies in, or for queries those that are searched."""
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch.slice(begin, 512)
                matrix = _matrix(part["v"], width)
                if probes is None:
                    leaf = shared.value.leaves(matrix)
                    trees, rows, leaf = np.repeat(np.arange(len(leaf)), len(matrix)), \
                        np.tile(np.arange(len(matrix)), len(leaf)), leaf.ravel()
                else:
                    found = [shared.value.probe(x, probes) for x in matrix]
                    rows = np.repeat(np.arange(len(matrix)), [len(x) for x in found])
                    trees, leaf = np.array([y for x in found for y in x], np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trees.astype(np.int32)), pa.array(leaf.astype(np.int32)), part["key"].take(pa.array(rows)),
                     part["low"].take(pa.array(rows)), part["v"].take(pa.array(rows))],
                    names=["tree", "leaf", "key", "low", "v"])

    return classes.select("key", "low", "v").mapInArrow(deal, "tree int, leaf int, key long, low long, v array<double>")


def _candidates(inside: DataFrame, asked: DataFrame, width: int, most: int) -> DataFrame:
    """asking, key, low, score: the best ``most`` vectors of each searched leaf for each query, by matrix products.

    Leaves and their queries are cut into parts of bounded size, and every part of the one meets every part of the
    other.
    """
    def parts(rows: DataFrame, name: str, size: int) -> DataFrame:
        return rows.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    cells = stored(parts(inside, "parts", GROUP_VECTORS).join(parts(asked, "shares", GROUP_QUERIES), ["tree", "leaf"]),
                   "cells")

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64("key"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = inside.join(cells, ["tree", "leaf"]).withColumn("part", own("parts")).withColumn("share", every("shares"))
    right = asked.join(cells, ["tree", "leaf"]).withColumn("share", own("shares")).withColumn("part", every("parts"))

    def match(near: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)],
                                       [np.zeros(0)]]
        if len(near) and len(queries):
            vectors = _matrix(near["v"].combine_chunks(), width)
            keys, lows = near["key"].to_numpy(), near["low"].to_numpy()
            asking = queries["key"].to_numpy()
            wanted, across = _matrix(queries["v"].combine_chunks(), width), np.ascontiguousarray(vectors.T)
            for begin in range(0, len(wanted), 256):
                # components are added in their order, so these are the doubles that the exact ranking finds
                scores = np.zeros((len(wanted[begin:begin + 256]), len(vectors)))
                for k in range(width):
                    scores += wanted[begin:begin + 256, k, None] * across[k]
                for row, line in enumerate(scores, begin):
                    best = np.arange(len(line))
                    if len(line) > most:
                        best = np.flatnonzero(line >= np.partition(line, -most)[-most])
                        best = best[np.lexsort((lows[best], -line[best]))[:most]]
                    for column, values in zip(out, (np.full(len(best), asking[row]), keys[best], lows[best], line[best]),
                                              strict=True):
                        column.append(values)
        return pa.table([pa.array(np.concatenate(x)) for x in out], names=["asking", "key", "low", "score"])

    columns = [*CELL, "key", "low", "v"]
    return left.select(columns).groupBy(*CELL).cogroup(right.select(columns).groupBy(*CELL)).applyInArrow(
        match, "asking long, key long, low long, score double")


def nearest(vectors: DataFrame, asks: Column, k: int = 20, trees: int = 8, depth: int = 7, probes: int = 176,
            sample: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector for which ``asks`` holds.

    The trees are fitted on at most ``sample`` different vectors, chosen by a hash; then every vector is put into its
    leaf of every tree. Queries search the ``probes`` most promising leaves of all trees, and what they find is
    ranked again by the exact inner product, added up in double precision in the order of the components. The
    defaults find over nine tenths of the true neighbours even of vectors without any structure; vectors that form
    clusters need fewer probes. Equal vectors are one in the index, so a group of copies costs one comparison; of its
    members only the k + 1 smallest ids can be among the nearest. Ties go to the smaller vec_id. A query with fewer
    candidates than ``k`` gets those it finds. Rows that repeat a vec_id and its vector count once. Vectors of
    another length than the most usual one take no part. ``asks`` may use vec_id only.
    """
    rows = stored(valid_vectors(vectors).dropDuplicates(["vec_id", "key"]), "vectors")
    classes = stored(rows.groupBy("key").agg(F.min("vec_id").alias("low"), F.max(asks).alias("asks")).join(
        rows.dropDuplicates(["key"]).select("key", "v"), "key"), "classes")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = classes.agg(F.max(length).alias("reach"), F.max(F.size("v")).alias("width")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if facts["width"] is None:
        return vectors.sparkSession.createDataFrame([], empty)
    width = facts["width"]
    chosen = classes.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(sample).select("v").toArrow()
    forest = plant(_matrix(chosen["v"].combine_chunks(), width), trees, depth, facts["reach"])
    inside = _dealt(classes, forest, width, None)
    asked = _dealt(classes.where("asks"), forest, width, probes)
    found = _candidates(inside, asked, width, k + 1).groupBy("asking", "key", "low").agg(F.max("score").alias("score"))
    order = Window.partitionBy("asking").orderBy(F.desc("score"), "low")
    top = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("asking", "key")
    own = classes.select("key", "v")
    exact = F.aggregate(F.zip_with("asking_v", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = top.join(own.toDF("asking", "asking_v"), "asking").join(own, "key").select("asking", "key",
                                                                                       exact.alias("score"))
    by_id = Window.partitionBy("key").orderBy("vec_id")
    members = rows.select("key", "vec_id").withColumn("place", F.row_number().over(by_id)).where(
        F.col("place") <= k + 1).select("key", "vec_id")
    by_score = Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id")
    lists = stored(scored.join(members, "key").withColumn("place", F.row_number().over(by_score)).where(
        F.col("place") <= k + 1).select("asking", "vec_id", "score"), "nearest")
    queries = rows.where(asks).select(F.col("vec_id").alias("query_id"), F.col("key").alias("asking"))
    ranked = queries.join(lists, "asking").where("vec_id <> query_id").withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
