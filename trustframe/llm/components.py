"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.llm.common import released, stored

#: Links that a task holds at a time.
HELD = 1 << 18


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (u, v) that aren't the smallest of their component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (above := root[root])).any():
            root = above
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[tied], nodes[root[tied]]


def _contracted(links: DataFrame, held: int) -> DataFrame:
    """Links (u, v) of the same components, at most one per node and task, v the smaller one.

    A task takes its links some at a time and ties them to what it has; when it holds ``held`` tied nodes, they go on.
    """
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.zeros(0, np.int64)
        for batch in released(batches):
            for part in pa.Table.from_batches([batch]).to_batches(max_chunksize=held):
                u, v = _least(np.append(u, part["u"].to_numpy()), np.append(v, part["v"].to_numpy()))
                if len(u) >= held:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    u = v = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return links.mapInArrow(contract, "u long, v long")


def components(links: DataFrame, held: int = HELD) -> DataFrame:
    """node, root for each node of ``links`` (a, b): the smallest node that can be reached from it.

    First each task replaces the links it reads by as few as tie the same nodes; there is a task for about ``held``
    links. What several tasks leave is joined in rounds. They alternate two steps on the links (u, v): each node's
    larger neighbours, then its smaller ones and itself, are tied to the smallest node among them. Every round
    shortens paths, so the number of rounds grows with the logarithm of the longest path. They end when every node is
    tied to one node that is tied to no other, which another round would not change. Each step is an aggregation with
    partial sums and a join; no neighbourhood is gathered in one place. Null ids are no nodes, and without links
    there are none.
    """
    pairs = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    written = stored(pairs, "pairs")
    tasks = max(1, -(-written.count() // held))
    edges = stored(_contracted(written.coalesce(tasks), held), "edges")
    while tasks > 1 and not _tied(edges):
        # large step: what is larger than u goes to the smallest node near u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small step: what is smaller than u, and u itself, go to the smallest of them
        edges = stored(large.where("u <> v").distinct(), "edges")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
                                              .alias("u"), F.col("m").alias("v"))
        edges = stored(small.where("u <> v").distinct(), "edges")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _tied(edges: DataFrame) -> bool:
    """Whether every node is tied to one node that is tied to no other."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("tied"), F.lit(1).alias("root")))
    seen = ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("root").alias("root"))
    return not seen.agg(F.count_if((F.col("tied") > 1) | ((F.col("tied") > 0) & (F.col("root") > 0)))).first()[0]
