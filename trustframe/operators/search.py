"""Exact vector search of a stated set of cases over a whole corpus, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.functions import vectors
from trustframe.functions.session import cut_lineage
from trustframe.operators import rag

#: Rows of a block on either side, cells that are scored at a time, and pairs of them that are scored again at a time.
BLOCK_ROWS = 8192
CELLS = 1 << 20
PAIRS = 1 << 14

#: More than the product and the rounding to ``rag.SCORE_DIGITS`` can be apart.
NEAR = 1e-8


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), size)


def scores(queries: np.ndarray, query_norms: np.ndarray, documents: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines of the rows' pairs, rounded. Components are added in their order, as ``vectors.cosine`` does in a row."""
    total = np.zeros(len(queries))
    for k in range(queries.shape[1]):
        total += queries[:, k] * documents[:, k]
    length = query_norms * norms
    return np.round(np.divide(total, length, out=np.zeros_like(total), where=length > 0), rag.SCORE_DIGITS)


def _unit(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0)


def best_in_block(k: int):
    """Arrow function of a block of cases and a block of documents: the block's ``k`` best of each case, and how many
    documents go before the case's best relevant one.

    A matrix product gives all cosines up to ``NEAR``; those that it cannot tell from the k-th, or from the best
    relevant one, are computed as ``scores`` does before they are compared."""
    def run(cases: pa.Table, documents: pa.Table) -> pa.Table:
        if not len(cases) or not len(documents):
            return RESULT.empty_table()
        size = cases["size"][0].as_py()
        ids = documents["document_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, norms = ids[order], documents["norm"].to_numpy()[order]
        matrix, wanted = _matrix(documents["vector"], size)[order], _matrix(cases["vector"], size)
        own, best_id = (cases[c].to_numpy(zero_copy_only=False) for c in ("own_id", "best_id"))
        case_ids, best = cases["case_id"].to_numpy(), cases["best_score"].to_numpy(zero_copy_only=False)
        query_norms = cases["norm"].to_numpy()
        units = _unit(matrix, norms).T
        found: list[tuple[np.ndarray, ...]] = []

        def exact(row: np.ndarray, column: np.ndarray) -> np.ndarray:
            pieces = [slice(x, x + PAIRS) for x in range(0, len(row), PAIRS)]
            return np.concatenate([scores(wanted[row[x]], query_norms[row[x]], matrix[column[x]], norms[column[x]])
                                   for x in pieces] or [np.zeros(0)])

        step = max(1, CELLS // len(ids))
        for at in range(0, len(case_ids), step):
            part = slice(at, at + step)
            table = _unit(wanted[part], query_norms[part]) @ units
            table[ids[None, :] == own[part, None]] = -np.inf
            ahead = (table > best[part, None] + NEAR).sum(axis=1)
            row, column = np.nonzero(np.abs(table - best[part, None]) <= NEAR)
            score = exact(row + at, column)
            passed = (score > best[at + row]) | ((score == best[at + row]) & (ids[column] < best_id[at + row]))
            ahead += np.bincount(row[passed], minlength=len(ahead))
            if len(ids) > k:  # everything that may tie with the k-th stays until the ids are compared
                listed = table >= np.partition(table, -k, axis=1)[:, -k, None] - NEAR
                listed &= table > -np.inf
            else:
                listed = table > -np.inf
            row, column = np.nonzero(listed)
            score = exact(row + at, column)
            order = np.lexsort((ids[column], -score, row))
            row, column, score = row[order], column[order], score[order]
            first = np.searchsorted(row, row)  # where the case's documents begin
            top = np.arange(len(row)) - first < k
            row, column, score = row[top], column[top], score[top]
            here = len(ahead)
            found.append((np.append(case_ids[at + row], case_ids[part]), np.append(ids[column], np.full(here, -1)),
                          np.append(score, np.zeros(here)), np.append(np.zeros(len(row), np.int64), ahead),
                          np.append(np.ones(len(row), bool), np.zeros(here, bool))))
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], schema=RESULT)

    return run


RESULT = pa.schema([("case_id", pa.int64()), ("document_id", pa.int64()), ("score", pa.float64()),
                    ("ahead", pa.int64()), ("listed", pa.bool_())])


def _blocks(df: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    """The rows with their block; blocks have about ``rows`` rows, whatever the keys are."""
    count = max(1, -(-df.count() // rows))
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(count)).cast("int")), count


def _prepared(df: DataFrame, *columns: str) -> DataFrame:
    vector = F.col("vector").cast("array<double>")
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return df.where(F.col("vector").isNotNull()).where(whole & (F.size("vector") > 0)).select(
        *columns, vector.alias("vector"), F.size("vector").alias("size"), vectors.norm(vector).alias("norm"))


def search(cases: DataFrame, documents: DataFrame, k: int, judged: DataFrame | None = None,
           block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(top, first): the ``k`` nearest of all documents by cosine, and the rank of the first relevant one.

    ``cases``: case_id, vector and, if a case is itself a document, own_id, which it doesn't find. ``documents``:
    document_id, vector. ``judged``: case_id, document_id of relevant pairs; without it nothing is relevant. Ids are
    whole numbers from 0. ``top`` has case_id, document_id, score, relevant, rank, ``first`` case_id, first_rank.

    Cases and documents are dealt into blocks of bounded size, and each pair of blocks is scored as a matrix; of it
    only the best per case and a count leave the task. Ranks follow the rounded score, ties go to the smaller id.
    Null, empty and non-finite vectors take no part; a zero vector is alike to nothing (score 0). Only vectors of one
    length meet.
    """
    if "own_id" not in cases.columns:
        cases = cases.withColumn("own_id", F.lit(-1))
    asked = cut_lineage(_prepared(cases, F.col("case_id").cast("long").alias("case_id"),
                                  F.coalesce(F.col("own_id").cast("long"), F.lit(-1)).alias("own_id")))
    corpus = cut_lineage(_prepared(documents, F.col("document_id").cast("long").alias("document_id")))
    if judged is None:
        judged = asked.select("case_id", F.lit(-1).cast("long").alias("document_id")).limit(0)
    judged = cut_lineage(judged.select("case_id", "document_id").distinct())
    pairs = rag.score_pairs(
        judged.join(asked.select("case_id", F.col("vector").alias("query_vector"), F.col("norm").alias("query_norm"),
                                 F.col("size").alias("query_size"), "own_id"), "case_id")
        .join(corpus.select("document_id", F.col("vector").alias("document_vector"),
                            F.col("norm").alias("document_norm"), "size"), "document_id")
        .where("size = query_size AND document_id <> own_id"))
    best = pairs.groupBy("case_id").agg(F.min_by(
        F.struct("score", "document_id"), F.struct((-F.col("score")).alias("s"), "document_id")).alias("best"))
    marked = cut_lineage(asked.join(best, "case_id", "left").select(
        *asked.columns, F.coalesce("best.score", F.lit(float("inf"))).alias("best_score"),
        F.coalesce("best.document_id", F.lit(-1)).alias("best_id")))
    left, n_left = _blocks(marked, "case_id", block_rows)
    right, n_right = _blocks(corpus, "document_id", block_rows)

    def spread(df: DataFrame, name: str, others: int) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        first, second = ("block", "other") if name == "case" else ("other", "block")
        return df.withColumn("other", other).withColumn("cell", F.concat_ws(":", first, second, "size"))

    grid = spread(left, "case", n_right).groupBy("cell").cogroup(spread(right, "document", n_left).groupBy("cell"))
    found = cut_lineage(grid.applyInArrow(best_in_block(k), "case_id long, document_id long, score double, ahead long, "
                                                            "listed boolean"))
    top = rag.top_documents(found.where("listed").select("case_id", "document_id", "score"), k).join(
        judged.withColumn("relevant", F.lit(True)), ["case_id", "document_id"], "left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(False)))
    first = found.where("NOT listed").groupBy("case_id").agg((F.sum("ahead") + 1).alias("first_rank")).join(
        best.select("case_id"), "case_id")
    return top, first


def dense(entries: DataFrame, key: str, dimensions: int = 128) -> DataFrame:
    """Vectors of (key, dim, weight) rows: key, vector; a dimension without a row is 0."""
    weights = F.map_from_entries(F.collect_list(F.struct("dim", "weight")))
    return entries.groupBy(key).agg(weights.alias("w")).select(key, F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(F.try_element_at(F.col("w"), d), F.lit(0.0))
    ).alias("vector"))
