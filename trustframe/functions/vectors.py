"""Vector columns: cosine, the hash embedding and the hook for a caller's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import text


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(left: Column, right: Column, left_norm: Column, right_norm: Column) -> Column:
    """Cosine from vectors and their norms; a zero vector is similar to nothing."""
    product = left_norm * right_norm
    return F.when(product > 0, dot(left, right) / product).otherwise(F.lit(0.0))


def token_dimension(token: Column, dimensions: int) -> Column:
    head = F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(dimensions)).cast("int")


def hash_embedding(col: Column, dimensions: int = 128) -> Column:
    """Offline embedding: every word counts in one hashed dimension, then unit length.

    Computed inside the row, so no shuffle takes place. Use ``hash_embedding_entries`` for long
    texts, where the sparse form is smaller.
    """
    dims = F.transform(text.space_words(col), lambda w: token_dimension(w, dimensions))
    counts = text.let(dims, lambda hit: F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda i: F.size(F.filter(hit, lambda d: d == i)).cast("double")))

    def scaled(vector: Column) -> Column:
        return text.let(norm(vector), lambda n: F.transform(
            vector, lambda x: F.when(n > 0, x / n).otherwise(x)))

    return text.let(counts, scaled)


def hash_embedding_entries(df: DataFrame, key: str, col: str, dimensions: int = 128) -> DataFrame:
    """The same embedding in sparse form, one row per (key, dim), for long texts."""
    hits = (text.each(df, [key], text.space_words(F.col(col)), "word")
            .select(key, token_dimension(F.col("word"), dimensions).alias("dim"))
            .groupBy(key, "dim").agg(F.count("*").alias("n")))
    length = hits.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return hits.join(length, key).select(key, "dim", (F.col("n") / F.col("length")).alias("weight"))


def embed_with(df: DataFrame, column: str, encode: Callable[[list[str]], list[list[float]]],
               out: str = "embedding") -> DataFrame:
    """Run a caller's ``encode(texts) -> vectors`` in Arrow batches next to the data."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(encode(batch.fillna("").tolist()))

    return df.withColumn(out, run(F.col(column)))
