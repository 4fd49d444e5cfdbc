"""A training corpus from the table of documents: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm import mixing, near_copies, packing, repeats, toxicity
from trustframe.llm.common import Bitmap, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic; labels come from the table beside the documents.

    Null and empty texts are scored like any other, repeated rows and rows without a doc_id each on their own.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, labels, carry=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, once if its row is repeated.

    Rows of one doc_id belong to one group; those with different texts or columns are different documents and stay or
    go together. Rows without a doc_id stay, empty texts too, and an empty table gives an empty one.
    """
    rows = _documents(docs)
    gone = stored(near_copies.near_copies(docs).where("NOT kept").select("doc_id").distinct(), "gone")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    marks = Bitmap(gone.unionByName(repeated).select(F.col("doc_id").cast("long")))
    seen = marks.rows(rows, "doc_id").join(gone, "doc_id", "left_anti")
    return marks.rows(rows, "doc_id", inside=False).unionByName(seen.dropDuplicates())


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents have too; n_chars follows the text.

    A document of which nothing is left stays as an empty text, so that no document disappears here.
    """
    cut = repeats.remove_repeats(docs, carry=("lang", "source", "n_chars"))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the proportions of the target weights, some of them twice.

    A null source is a source of its own; documents without words are kept once; repeated rows are
    drawn each on their own; an empty table gives an empty one.
    """
    return mixing.mixed_documents(_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens.

    A null or empty text is a piece of its end token; repeated rows are packed each on their own.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Model scores, sampled mixes and token ids can't be written in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
CHECK_SQL: dict[str, str] = {}
