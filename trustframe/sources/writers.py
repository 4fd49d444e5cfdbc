"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(frame: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    frame.write.mode(mode).format(fmt).save(path)


def write_curve(curve: DataFrame, path: str) -> None:
    """A threshold curve as CSV in threshold order; it has one row per grid point."""
    curve.orderBy("threshold").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Ledger rows by tenant and day. A day of a large tenant is written by many tasks."""
    rows.write.mode("append").partitionBy("tenant_id", "date").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_splits(samples: DataFrame, path: str) -> None:
    """Samples by language and split; samples without a split are test samples."""
    split = F.coalesce(F.col("metadata")["split"], F.lit("test"))
    samples.withColumn("split", split).write.mode("overwrite").partitionBy("lang", "split").json(path)


def save_facts(facts: DataFrame, path: str) -> None:
    facts.write.mode("overwrite").parquet(path)


def load_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("append").partitionBy("snapshot_id").parquet(path)
