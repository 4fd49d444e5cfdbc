"""Session helpers shared by all jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy per row, in ``spark.trustframe.textPartitions`` partitions if set.

    A table in few files cannot keep all cores busy, so a session over small tables sets the number;
    without it the table is read as its files are split, without a shuffle.
    """
    df = read_table(spark, folder, name)
    partitions = spark.conf.get("spark.trustframe.textPartitions", None)
    return df.repartition(int(partitions)) if partitions else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    falls back to a temporary folder, because there every executor is this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="trustframe-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)
