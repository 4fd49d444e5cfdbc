"""Streaming queries: the tables are replayed as streams and the written result is returned."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trustframe.functions.session import checkpoint_folder, read_table
from trustframe.plans import audit_queries as A
from trustframe.plans.guard_queries import shield_sql
from trustframe.plans.registry import query
from trustframe.streaming import jobs


def place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parquet*")


def in_batches(spark: SparkSession, frame: DataFrame, order: str, parts: int,
               job: Callable[[DataFrame], StreamingQuery]) -> None:
    """Runs a job over a table as a stream of ``parts`` micro-batches, cut by ranges of a column.

    A part may be many files: the job goes on from its checkpoint once the next part has been written, and takes all
    of it in one batch.
    """
    path = place(spark, "replay")
    marks = frame.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10000).alias("m")).first()["m"]
    part = F.aggregate(F.array(*map(F.lit, marks)), F.lit(0), lambda n, m: n + (F.col(order) > m).cast("int"))
    for k in range(parts):
        frame.where(part == k).write.mode("append").parquet(path)
        job(spark.readStream.schema(frame.schema).parquet(path)).awaitTermination()


def appended(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    path = place(spark, name)
    jobs.start_append(frame, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/out")


@query("stream_rate_limit", """
WITH c AS (SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT user_id, event_id, CAST(n AS BIGINT) AS in_window FROM c
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) + INTERVAL 1 HOUR - INTERVAL 2 HOUR""")
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.rate_stream(stream(spark, sf, "events"), "user_id", "event_id", "ts", 3600, "2 hours")
    return appended(spark, out, "rate")


@query("stream_rate_job", """
SELECT user_id, event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM events""")
def stream_rate_job(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "rate-job")
    jobs.rate_job(stream(spark, sf, "events"), path, f"{path}/checkpoint", "user_id", "event_id", "ts", 3600).awaitTermination()
    return spark.read.parquet(f"{path}/counts").select("user_id", "event_id", "in_window")


@query("stream_rate_on_arrival", """
SELECT user_id, event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM events""")
def stream_rate_on_arrival(spark: SparkSession, sf: str) -> DataFrame:
    """Four batches in order of time, so a request's window is complete when it comes."""
    path, events = place(spark, "arrival"), read_table(spark, sf, "events")
    in_batches(spark, events, "ts", 4, lambda replay: jobs.start_append(
        jobs.rate_on_arrival(replay, "user_id", "event_id", "ts", 3600, "2 hours"), f"{path}/out", f"{path}/checkpoint"))
    kind = events.select("user_id", "event_id", F.lit(0).cast("bigint").alias("in_window")).schema
    return spark.read.schema(kind).parquet(f"{path}/out")


@query("stream_trace_window", A.TRACE_SQL + """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, stage, CAST(count(*) AS BIGINT) AS events, round(sum(duration_ms), 6) AS latency_total,
  CAST(count(decision) AS BIGINT) AS decisions, CAST(count(*) FILTER (WHERE decision = 'UNDECIDABLE') AS BIGINT) AS abstentions
FROM t WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2""")
def stream_trace_window(spark: SparkSession, sf: str) -> DataFrame:
    out = appended(spark, jobs.trace_windows(A.trace_frame(stream(spark, sf, "events"))), "trace")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "stage", "events",
                      F.round("latency_total", 6).alias("latency_total"), "decisions", "abstentions")


@query("stream_shield", f"""WITH {shield_sql('conversations', 'conv_id, turn', 'text')}
SELECT conv_id, turn, risk, decision FROM shielded""")
def stream_shield(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.shield_stream(stream(spark, sf, "conversations"), "text")
    return appended(spark, out.select("conv_id", "turn", "risk", "decision"), "shield")


@query("stream_ledger", A.LEDGER_SQL + """
SELECT tenant_id, CAST(segment AS BIGINT) AS segment, CAST(seq AS BIGINT) AS seq, previous_hash, entry_hash FROM chain""")
def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "ledger")
    jobs.ledger_job(A.decision_frame(stream(spark, sf, "events")), path, f"{path}/checkpoint", A.SEGMENT).awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return rows.select("tenant_id", "segment", "seq", "previous_hash", "entry_hash")


@query("stream_doc_sync", A.FACTS_SQL + "SELECT * FROM facts")
def stream_doc_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches; a fifth of the documents come again in the batch after theirs."""
    path, docs = place(spark, "sync"), read_table(spark, sf, "documents")
    step = docs.agg(F.ceil(F.max("doc_id") / 3)).first()[0]
    again = docs.where("doc_id % 5 = 0").withColumn("comes", F.col("doc_id") + step)
    in_batches(spark, docs.withColumn("comes", F.col("doc_id")).unionByName(again), "comes", 3,
               lambda replay: jobs.sync_job(replay, path, f"{path}/checkpoint", "doc_id"))
    return spark.read.parquet(f"{path}/facts").select("doc_id", "pos", "content", "fact_type", "confidence")


@query("stream_budget", """
WITH c AS (SELECT event_id, user_id, coalesce(sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events)
SELECT event_id, user_id, spent::DOUBLE AS spent_before FROM c WHERE spent <= 50000""")
def stream_budget(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "budget")
    cents = F.round(F.col("value") * 100).alias("cents")
    in_batches(spark, read_table(spark, sf, "events"), "event_id", 3, lambda replay: jobs.budget_job(
        replay.select("event_id", "user_id", cents), path, f"{path}/checkpoint", "user_id", ["event_id"], "cents", 50000.0,
        "bigint"))
    return spark.read.parquet(f"{path}/kept").select("event_id", "user_id", "spent_before")
