"""Structured Streaming jobs: sliding rate, trace windows, ledger, document sync, scan and budget.

What jobs remember lies in keyed state (documents seen, requests of a slot, money spent) or, where a
whole batch is computed with it, in tables with one partition per micro-batch. A batch that is run
again overwrites its own partition. Either way a batch costs what it holds and what it touches, not
what came before: state is looked up by key, requests are pruned to the window's slots, and heads
are read from the batch before only. Rows of a hot key are sliced inside their batch, and only the
slices' totals meet the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trustframe.operators import audit, extract, guard, ordered


# ---------------------------------------------------------------------------- tables by batch

def table_before(spark: SparkSession, path: str, ddl: str, batch_id: int) -> DataFrame:
    """Rows that the batches before ``batch_id`` wrote; every batch writes, if only an empty table."""
    if batch_id == 0:
        return spark.createDataFrame([], f"{ddl}, batch_id bigint")
    return spark.read.schema(f"{ddl}, batch_id bigint").parquet(path).filter(F.col("batch_id") < batch_id)


def batch_before(spark: SparkSession, path: str, ddl: str, batch_id: int) -> DataFrame:
    """Rows that the batch right before ``batch_id`` wrote; batches of one checkpoint are numbered without gaps."""
    if batch_id == 0:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(f"{path}/batch_id={batch_id - 1}")


def write_batch(frame: DataFrame, path: str, batch_id: int) -> None:
    frame.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, so it isn't bounded by an executor's memory."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, f"org.apache.spark.sql.execution.streaming.{kind}")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def start(frame: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    with state_on_disk(frame.sparkSession):
        return (frame.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())


def start_append(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    with state_on_disk(frame.sparkSession):
        return (frame.writeStream.format("parquet").outputMode("append").option("path", path)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# ---------------------------------------------------------------------------- windows

@F.pandas_udf(T.ArrayType(T.LongType()))
def _counts(at: pd.Series, every: pd.Series, span: pd.Series) -> pd.Series:
    """Entries of ``every`` in (t - span, t] for each t of ``at``; both arrays are sorted."""
    return pd.Series([
        np.searchsorted(e, a, side="right") - np.searchsorted(e, np.asarray(a) - s, side="right")
        for a, e, s in zip(at, every, span)])


def rate_stream(events: DataFrame, key: str, event_id: str, ts: str, seconds: int = 60,
                delay: str = "10 minutes") -> DataFrame:
    """Requests of the key in the last ``seconds`` at every request, in event time.

    Each request goes to its own time slot and, as context, to the next one. A slot then holds all
    it needs and is counted when the watermark passes it, so one key's load is spread over slots
    and state lives for two slots only. A slot of one key must fit a task; ``rate_job`` has no such
    limit.
    """
    at = F.col(ts).cast("timestamp")
    slots = events.select(
        F.col(key), F.col(event_id), F.unix_micros(at).alias("micros"), F.explode(F.array(
            F.struct(at.alias("slot_ts"), F.lit(True).alias("own")),
            F.struct((at + F.expr(f"INTERVAL {seconds} SECOND")).alias("slot_ts"), F.lit(False).alias("own")))).alias("s"))
    slots = slots.select(key, event_id, "micros", "s.*").withWatermark("slot_ts", delay)
    groups = slots.groupBy(F.window("slot_ts", f"{seconds} seconds"), key).agg(
        F.array_sort(F.collect_list("micros")).alias("every"),
        F.array_sort(F.collect_list(F.when(F.col("own"), F.struct("micros", event_id)))).alias("mine"))
    counted = groups.withColumn("in_window", _counts(
        F.transform("mine", lambda m: m["micros"]), "every", F.lit(seconds * 1_000_000)))
    rows = counted.select(key, F.explode(F.arrays_zip("mine", "in_window")).alias("x"))
    return rows.select(key, F.col(f"x.mine.{event_id}").alias(event_id), F.col("x.in_window").alias("in_window"))


class Recent(StatefulProcessor):
    """Counts requests of a bucket of keys in a slot as they come; a list has the times of those that came before.

    A timer clears the list once the watermark has passed the slot.
    """

    def __init__(self, micros: int, key_type: str):
        self.micros, self.key_type = micros, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", f"key {self.key_type}, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True)
        fresh = list(zip(frame["key"].tolist(), frame["micros"].tolist(), strict=True))
        known = [tuple(x) for x in self.times.get()] if self.times.exists() else []
        self.times.appendList(fresh)
        self.handle.registerTimer((int(key[1]) + 1) * self.micros // 1000)
        # a key's times lie in the two slots that end with this one; each key gets a range of its own for them
        codes, _ = pd.factorize(pd.Series([x[0] for x in fresh + known]))
        since = (int(key[1]) - 1) * self.micros
        places = codes.astype(np.int64) * (2 * self.micros) + (np.array([x[1] for x in fresh + known], np.int64) - since)
        own = frame["own"].to_numpy(bool)
        at, every = places[:len(fresh)][own], np.sort(places)
        counts = np.searchsorted(every, at, "right") - np.searchsorted(every, at - self.micros, "right")
        yield pd.DataFrame({"key": frame["key"][own], "id": frame["id"][own], "in_window": counts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_on_arrival(events: DataFrame, key: str, event_id: str, ts: str, seconds: int = 60,
                    delay: str = "10 minutes", buckets: int = 32) -> DataFrame:
    """Requests of the key in the last ``seconds`` at every request, counted in the batch in which it comes.

    State is kept per slot of ``seconds`` and bucket of keys; each request goes to its slot and, as context, to the next
    one, so a key's load is spread over its slots and a batch reads only the slots it touches. Keys share ``buckets``
    per slot, since each state that a batch touches costs calls of its own; a bucket of two slots must fit a task. Slots
    are dropped when the watermark passes them; requests that come after that start from an empty slot. A request counts
    those of its own batch and of earlier ones, as ``rate_job`` does. Rows without key or time aren't counted.
    """
    types = dict(events.dtypes)
    at, micros = F.col(ts).cast("timestamp"), seconds * 1_000_000
    place = F.floor(F.unix_micros(at) / micros)
    slots = events.where(at.isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(event_id).alias("id"), F.unix_micros(at).alias("micros"), at.alias("at"),
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"),
        F.explode(F.array(F.struct(place.alias("slot"), F.lit(True).alias("own")),
                          F.struct((place + 1).alias("slot"), F.lit(False).alias("own")))).alias("s"))
    counted = slots.select("key", "id", "micros", "at", "bucket", "s.*").withWatermark("at", delay).groupBy(
        "bucket", "slot").transformWithStateInPandas(
        Recent(micros, types[key]), f"key {types[key]}, id {types[event_id]}, in_window bigint", "Append", "EventTime")
    return counted.select(F.col("key").alias(key), F.col("id").alias(event_id), "in_window")


def trace_windows(events: DataFrame, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Event counts, latency and abstentions per stage in tumbling windows."""
    decision = F.col("attributes")["decision"]
    return (events.withWatermark("timestamp", delay).groupBy(F.window("timestamp", length), "stage").agg(
        F.count("*").alias("events"), F.sum("duration_ms").alias("latency_total"),
        F.count(decision).alias("decisions"), F.count_if(decision == "UNDECIDABLE").alias("abstentions"))
        .select(F.col("window.start").alias("window_start"), "stage", "events", "latency_total", "decisions", "abstentions"))


# ---------------------------------------------------------------------------- scan

def shield_stream(messages: DataFrame, column: str, rules: list[guard.Rule] | None = None) -> DataFrame:
    """The input scan on a stream; it is a projection, so nothing is kept."""
    if not rules:
        return guard.shield(messages, column)
    return guard.shield(guard.scan(messages, column, rules), column, violations="violations")


# ---------------------------------------------------------------------------- jobs with earlier results

def rate_job(events: DataFrame, path: str, checkpoint: str, key: str, event_id: str, ts: str, seconds: int = 60,
             key_type: str = "bigint", id_type: str = "bigint") -> StreamingQuery:
    """Requests of the key in the last ``seconds``, counted when they arrive.

    A batch is counted together with the stored requests of the window before it, as running sums
    that are sliced for a hot key. Stored requests are partitioned by slots of ``seconds``, and only
    the slots that the batch's window reaches are read. Requests that come late are counted with what
    is known by then.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ddl = f"{key} {key_type}, {event_id} {id_type}, at timestamp, slot bigint"
        at = F.col(ts).cast("timestamp")
        mine = batch.select(key, event_id, at.alias("at"), F.floor(F.unix_micros(at) / (seconds * 1_000_000)).alias("slot"))
        first = mine.agg(F.min("at").alias("at")).first()["at"]
        if first is None:
            mine.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/seen/batch_id={batch_id}")
            return
        since = F.lit(first) - F.expr(f"INTERVAL {seconds} SECOND")
        slot = F.floor(F.unix_micros(since) / (seconds * 1_000_000))
        before = table_before(spark, f"{path}/seen", ddl, batch_id).filter((F.col("slot") >= slot) & (F.col("at") > since))
        both = mine.withColumn("fresh", F.lit(True)).unionByName(before.drop("batch_id").withColumn("fresh", F.lit(False)))
        counted = ordered.rate_counts(both, key, "at", seconds).filter("fresh")
        write_batch(counted.select(key, event_id, "in_window"), f"{path}/counts", batch_id)
        mine.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/seen/batch_id={batch_id}")

    return start(events, each, checkpoint)


HEADS = "tenant_id string, next_seq bigint, next_segment bigint, next_anchor string"


def ledger_job(decisions: DataFrame, path: str, checkpoint: str, segment: int = audit.SEGMENT) -> StreamingQuery:
    """Append decisions to each tenant's chain; ``path`` holds the tables rows and heads.

    Heads are written for all tenants with every batch, so a batch reads those of the one before it only.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = batch_before(spark, f"{path}/heads", HEADS, batch_id)
        rows = audit.append(batch, last, segment)
        write_batch(rows, f"{path}/rows", batch_id)
        written = spark.read.parquet(f"{path}/rows/batch_id={batch_id}")
        slim = written.select("tenant_id", "segment", "seq", "content_hash")
        ends = written.groupBy("tenant_id").agg((F.max("seq") + 1).alias("next_seq"), (F.max("segment") + 1).alias("next_segment"))
        anchors = audit.segment_anchors(slim, last).groupBy("tenant_id").agg(F.max_by("next_anchor", "segment").alias("next_anchor"))
        moved = ends.join(anchors, "tenant_id")
        write_batch(moved.unionByName(last.join(moved, "tenant_id", "left_anti")), f"{path}/heads", batch_id)

    return start(decisions, each, checkpoint)


def sync_job(documents: DataFrame, path: str, checkpoint: str, key: str, key_type: str = "bigint",
             column: str = "text", seen_at: str | None = None, delay: str = "7 days") -> StreamingQuery:
    """Extract facts of documents not seen before into the table facts below ``path``.

    The keys seen are state, looked up by key. With ``seen_at``, a time column, a key is forgotten when the watermark
    is ``delay`` past it, which bounds the state; without it every key is kept. ``key_type`` is no longer needed.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(extract.pattern_facts(batch, [key], column), f"{path}/facts", batch_id)

    if seen_at is None:
        return start(documents.dropDuplicates([key]), each, checkpoint)
    return start(documents.withWatermark(seen_at, delay).dropDuplicatesWithinWatermark([key]), each, checkpoint)


class Carry(StatefulProcessor):
    """What a run had spent before each of its batches: one value, advanced in the order of batches.

    Totals of a batch that was written again are passed over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spent", "amount double, batch_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spent, last = self.state.get() if self.state.exists() else (0.0, -1)
        out = []
        for batch_id, amount in sorted(pd.concat(list(rows))[["of_batch", "amount"]].itertuples(index=False)):
            if batch_id > last:
                out.append((key[0], batch_id, spent))
                spent, last = spent + amount, batch_id
        self.state.update((float(spent), int(last)))
        yield pd.DataFrame(out, columns=["run", "of_batch", "earlier"])

    def close(self) -> None:
        pass


def budget_job(costs: DataFrame, path: str, checkpoint: str, run: str, order: list[str], cost: str, budget: float,
               run_type: str = "string") -> StreamingQuery:
    """Keep results of a run while what was spent before them is within budget.

    A first query adds up costs inside each batch, in slices that a hot run is spread over, and writes one total per
    run. A second one turns the totals into what was spent before each batch, one value of state per run, and keeps
    rows. It is started when the first has read all that is there; both go on from their checkpoints.
    """
    spark = costs.sparkSession

    def add_up(batch: DataFrame, batch_id: int) -> None:
        rows = ordered.running(batch, [run], order, {"_before": ordered.Running("sum", F.col(cost), before=True)})
        write_batch(rows, f"{path}/rows", batch_id)
        totals = batch.groupBy(F.col(run).alias("run")).agg(F.sum(F.col(cost).cast("double")).alias("amount"))
        # under another folder name than batch_id, which would make it a partition column of the stream
        totals.withColumn("of_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{path}/totals/{batch_id}")

    def keep(carries: DataFrame, batch_id: int) -> None:
        reach = carries.agg(F.min("of_batch"), F.max("of_batch")).first()
        if reach[0] is None:
            return
        rows = spark.read.parquet(f"{path}/rows").where(F.col("batch_id").between(*reach))
        joined = rows.join(carries.select(F.col("run").alias(run), F.col("of_batch").alias("batch_id"), "earlier"),
                           [run, "batch_id"])
        total = F.col("earlier") + F.coalesce("_before", F.lit(0.0))
        kept = joined.withColumn("spent_before", total).filter(F.col("spent_before") <= budget)
        write_batch(kept.drop("earlier", "_before", "batch_id"), f"{path}/kept", batch_id)

    start(costs, add_up, f"{checkpoint}/rows").awaitTermination()
    totals = spark.readStream.schema(f"run {run_type}, amount double, of_batch bigint").parquet(f"{path}/totals/*")
    carries = totals.groupBy("run").transformWithStateInPandas(
        Carry(), f"run {run_type}, of_batch bigint, earlier double", "Append", "None")
    return start(carries, keep, f"{checkpoint}/kept")
