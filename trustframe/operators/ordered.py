"""Ordered computations that survive a hot key.

A plain window puts each key into one task. Here the rows are range-partitioned on (keys, order), so
one key spreads over many slices; each slice is computed on its own, and the carry from earlier
slices, one row per (key, slice), is added by an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.functions.session import cut_lineage

SLICE = "_slice"


@dataclass
class Running:
    """One running column: ``kind`` is sum, max, count or previous; ``before`` leaves out the row."""

    kind: str
    value: Column | None = None
    before: bool = False


def running(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Running],
            slices: int | None = None) -> DataFrame:
    """Add running columns over ``order`` within ``keys``. ``order`` must be unique per key.

    ``slices`` defaults to the session's number of shuffle partitions.
    """
    values = {n: (F.lit(1) if r.value is None else r.value) for n, r in columns.items()}
    df = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn(SLICE, F.spark_partition_id()))
    within = [*keys, SLICE]
    window = Window.partitionBy(*within).orderBy(*order)
    local = cut.select("*", *[_local(c, r, window).alias(f"_l_{c}") for c, r in columns.items()])
    totals = cut.groupBy(*within).agg(*[_total(c, r, order).alias(f"_t_{c}") for c, r in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    at_slice = Window.partitionBy(*keys).orderBy(SLICE)
    carry = totals.select(*within, *[
        (F.lag(f"_t_{c}").over(at_slice) if r.kind == "previous" else
         F.max(f"_t_{c}").over(earlier) if r.kind == "max" else F.sum(f"_t_{c}").over(earlier)
         ).alias(f"_c_{c}") for c, r in columns.items()])
    joined = local.join(carry, within)
    out = joined.select("*", *[_combine(c, r).alias(c) for c, r in columns.items()])
    helpers = [f"_{p}_{c}" for c in columns for p in ("v", "l", "c")]
    return out.drop(SLICE, *helpers)


def _local(name: str, item: Running, window) -> Column:
    value = F.col(f"_v_{name}")
    if item.kind == "previous":
        return F.lag(value).over(window)
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if item.before else 0)
    return (F.max(value) if item.kind == "max" else F.sum(value)).over(frame)


def _total(name: str, item: Running, order: list[str]) -> Column:
    value = F.col(f"_v_{name}")
    if item.kind == "previous":
        return F.max_by(F.struct(value), F.struct(*order))[f"_v_{name}"]
    return F.max(value) if item.kind == "max" else F.sum(value)


def _combine(name: str, item: Running) -> Column:
    own, carried = F.col(f"_l_{name}"), F.col(f"_c_{name}")
    if item.kind == "previous":
        return F.coalesce(own, carried)
    if item.kind == "max":
        return F.greatest(own, carried)
    return F.coalesce(own + carried, own, carried)


def order_statistic(df: DataFrame, column: str, position: Column | int) -> DataFrame:
    """One row: the value at 1-based ``position`` of the sorted column. Exact.

    Equal values are counted first, so ties never pile up, and the cumulative count is a running
    sum over the distinct values.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    cumulative = running(counts, [], [column], {"_upto": Running("sum", F.col("_n"))})
    place = F.lit(position) if isinstance(position, int) else position
    return cumulative.filter(F.col("_upto") >= place).agg(F.min(column).alias(column))


def rate_counts(df: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Add ``in_window``: rows of the key in the last ``seconds``, a row that old being out.

    Every row counts +1 when it comes and -1 when it leaves; the running sum of these changes is
    the size of the sliding window. Changes at one instant are merged before the shuffle.
    """
    leaves = F.expr(f"{ts} + INTERVAL {seconds} SECOND")
    changes = (df.select(key, F.explode(F.array(
        F.struct(F.col(ts).alias("at"), F.lit(1).alias("change")),
        F.struct(leaves.alias("at"), F.lit(-1).alias("change")))).alias("c"))
        .groupBy(key, F.col("c.at").alias("at")).agg(F.sum("c.change").alias("change")))
    sizes = running(changes, [key], ["at"], {"in_window": Running("sum", F.col("change"))})
    return df.join(sizes.select(key, F.col("at").alias(ts), "in_window"), [key, ts])
