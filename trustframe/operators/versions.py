"""Versioned tables: diffs, upserts, snapshots, rollback, version numbers and the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustframe.operators.ordered import Running, running


def diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Added, removed and updated rows between two versions, with the columns before and after.

    A key may have several rows in a version, such as conflicting facts; the sets of rows are
    compared. A key that lost one row and got one is updated; otherwise each row that came or went
    is listed. Both versions are tagged and grouped: no outer join of two shuffled sides.
    """
    def tagged(frame: DataFrame, side: int) -> DataFrame:
        return frame.select(*keys, F.struct(*columns).alias("row"), F.lit(side).alias("side"))

    rows = tagged(left, 0).unionByName(tagged(right, 1)).groupBy(*keys, "row").agg(
        F.min("side").alias("side"), F.max("side").alias("last")).filter("side = last")
    per_key = Window.partitionBy(*keys)
    counted = rows.select(*keys, "row", "side", F.count_if(F.col("side") == 0).over(per_key).alias("gone"),
                          F.count_if(F.col("side") == 1).over(per_key).alias("came"))
    one_each = (F.col("gone") == 1) & (F.col("came") == 1)
    before, after = F.when(F.col("side") == 0, F.col("row")), F.when(F.col("side") == 1, F.col("row"))
    updated = counted.filter(one_each).groupBy(*keys).agg(
        F.max(before).alias("before"), F.max(after).alias("after")).withColumn("change", F.lit("updated"))
    single = counted.filter(~one_each).select(
        *keys, before.alias("before"), after.alias("after"),
        F.when(F.col("side") == 0, F.lit("removed")).otherwise(F.lit("added")).alias("change"))
    return updated.unionByName(single).select(
        *keys, "change", *[F.col(f"before.{c}").alias(f"from_{c}") for c in columns],
        *[F.col(f"after.{c}").alias(f"to_{c}") for c in columns])


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str], replace: bool = False) -> DataFrame:
    """Current rows with the latest change per key applied; a change with op 'delete' removes it.

    ``changes`` has the columns of ``current`` plus ``op`` and the order columns. The latest row per
    key is one aggregation, so a key with very many changes is reduced before the shuffle.
    """
    values = [c for c in current.columns if c not in keys]
    kinds = {c: changes.schema[c].dataType for c in order}
    body = F.struct(*values, "op").alias("body")
    rows = changes.select(*keys, body, F.struct(*order).alias("at"), F.lit(1).alias("later"))
    if not replace:
        first = F.struct(*[F.lit(None).cast(kinds[c]).alias(c) for c in order]).alias("at")
        kept = current.withColumn("op", F.lit("keep")).select(*keys, body, first, F.lit(0).alias("later"))
        rows = kept.unionByName(rows)
    latest = rows.groupBy(*keys).agg(F.max_by("body", F.struct("later", "at")).alias("body"))
    return latest.filter("body.op <> 'delete'").select(*keys, *[F.col(f"body.{c}").alias(c) for c in values])


def history(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Change log rows: what happened to which key, in order columns."""
    return changes.select(*keys, F.col("op").alias("event"), *order)


def entry_counts(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(F.count("*").alias("entries"))


def number_versions(adds: DataFrame, ontology: str, order: list[str], start: int = 1) -> DataFrame:
    """Add ``from_version`` and ``to_version``: each accepted add raises its ontology's version by one."""
    out = running(adds, [ontology], order, {"_done": Running("sum", F.col("accepted").cast("bigint"))})
    after = F.lit(start) + F.col("_done")
    return (out.withColumn("to_version", after)
            .withColumn("from_version", after - F.col("accepted").cast("bigint")).drop("_done"))


def migrations(versioned: DataFrame, ontology: str, order: list[str], action: str = "add_fact") -> DataFrame:
    """Log rows of the accepted adds."""
    return versioned.filter("accepted").select(ontology, F.lit(action).alias("action"), "from_version", "to_version", *order)


def newest(log: DataFrame, at: str, n: int) -> DataFrame:
    """Newest ``n`` rows: a distributed top-n."""
    return log.orderBy(F.desc(at)).limit(n)


def take_snapshot(facts: DataFrame, snapshot_id: str, captured_at: str, version: int, name: str = "") -> DataFrame:
    """Facts tagged as one snapshot, to be appended under its own partition."""
    return facts.withColumn("snapshot_id", F.lit(snapshot_id)).withColumn(
        "captured_at", F.lit(captured_at).cast("timestamp")).withColumn("version", F.lit(version)).withColumn(
        "snapshot_name", F.lit(name))


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row per snapshot with its counts, newest first."""
    return (snapshots.groupBy("snapshot_id", "snapshot_name", "captured_at", "version")
            .agg(F.count("*").alias("fact_count")).orderBy(F.desc("captured_at")))


def find_snapshot(snapshots: DataFrame, id_or_prefix: str) -> DataFrame:
    """Facts of the newest snapshot whose id equals or starts with the text."""
    chosen = snapshots.filter(F.startswith("snapshot_id", F.lit(id_or_prefix)))
    newest_id = chosen.agg(F.max_by("snapshot_id", "captured_at").alias("snapshot_id"))
    return chosen.join(newest_id, "snapshot_id", "left_semi")


def rollback(current: DataFrame, snapshots: DataFrame, snapshot_id: str, new_version: int) -> tuple[DataFrame, DataFrame]:
    """(facts of the snapshot as a new version, log row)."""
    helpers = ["snapshot_id", "captured_at", "version", "snapshot_name"]
    facts = snapshots.filter(F.col("snapshot_id") == snapshot_id).drop(*helpers).withColumn("version", F.lit(new_version))
    log = current.agg(F.count("*").alias("facts_before")).select(
        F.lit("rollback").alias("action"), F.lit(snapshot_id).alias("snapshot_id"), "facts_before",
        F.lit(new_version - 1).alias("from_version"), F.lit(new_version).alias("to_version"))
    return facts, log
