"""Seals over groups of ledger rows: a tree of digests per group, its root, and proofs that a row is under it.

The tree is built by rounds of aggregation, each with a sixteenth of the rows of the one before, so neither a large
tenant nor a long day is followed by one task. A proof names a row's siblings on the way up; whoever has the sealed
root can check a row with it and needs no other row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.session import cut_lineage
from trustframe.operators.ordered import Running, running

FAN = 16
PATH = "array<struct<before:string,after:string>>"


def _joined(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["digest"]), "")


def tree(rows: DataFrame, groups: list[str], order: list[str], digest: str = "content_hash") -> tuple[list[DataFrame], DataFrame]:
    """(levels, leaves): parents with their at most FAN children level by level, and the placed rows with ``n``.

    A row's place is its rank by ``order``, then by its digest; groups must not be null.
    """
    names = [*groups, *order, digest]
    ranked = running(rows.select(*dict.fromkeys(names)), groups, list(dict.fromkeys([*order, digest])),
                     {"_rank": Running("count")})
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("n"))
    leaves = cut_lineage(ranked.join(sizes, groups).withColumn("place", F.col("_rank") - 1).drop("_rank"))
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, level, count = [], leaves.select(*groups, "place", "n", F.col(digest).alias("digest")), 1
    while count < most or not levels:
        count *= FAN
        # a group that has come down to one node stays as it is
        parents = level.groupBy(*groups, F.expr(f"place div {FAN}").alias("parent"), "n").agg(
            F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("children"))
        lone = F.col("n") <= count // FAN
        parents = cut_lineage(parents.select(*groups, F.col("parent").alias("place"), "n", "children", F.when(
            lone, F.get("children", F.lit(0))["digest"]).otherwise(F.sha2(_joined(F.col("children")), 256)).alias("digest")))
        levels.append(parents)
        level = parents.select(*groups, "place", "n", "digest")
    return levels, leaves


def seal(rows: DataFrame, groups: list[str], order: list[str], digest: str = "content_hash") -> DataFrame:
    """One row per group: n and the root. The root changes with any row, any field in its digest, and the order."""
    levels, _ = tree(rows, groups, order, digest)
    return levels[-1].select(*groups, "n", F.col("digest").alias("root"))


def proofs(rows: DataFrame, wanted: Column, groups: list[str], order: list[str], digest: str = "content_hash") -> DataFrame:
    """Rows for which ``wanted`` (over groups, order and digest) holds, with ``place``, ``path`` and ``root``."""
    levels, leaves = tree(rows, groups, order, digest)
    out = leaves.where(wanted).withColumns({"at": F.col("place"), "path": F.array().cast(PATH)})
    for height, parents in enumerate(levels):
        above = parents.select(*groups, F.col("place").alias("up"), "children")
        out = out.withColumn("up", F.expr(f"at div {FAN}")).join(above, [*groups, "up"])
        step = F.struct(_joined(F.filter("children", lambda c: c["place"] < F.col("at"))).alias("before"),
                        _joined(F.filter("children", lambda c: c["place"] > F.col("at"))).alias("after"))
        climbs = F.col("n") > FAN ** height
        out = out.withColumn("path", F.when(climbs, F.concat("path", F.array(step))).otherwise(F.col("path"))).withColumn(
            "at", F.col("up")).drop("up", "children")
    roots = levels[-1].select(*groups, F.col("digest").alias("root"))
    return out.drop("at").join(roots, groups)


def fold(path: Column, digest: Column) -> Column:
    """The root that a digest and the siblings on its path give."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def check_seals(rows: DataFrame, seals: DataFrame, groups: list[str], order: list[str], digest: Column) -> DataFrame:
    """Each sealed or present group with ``holds``: whether ``digest``, computed anew, gives the sealed root and count."""
    now = seal(rows.withColumn("_digest", digest), groups, order, "_digest")
    both = seals.select(*groups, F.col("n").alias("sealed_n"), F.col("root").alias("sealed_root")).join(now, groups, "full")
    same = reduce(lambda a, b: a & b, [F.equal_null("sealed_n", "n"), F.equal_null("sealed_root", "root")])
    return both.select(*groups, "sealed_n", "n", same.alias("holds"))
