"""Merkle manifest of a table of documents, with inclusion proofs from nested-interval labels.

Every node of the tree is labelled with the interval of leaf ranks it covers. A node's parent is the node of the next
level whose interval holds its own; both fall into one bucket of that level, so ancestors are attached by equi-joins on
the bucket with the containment as a further condition. The siblings of a node are what its parent's interval holds
beside the node's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.llm.common import stored
from trustframe.operators.ordered import Running, running

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields as text: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    def part(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


def with_lower_case(text: Column, doc_id: Column) -> Column:
    """The text with A-Z in lower case where 5 divides the CRC-32 of the decimal doc_id; rows without an id stay."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(doc_id.cast("string")) % 5 == 0, F.translate(text, letters, letters.lower())).otherwise(text)


def _joined(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda x: x["digest"]), "")


def _grow(leaves: DataFrame, most: int, label: str) -> list[DataFrame]:
    """All levels above ``leaves`` (grp, lo, hi, digest and anything that leaves shall carry), each written.

    A node's children are the at most FAN nodes of its bucket, in order. Groups that have come down to one node get
    further nodes above it, which no proof reaches.
    """
    levels, level, width = [], leaves, 1
    while not levels or width < most:
        width *= FAN
        runs = level.groupBy("grp", F.expr(f"lo div {width}L").alias("bucket")).agg(F.sort_array(F.collect_list(
            F.struct("lo", "hi", "digest", *[c for c in level.columns if c not in ("grp", "lo", "hi", "digest")]))
        ).alias("children"))
        levels.append(stored(runs.select(
            "grp", F.get("children", F.lit(0))["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"),
            F.sha2(_joined(F.col("children")), 256).alias("digest"), "children"), f"{label}-{len(levels) + 1}"))
        level = levels[-1].select("grp", "lo", "hi", "digest")
    return levels


def _tops(levels: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """The node of each group that covers all its leaves: grp, n, digest; a lone leaf is its own."""
    found = []
    for level, nodes in enumerate(levels, 1):
        fitting = (F.col("n") <= FAN ** level) & (F.col("n") > (FAN ** (level - 1) if level > 1 else 0))
        lone = F.get("children", F.lit(0))["digest"]
        found.append(nodes.where("lo = 0").join(sizes.where(fitting), "grp").select(
            "grp", "n", F.when(F.col("n") == 1, lone).otherwise(F.col("digest")).alias("digest")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _siblings(children: Column, lo: Column, hi: Column) -> Column:
    """What a parent's interval holds before and after the interval from ``lo`` to ``hi``."""
    return F.struct(_joined(F.filter(children, lambda x: x["hi"] <= lo)).alias("left"),
                    _joined(F.filter(children, lambda x: x["lo"] >= hi)).alias("right"))


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Every leaf with the siblings on its way up: ``child`` (what the leaf carries), ``path``, and what tops carry.

    ``tops`` has grp, n, path (of the way further up) and any columns. Ancestors are attached from the top down, so a
    node meets one row only, its parent's, which has the whole way above; no node meets more than FAN others.
    """
    carried = [c for c in tops.columns if c not in ("grp", "n", "path")]
    above = None
    for level in range(len(levels), 0, -1):
        nodes = levels[level - 1].select("grp", "lo", "hi", "children")
        fitting = (F.col("n") <= FAN ** level) & (F.col("n") > (FAN ** (level - 1) if level > 1 else 0))
        here = nodes.where("lo = 0").join(tops.where(fitting), "grp").withColumn("lone", F.col("n") == 1).drop("n")
        if above is not None:
            bucket = F.expr(f"lo div {FAN ** (level + 1)}L")
            parents = above.select(F.col("grp").alias("p_grp"), bucket.alias("p_bucket"), F.col("lo").alias("p_lo"),
                                   F.col("hi").alias("p_hi"), F.col("children").alias("p_children"), "path", *carried)
            inside = nodes.withColumn("bucket", bucket).join(
                parents, (F.col("grp") == F.col("p_grp")) & (F.col("bucket") == F.col("p_bucket"))
                & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))
            step = _siblings(F.col("p_children"), F.col("lo"), F.col("hi"))
            here = here.unionByName(inside.select(
                "grp", "lo", "hi", "children", F.concat(F.array(step), F.col("path")).alias("path"), *carried,
                F.lit(False).alias("lone")))
        above = here
    leaves = above.select("children", "path", "lone", *carried, F.explode("children").alias("child"))
    step = _siblings(F.col("children"), F.col("child.lo"), F.col("child.hi"))
    path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
    return leaves.select("child", path.alias("path"), *carried)


def proofs(docs: DataFrame, found_text: Column | None = None) -> DataFrame:
    """Merkle tree of the documents and a proof per row: doc_id, source, leaf, found_leaf, subroot, root, path.

    ``path`` has the siblings (before and after the node, digests joined) of each level from the leaf up to the root,
    first within the source, then over the sources. ``found_leaf`` is the leaf of the row as found now, with
    ``found_text`` for its text. Leaves of a source ascend by doc_id, null first; rows of one doc_id by their digests,
    so equal rows are leaves of their own and their order doesn't matter. A null source is a source of its own, the
    first; null fields count as ``-``, empty texts as ``0:``. No documents give no rows. Columns beyond those of
    documents aren't read. Texts are hashed where they are read and never shuffled; ranks come from slices of the
    sorted rows, so a hot source is spread over all tasks.
    """
    grp = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # sorts null first
    text, found = F.col("text"), F.col("text") if found_text is None else found_text
    others = [F.col(c) for c in FIELDS[:-1]]
    hashed = docs.select(grp.alias("grp"), F.col("doc_id").cast("long"), leaf_digest(*others, text).alias("digest"),
                         F.when(~F.equal_null(found, text), leaf_digest(*others, found)).alias("changed"))
    rows = stored(hashed, "manifest-leaves")
    ranked = running(rows, ["grp"], ["doc_id", "digest", "changed"], {"rank": Running("count")})
    leaves = ranked.select("grp", (F.col("rank") - 1).alias("lo"), F.col("rank").alias("hi"), "digest", "doc_id",
                           "changed")
    sizes = stored(rows.groupBy("grp").agg(F.count("*").alias("n")), "manifest-sizes")
    most, groups = sizes.agg(F.max("n"), F.count("*")).first()
    levels = _grow(leaves, most or 0, "manifest-level")

    subroots = stored(_tops(levels, sizes), "manifest-subroots")
    placed = running(subroots.withColumnRenamed("n", "size"), [], ["grp"], {"rank": Running("count")})
    upper = _grow(placed.select(F.lit("").alias("grp"), (F.col("rank") - 1).alias("lo"), F.col("rank").alias("hi"),
                                "digest", F.col("grp").alias("member"), "size"), groups, "manifest-upper")
    whole = subroots.sparkSession.range(1).select(F.lit("").alias("grp"), F.lit(groups).cast("long").alias("n"))
    root = _tops(upper, whole).withColumnRenamed("digest", "root").withColumn("path", F.array().cast(PATH))
    sources = _descend(upper, root).select(
        F.col("child.member").alias("grp"), F.col("child.size").alias("n"), F.col("child.digest").alias("subroot"),
        "root", "path")
    return _descend(levels, stored(sources, "manifest-sources").withColumn("source", F.when(
        F.col("grp") != "-", F.expr("substr(grp, 2)")))).select(
        "child.doc_id", "source", F.col("child.digest").alias("leaf"),
        F.coalesce("child.changed", "child.digest").alias("found_leaf"), "subroot", "root", "path")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def verify(docs: DataFrame, found_text: Column | None = None) -> DataFrame:
    """Each row's proof checked against the root: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` is computed from the row as found; see ``proofs`` for nulls, ties and empty tables.
    """
    checked = proofs(docs, found_text).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("path"), F.col("found_leaf")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
