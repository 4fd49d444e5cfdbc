"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustframe.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Columns this module adds while it works; a document's own columns of these names are not read.
OWN = ("size", "block", "tie")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2),
                   most: int = 2) -> DataFrame:
    """Adds ``rank``, ``weight`` and ``target`` to one row per source with its ``source_size``.

    Sources in code point order, null last, get the weights in turn. All targets together make ``share`` of all
    sizes; none exceeds ``most`` times its source's size, and what is cut off goes to the others by weight. The
    windows here are over one row per source. Comparisons are exact, in whole numbers.
    """
    up, down = share
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                      ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    cut = most * F.col("source_size")
    filled = ranked.select("*", (up * F.sum("source_size").over(everything)
                                 - down * F.coalesce(F.sum(cut).over(before), F.lit(0))).alias("left"),
                           (F.sum("weight").over(everything)
                            - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("heavy"))
    level = F.when(down * cut * F.col("heavy") >= F.col("left") * F.col("weight"),
                   F.col("left") / (down * F.col("heavy")))
    # the level of the first source that isn't full holds for all after it, and it is the greatest
    return filled.withColumn("level", level).select(
        "source", "source_size", "rank", "weight",
        F.when(F.col("level").isNull(), cut.cast("double"))
        .otherwise(F.col("weight") * F.first("level", ignorenulls=True).over(by_room.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("target"))


def _draw(node: Column, half: Column, total: Column, quotas: Column, seed: int) -> Column:
    """How many blocks of each source go left: an array in the order of ``quotas``.

    Blocks are passed one by one and each goes left with chance (places left) / (blocks left), which picks a
    uniform subset of ``half`` blocks; its counts by source are multivariate hypergeometric.
    """
    def pick(state: Column, rank: Column, at: Column) -> Column:
        left = (F.pmod(F.xxhash64(node, rank, at, F.lit(seed)), state["n"]) < state["l"]).cast("long")
        return F.struct((state["l"] - left).alias("l"), (state["n"] - 1).alias("n"), (state["x"] + left).alias("x"))

    def source(state: Column, quota: Column) -> Column:
        begin = F.struct(state["l"].alias("l"), state["n"].alias("n"), F.lit(0).cast("long").alias("x"))
        blocks = F.when(quota["quota"] > 0, F.sequence(F.lit(1).cast("long"), quota["quota"])) \
            .otherwise(F.array().cast("array<long>"))
        end = F.aggregate(blocks, begin, lambda s, at: pick(s, quota["rank"], at))
        return F.transform(F.array(end), lambda e: F.struct(
            e["l"].alias("l"), e["n"].alias("n"), F.concat(state["left"], F.array(e["x"])).alias("left")))[0]

    start = F.struct(half.alias("l"), total.alias("n"), F.array().cast("array<long>").alias("left"))
    return F.aggregate(quotas, start, source)["left"]


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """Splits (rank, quota) of all sources into 2**depth shards of equal numbers of blocks: shard, rank, quota."""
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "rank", "quota")
    for level in range(depth):
        whole = nodes.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("quotas"),
                                           F.sum("quota").alias("total"))
        half = F.shiftright(F.col("total") + F.pmod(F.xxhash64("shard", F.lit(level), F.lit(seed)), F.lit(2)), 1)
        drawn = whole.select("shard", "quotas", _draw(F.col("shard") + (1 << level), half, F.col("total"),
                                                      F.col("quotas"), seed).alias("left"))
        rows = drawn.select("shard", F.explode(F.arrays_zip("quotas", "left")).alias("x"))
        nodes = rows.select(F.explode(F.array(
            F.struct((2 * F.col("shard")).alias("shard"), F.col("x.left").alias("quota"),
                     F.col("x.quotas.rank").alias("rank")),
            F.struct((2 * F.col("shard") + 1).alias("shard"),
                     (F.col("x.quotas.quota") - F.col("x.left")).alias("quota"),
                     F.col("x.quotas.rank").alias("rank")))).alias("x")).select("x.shard", "x.rank", "x.quota")
    return nodes


def plan(docs: DataFrame, blocks: int = 1024, depth: int = 5, seed: int = 17) -> DataFrame:
    """What the mix takes of each block of each source.

    A source's documents are permuted by a hash and thereby fall into ``blocks`` blocks. Its stream is all blocks
    in a random order, then all of them once more in another. Whole blocks are taken until the target is reached;
    the last is cut. The quota of blocks of each source is then split over the shards by the tree. One row per
    (source, block) with source_size, target, and for both passes ``room`` (words taken of the block) and ``shard``.
    The tables here have one row per block, however large the sources are.
    """
    sums = stored(docs.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    passes = sums.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    order = Window.partitionBy("source").orderBy("copy", F.xxhash64("source", "copy", "block", F.lit(seed)), "block")
    placed = passes.withColumn("before", F.sum("words").over(order) - F.col("words"))
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    room = F.least("words", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("before")))
    taken = stored(joined.withColumn("room", room), "taken")
    used = taken.where("room > 0").withColumn("number", F.row_number().over(
        Window.partitionBy("rank").orderBy("copy", F.xxhash64("source", "copy", "block", F.lit(seed)), "block")))
    shards = split_quotas(used.groupBy("rank").agg(F.count("*").alias("quota")), depth, seed)
    until = F.sum("quota").over(Window.partitionBy("rank").orderBy("shard"))
    spans = shards.withColumn("until", until).where("quota > 0")
    numbers = spans.select("rank", "shard", F.explode(F.sequence(F.col("until") - F.col("quota") + 1, "until"))
                           .alias("number"))
    dealt = used.join(numbers, ["rank", "number"]).select("rank", "block", "copy", "shard")
    both = taken.join(dealt, ["rank", "block", "copy"], "left")
    return stored(both.groupBy("source", "block").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.first("words").alias("words"), *[F.max(F.when(F.col("copy") == c, F.col(x))).alias(f"{x}{c}")
                                           for c in (0, 1) for x in ("room", "shard")]), "mix")


def sized(docs: DataFrame, blocks: int = 1024, seed: int = 17) -> DataFrame:
    """The documents with their number of words and their block."""
    tie = F.xxhash64("doc_id", "text", F.lit(seed))
    return docs.drop(*OWN).withColumns({"size": word_count(F.col("text")), "tie": tie,
                                        "block": F.pmod(tie, F.lit(blocks))})


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Adds to sized documents source_size, target, taken0, taken1 (words per pass), shard0 and shard1.

    Only in the one cut block of a source are the documents put in order; all others are taken whole or not.
    """
    renamed = mixed.select(F.col("source").alias("mix_source"), F.col("block").alias("mix_block"),
                           *[c for c in mixed.columns if c not in ("source", "block")])
    joined = docs.drop(*renamed.columns).join(
        renamed, F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("block") == F.col("mix_block")))
    is_cut = F.lit(False)
    for c in (0, 1):
        is_cut = is_cut | ((F.col(f"room{c}") > 0) & (F.col(f"room{c}") < F.col("words")))
    before = F.sum("size").over(Window.partitionBy("source", "block").orderBy("tie", "doc_id").rowsBetween(
        Window.unboundedPreceding, 0)) - F.col("size")
    ordered = joined.where(is_cut).withColumn("before", before)
    whole = joined.where(~is_cut).withColumn("before", F.lit(0).cast("long"))
    parts = {f"taken{c}": F.when(F.col(f"room{c}") == F.col("words"), F.col("size")).otherwise(
        F.greatest(F.lit(0), F.least("size", F.col(f"room{c}") - F.col("before")))).cast("long") for c in (0, 1)}
    return ordered.unionByName(whole).withColumns(parts)


def mix(docs: DataFrame, blocks: int = 1024, depth: int = 5, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard0, shard1 for each row of ``docs``.

    A null text has size 0 and is taken with 0 words. Null sources form one source. Repeated rows count each on
    its own. An empty table gives an empty result.
    """
    thin = stored(sized(docs.select("doc_id", "text", "source"), blocks, seed).drop("text"), "sized")
    return take(thin, plan(thin, blocks, depth, seed)).select(
        F.col("doc_id").cast("long"), "size", "source_size", "target",
        (F.col("taken0") + F.col("taken1")).alias("taken"), "shard0", "shard1")


def mixed_documents(docs: DataFrame, blocks: int = 1024, depth: int = 5, seed: int = 17) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, once per pass that takes them, sharded and shuffled.

    Each shard is one partition in random order. The one document per source that is cut keeps its first words,
    joined by single spaces; documents without words are kept once.
    """
    rows = sized(docs, blocks, seed)
    took = take(rows, plan(rows.drop("text"), blocks, depth, seed))
    copies = took.withColumn("pass", F.explode(F.array(
        F.struct(F.col("taken0").alias("taken"), F.coalesce("shard0", F.lit(0)).alias("shard"), F.lit(0).alias("copy")),
        F.struct(F.col("taken1").alias("taken"), F.coalesce("shard1", F.lit(0)).alias("shard"), F.lit(1).alias("copy")))))
    copies = copies.where("pass.taken > 0 OR size = 0 AND pass.copy = 0")
    start = F.array_join(F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"),
                                 1, F.col("pass.taken").cast("int")), " ")
    cut = F.col("pass.taken") < F.col("size")
    changed = {"text": F.when(cut, start).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(start).cast("long")).otherwise(F.col("n_chars"))
    shuffled = copies.withColumns(changed).repartition(1 << depth, F.col("pass.shard"))
    return shuffled.sortWithinPartitions("pass.shard", F.xxhash64("tie", "pass.copy", F.lit(seed))).select(docs.columns)
