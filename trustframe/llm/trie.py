"""Prefix trie of conversations: shared beginnings, and totals of subtrees by time-forward processing.

A node is the set of conversations that begin with the same turns. Nodes are named by their smallest member and their
depth. Subtree totals go up in reverse level order: a task reads the nodes of its shard from the deepest to the root
and keeps what it has to pass on in a queue ordered by the place of the receiver. What is left for receivers in other
shards is summed, and the roots of the shards' parts make a smaller tree that is worked off in the same way.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.llm.common import stored
from trustframe.operators.ordered import Running, running

LOW = 0xFFFFFFFF
#: Conversation ids hashed as one piece of text.
CHUNK = 4096
#: Nodes of a shard at most, and at least where there are enough.
SHARD, SMALL = 1 << 18, 1 << 10
TREE = "conv_id long, depth long, up_conv long, up_depth long, leaves long, saved long"
TOTALS = "conv_id long, depth long, leaves long, saved long"
LOCAL = TREE + ", part_conv long, part_depth long, passed boolean"


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from its donor."""
    return F.crc32(conv_id.cast("string")) % 9


def donor(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


def turn_parts() -> list[Column]:
    """Role and text of a turn; null counts as empty."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]


def turn_hash() -> Column:
    """128 bits that name role and text of a turn."""
    role, text = turn_parts()
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(named, 256)), 1, 16)


def rebuilt(conversations: DataFrame, most_shared: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: turns (conv_id, place, turn_hash, n_bytes, length) and one row per conversation.

    A conversation starts with the first turns of its donor, all it has if they are fewer, then come its own turns
    after as many. Turns are ordered by ``turn``, null first, those of one number by the hash of role and text. A
    null role or text is empty. Rows without a conv_id belong to no conversation. Texts are hashed where they are
    read; places are counted in slices, so one conversation may hold any share of the rows.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.octet_length(turn_parts()[1]).cast("long").alias("n_bytes"), turn_hash().alias("turn_hash"))
    placed = stored(running(turns, ["conv_id"], ["turn", "turn_hash"], {"rank": Running("count")}).select(
        "conv_id", (F.col("rank") - 1).alias("place"), "turn_hash", "n_bytes"), "trie-turns")
    ids = placed.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns(
        {"h": shared_turns(F.col("conv_id")), "base": donor(F.col("conv_id"))})
    given = F.least("h", F.coalesce("n_base", F.lit(0)))
    sizes = stored(ids.join(ids.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
                   .select("conv_id", "base", "h", given.alias("given"),
                           (given + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-sizes")
    own = placed.where(F.col("place") >= shared_turns(F.col("conv_id"))).join(
        sizes.select("conv_id", "h", "given", "length"), "conv_id").withColumn(
        "place", F.col("place") - F.col("h") + F.col("given"))
    lent = placed.where((F.col("place") < most_shared) & (F.col("conv_id") == donor(F.col("conv_id")))).select(
        F.col("conv_id").alias("base"), "place", "turn_hash", "n_bytes")
    taken = lent.join(sizes.select("conv_id", "base", "given", "length"), "base").where("place < given")
    names = ("conv_id", "place", "turn_hash", "n_bytes", "length")
    return own.select(*names).unionByName(taken.select(*names)), sizes


def _prefixes(turns: DataFrame) -> DataFrame:
    """Adds ``a``, ``b`` (128 bits that name the turns up to this one) and ``up_a``, ``up_b`` (those before it).

    A beginning is named by the sum of hashes of (place, turn), so its names come from running sums; each 64-bit hash
    is summed in two halves, which can't overflow below 2^31 turns.
    """
    halves = {}
    for name, seed in (("a", 1), ("b", 2)):
        hashed = F.xxhash64(F.lit(seed), "place", "turn_hash")
        halves |= {f"{name}_high": F.shiftrightunsigned(hashed, 32), f"{name}_low": hashed.bitwiseAND(F.lit(LOW))}
    rows = turns.withColumns({f"h_{k}": v for k, v in halves.items()})
    summed = running(rows, ["conv_id"], ["place"], {k: Running("sum", F.col(f"h_{k}")) for k in halves})

    def joined(high: Column, low: Column) -> Column:
        return F.shiftleft(high.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))

    names = {}
    for name in ("a", "b"):
        high, low = f"{name}_high", f"{name}_low"
        names[name] = joined(F.col(high), F.col(low))
        names[f"up_{name}"] = joined(F.col(high) - F.col(f"h_{high}"), F.col(low) - F.col(f"h_{low}"))
    return summed.select("conv_id", (F.col("place") + 1).alias("depth"), "n_bytes", "length",
                         *[column.alias(name) for name, column in names.items()])


def _passed_up(batches: Iterator[pa.RecordBatch], parts: bool) -> Iterator[pa.RecordBatch]:
    """Totals of shards whose nodes come in reverse level order.

    The queue holds (receiver's place in that order, totals). What lies before the current node when it comes is for
    a node that isn't in the shard. With ``parts`` each node also gets the root of its part of the shard; the places
    of the shard's nodes are kept for that, which the size of a shard bounds.
    """
    queue: list[tuple] = []
    kept: list[list] = []
    above: list[int] = []

    def finished() -> Iterator[pa.RecordBatch]:
        root = list(range(len(kept)))
        for k in range(len(kept) - 1, -1, -1):  # receivers come after their senders
            if above[k] >= 0:
                root[k] = root[above[k]]
        for at in range(0, len(kept), 1 << 16):
            rows = [(*row, kept[root[k]][0], kept[root[k]][1], above[k] >= 0)
                    for k, row in enumerate(kept[at:at + (1 << 16)], at)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.bool_() if n == 8 else pa.int64()) for n, x in enumerate(zip(*rows, strict=True))],
                names=[c.split()[0] for c in LOCAL.split(", ")])

    shard = None
    for batch in batches:
        out: list[tuple] = []
        columns = [batch[c].to_pylist() for c in ("shard", *[c.split()[0] for c in TREE.split(", ")])]
        for at, conv, depth, up, up_depth, leaves, saved in zip(*columns, strict=True):
            if at != shard:
                if parts and kept:
                    yield from finished()
                queue, kept, above, shard = [], [], [], at
            place = (-depth, conv)
            while queue and queue[0][:2] < place:
                heapq.heappop(queue)
            while queue and queue[0][:2] == place:
                _, _, sender, more, further = heapq.heappop(queue)
                leaves, saved = leaves + more, saved + further
                if parts:
                    above[sender] = len(kept)
            if up is not None:
                heapq.heappush(queue, (-up_depth, up, len(kept), leaves, saved))
            if parts:
                kept.append([conv, depth, up, up_depth, leaves, saved])
                above.append(-1)
            else:
                out.append((conv, depth, leaves, saved))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)],
                                             names=["conv_id", "depth", "leaves", "saved"])
    if parts and kept:
        yield from finished()


def _by_shard(nodes: DataFrame, shards: int, parts: bool) -> DataFrame:
    dealt = nodes.repartition(shards, "shard") if shards > 1 else nodes.repartition(1)
    ordered = dealt.sortWithinPartitions("shard", F.desc("depth"), "conv_id")
    return ordered.mapInArrow(lambda batches: _passed_up(batches, parts), LOCAL if parts else TOTALS)


def subtree_totals(nodes: DataFrame, shards: int | None = None) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over each node's subtree: conv_id, depth, leaves, saved.

    ``nodes``: conv_id and depth name a node, up_conv and up_depth its parent, which lies less deep (null: a root).
    Nodes are cut into ranges of (conv_id, depth). A first pass finds the totals within each shard and the shard's
    parts, connected pieces that pass their totals to another shard. Parts that get nothing from others are summed by
    their receiver; the rest form a tree again, solved by this function with half the shards at most. A second pass
    adds what came from other shards. The queue of a shard can't outgrow the shard; the nodes are sorted, and
    spilled, by Spark.
    """
    session = nodes.sparkSession
    if shards is None:
        count = nodes.count()
        spread = min(int(session.conf.get("spark.sql.shuffle.partitions")), count // SMALL)
        shards = max(1, -(-count // SHARD), spread)
    if shards == 1:
        return _by_shard(nodes.withColumn("shard", F.lit(0)), 1, False)
    dealt = stored(nodes.repartitionByRange(shards, "conv_id", "depth")
                   .withColumn("shard", F.spark_partition_id()), "trie-shards")
    local = stored(_by_shard(dealt, shards, True), "trie-local")
    crossing = local.where("NOT passed AND up_conv IS NOT NULL").select(
        F.col("conv_id").alias("part_conv"), F.col("depth").alias("part_depth"), "up_conv", "up_depth", "leaves",
        "saved")
    entries = stored(crossing.select("up_conv", "up_depth").distinct().join(local.select(
        F.col("conv_id").alias("up_conv"), F.col("depth").alias("up_depth"), F.col("part_conv").alias("to_conv"),
        F.col("part_depth").alias("to_depth")), ["up_conv", "up_depth"]), "trie-entries")
    inner = entries.select(F.col("to_conv").alias("part_conv"), F.col("to_depth").alias("part_depth")).distinct()
    outer = crossing.join(inner, ["part_conv", "part_depth"], "left_anti").groupBy("up_conv", "up_depth").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    at_parts = outer.join(entries, ["up_conv", "up_depth"]).groupBy(
        F.col("to_conv").alias("conv_id"), F.col("to_depth").alias("depth")).agg(
        F.sum("leaves").alias("more"), F.sum("saved").alias("further"))
    tops = local.where("NOT passed").join(inner.select(
        F.col("part_conv").alias("conv_id"), F.col("part_depth").alias("depth")), ["conv_id", "depth"], "left_semi")
    tree = tops.drop("part_conv", "part_depth", "passed").join(at_parts, ["conv_id", "depth"], "left").join(
        entries, ["up_conv", "up_depth"], "left").select(
        "conv_id", "depth", F.col("to_conv").alias("up_conv"), F.col("to_depth").alias("up_depth"),
        (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("further", F.lit(0))).alias("saved"))
    solved = subtree_totals(stored(tree, "trie-parts"), shards // 2)
    known = crossing.join(solved.select(
        F.col("conv_id").alias("part_conv"), F.col("depth").alias("part_depth"), F.col("leaves").alias("all_leaves"),
        F.col("saved").alias("all_saved")), ["part_conv", "part_depth"], "left")
    coming = known.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(
        F.sum(F.coalesce("all_leaves", "leaves")).alias("more"), F.sum(F.coalesce("all_saved", "saved")).alias("further"))
    filled = dealt.join(coming, ["conv_id", "depth"], "left").select(
        "shard", "conv_id", "depth", "up_conv", "up_depth",
        (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("further", F.lit(0))).alias("saved"))
    return _by_shard(filled, shards, False)


def _ends(rows: DataFrame, chunk: int) -> DataFrame:
    """a, b, depth and ``ends_sha256`` of the sorted conv_ids of each node at which conversations end.

    Ids are put into texts of at most ``chunk`` ids by sorted slices; a node's texts are hashed one after the other
    as a stream, so no task holds the ids of a common conversation.
    """
    ranked = running(rows, ["a", "b", "depth"], ["conv_id"], {"rank": Running("count")})
    texts = ranked.groupBy("a", "b", "depth", F.expr(f"(rank - 1) div {chunk}").alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for a, b, depth, ids in zip(*[batch[c].to_pylist() for c in ("a", "b", "depth", "ids")], strict=True):
                if (a, b, depth) != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (a, b, depth), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield packed(done)
        if node is not None:
            yield packed([(*node, digest.hexdigest())])

    def packed(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, (*[pa.int64()] * 3, pa.string()), strict=True)],
            names=["a", "b", "depth", "ends_sha256"])

    streams = texts.repartition("a", "b", "depth").sortWithinPartitions("a", "b", "depth", "piece")
    return streams.mapInArrow(hashed, "a long, b long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, chunk: int = CHUNK, shards: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    See ``rebuilt`` for nulls, ties and how conversations are put together. The root has depth 0 and no parent;
    conversations without a turn left end there. Without conversations there is no root and no row. Repeated rows are
    turns of their own. Two beginnings count as one if their 128-bit names agree. Other columns aren't read.
    """
    turns, sizes = rebuilt(conversations)
    rows = stored(_prefixes(turns), "trie-prefixes")
    nodes = stored(rows.groupBy("a", "b", "depth", "up_a", "up_b", "n_bytes").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "trie-nodes")
    whole = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = whole.where("n_convs > 0").select(
        *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "depth")],
        *[F.lit(None).cast("long").alias(c) for c in ("up_a", "up_b")], F.lit(0).cast("long").alias("n_bytes"),
        "conv_id", "n_convs")
    every = nodes.unionByName(root)
    parents = every.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"),
                           (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up_conv"))
    children = nodes.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b"),
                             (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    linked = every.join(parents, ["up_a", "up_b", "depth"], "left").join(children, ["a", "b", "depth"], "left")
    tree = stored(linked.select(
        "a", "b", "conv_id", "depth", "up_conv", F.when(F.col("up_conv").isNotNull(), F.col("depth") - 1)
        .alias("up_depth"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "trie-tree")
    totals = subtree_totals(tree.select(*[c.split()[0] for c in TREE.split(", ")]), shards)
    last = rows.where("depth = length").select("a", "b", "depth", "conv_id")
    empty = sizes.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in ("a", "b", "depth")], "conv_id")
    ends = _ends(last.unionByName(empty), chunk)
    return tree.drop("leaves", "saved").join(totals, ["conv_id", "depth"]).join(
        ends, ["a", "b", "depth"], "left").select(
        "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def node_turns(conversations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``role`` and ``text`` of each node's last turn; both are null at the root, empty where they were null."""
    turns, _ = rebuilt(conversations)
    named = nodes.join(turns.select("conv_id", (F.col("place") + 1).alias("depth"), "turn_hash"),
                       ["conv_id", "depth"], "left")
    texts = conversations.select(turn_hash().alias("turn_hash"), *turn_parts()).dropDuplicates(["turn_hash"])
    return named.join(texts, "turn_hash", "left").drop("turn_hash")
