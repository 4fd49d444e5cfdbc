"""Near-duplicates by a chosen-path set similarity join over word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.llm.common import SPACED, Bitmap, as_bytes, mix, released, shingles, stored, text_slices, word_hashes
from trustframe.llm.components import components

#: Minwise tokens per text, and the odd factors that draw them.
TOKENS = 64
FACTORS = np.random.default_rng(64).integers(1, 1 << 62, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bins of a sketch; each holds one byte of the least shingle in its range of hashes, or 0 without any.
BINS = 512
STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
#: Shingles of a block of texts whose whole sets are compared in one task.
BLOCK = 1 << 20
SIGNED = "doc_id long, node long, n_shingles long, tokens array<int>, sketch binary"


def _sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, words and distinct shingles of each text; fewer words than ``width`` make one shingle."""
    for a, b in text_slices(texts, 1 << 20):
        words, bounds = word_hashes(as_bytes(texts.slice(a, b - a)), SPACED, True)
        for k, (begin, end) in enumerate(zip(bounds, bounds[1:], strict=False), a):
            own = words[begin:end]
            yield k, own, np.unique(shingles(own, min(width, len(own)))) if len(own) else own


def _sketch(own: np.ndarray) -> bytes:
    """One byte per bin for a sorted set of hashes."""
    at = np.searchsorted(own, STARTS)
    first = own[np.minimum(at, len(own) - 1)]
    filled = np.append(at[1:], len(own)) > at
    return np.where(filled, 1 + mix(first) % np.uint64(255), 0).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, node, n_shingles, TOKENS minwise tokens and a sketch; node is the hash of the word sequence.

    Texts of one node have the same words in the same order, so the same set. Without words, node and tokens are null.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = batch["text"]
            nodes, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            tokens = np.zeros((len(texts), TOKENS), np.int32)
            sketches: list[bytes | None] = [None] * len(texts)
            for k, words, own in _sets(texts, width):
                sizes[k] = len(own)
                if len(own):
                    sketches[k] = _sketch(own)
                    nodes[k] = _node(words)
                    for at in range(0, len(own), 1 << 12):
                        part = (own[at:at + (1 << 12), None] * FACTORS).min(0) >> np.uint64(32)
                        part = part.astype(np.uint32)
                        tokens[k] = (part if at == 0 else np.minimum(part, tokens[k].view(np.uint32))).view(np.int32)
            none = sizes == 0
            flat = pa.FixedSizeListArray.from_arrays(pa.array(tokens.ravel()), TOKENS).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(nodes, mask=none), pa.array(sizes), flat,
                                              pa.array(sketches, pa.binary())],
                                             names=["doc_id", "node", "n_shingles", "tokens", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, SIGNED)


def _node(words: np.ndarray) -> int:
    """Hash of a sequence of words."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).astype(np.int64))


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and its whole set of shingles for ``wanted`` (node, doc_id, repeated).

    Of the rows with a wanted doc_id only those with the wanted words count; where such a row is repeated
    (``repeated``), one of the equal sets stays.
    """
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            nodes, found, kept = batch["node"].to_numpy(), [], []
            for k, words, own in _sets(batch["text"], width):
                if len(words) and _node(words) == nodes[k]:
                    kept.append(k)
                    found.append(own.view(np.int64))
            offsets = np.cumsum([0, *map(len, found)])
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            picked = batch.select(["node", "repeated"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.LargeListArray.from_arrays(
                pa.array(offsets), pa.array(values)).cast(pa.list_(pa.int64()))], names=["node", "repeated", "shingles"])

    named = wanted.withColumnRenamed("doc_id", "wanted_id")
    texts = Bitmap(wanted.select("doc_id")).rows(docs, "doc_id").join(named, F.col("doc_id") == F.col("wanted_id"))
    sets = stored(texts.select("node", "repeated", "text").mapInArrow(
        expand, "node long, repeated boolean, shingles array<long>"), "shingle-sets")
    once = sets.where("NOT repeated").select("node", "shingles")
    return once.unionByName(sets.where("repeated").select("node", "shingles").dropDuplicates(["node"]))


def roots_needed(percent: int, missed: float, depth: int) -> int:
    """Roots at which texts start, so that a link at the limit misses all common nodes with at most that probability.

    Two texts share a root if they agree at its place, and a node below if they agree at one of the two places that
    their common node chooses. A link that is closer than the limit is missed less often.
    """
    alike = percent / 100
    return -int(-math.log(missed) // math.log(1 - alike * (1 - (1 - alike) ** 2) ** depth))


def _children(members: DataFrame, signed: DataFrame, seed: int) -> DataFrame:
    """Members of the nodes one level below: each node chooses two places of the signature, and its members part by
    the token they have there."""
    def child(number: int) -> Column:
        place = F.pmod(F.xxhash64("key", F.lit(seed)) + F.lit(number * (TOKENS // 2 - 1)), F.lit(TOKENS))
        return F.xxhash64("key", place, F.element_at("tokens", (place + 1).cast("int")))

    return members.join(signed.select("node", "tokens"), "node").select(
        "node", F.explode(F.array(child(0), child(1))).alias("key"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key as tables of whole keys, some keys at a time."""
    held: pa.Table | None = None
    for batch in released(batches):
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None and len(held) else table
        keys = table["key"].to_numpy()
        end = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        yield table.slice(0, end)
        held = table.slice(end)
    if held is not None:
        yield held


def _spanning(x: np.ndarray, y: np.ndarray, agree: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of the pairs (x, y) those that join components (``root``), the most alike first, as few as do it."""
    above: dict[int, int] = {}

    def top(r: int) -> int:
        while r in above:
            r = above[r]
        return r

    order = np.argsort(-agree, kind="stable")
    left, kept = len(np.unique(root[np.concatenate([x, y])])) - 1, []
    for k, a, b in zip(order.tolist(), root[x[order]].tolist(), root[y[order]].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            above[a] = b
            kept.append(k)
            if len(kept) == left:
                break
    return np.array(kept, np.int64)


def _likely(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of texts of one node and different components that may be similar enough: key, a, b, n_a, n_b.

    ``members`` has key, node, root, n_shingles and sketch; the rows of a node are few. Pairs are judged by set sizes
    and sketches, see ``_alike``. Only as many pairs come out as can join the node's components.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            if not len(table):
                continue
            key, node, root, size = (table[c].to_numpy() for c in ("key", "node", "root", "n_shingles"))
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
            first = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for begin, end in zip(first, [*first[1:], len(table)], strict=True):
                x, y, agree = _alike(root[begin:end], size[begin:end], sketch[begin:end], percent)
                if len(x):
                    kept = _spanning(x, y, agree, root[begin:end])
                    x, y = x[kept], y[kept]
                left.append(begin + x)
                right.append(begin + y)
            x, y = np.concatenate(left), np.concatenate(right)
            x, y = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key[x], node[x], node[y], size[x], size[y])],
                                             names=["key", "a", "b", "n_a", "n_b"])

    return members.repartition("key").sortWithinPartitions("key").mapInArrow(
        compare, "key long, a long, b long, n_a long, n_b long")


def _likely_stars(stars: DataFrame, side: DataFrame, percent: int) -> DataFrame:
    """Pairs of a text and the pivot of its node (key, node, pivot) that may be similar enough: key, a, b, n_a, n_b.

    A pair is one row with both sketches, judged in the task where the second join leaves it, so a star needs no group
    and rows grow with the texts.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            size, other = batch["n_shingles"].to_numpy(), batch["pivot_shingles"].to_numpy()
            near, far = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, BINS)
                         for c in ("sketch", "pivot_sketch"))
            fits = 100 * np.minimum(size, other) >= percent * np.maximum(size, other)
            passed = np.flatnonzero(fits & _passes(near, far, size, other, percent)[0])
            yield batch.select(["key", "node", "pivot", "n_shingles", "pivot_shingles"]).take(pa.array(passed))

    pivots = side.toDF("pivot", "pivot_shingles", "pivot_sketch")
    both = stars.join(side, "node").join(pivots, "pivot").select(
        "key", "node", "pivot", "n_shingles", "pivot_shingles", "sketch", "pivot_sketch")
    found = both.mapInArrow(compare, "key long, node long, pivot long, n_shingles long, pivot_shingles long")
    first = F.col("node") < F.col("pivot")
    return found.select("key", F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"),
                        F.when(first, F.col("n_shingles")).otherwise(F.col("pivot_shingles")).alias("n_a"),
                        F.when(first, F.col("pivot_shingles")).otherwise(F.col("n_shingles")).alias("n_b"))


def _passes(near: np.ndarray, far: np.ndarray, size: np.ndarray, other: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Whether sketches of sets of the given sizes may belong to similar sets, see ``_alike``; share of bins that agree."""
    wanted = percent / 100
    filled = ((near | far) != 0).sum(1)
    agree = ((near == far) & (near != 0)).sum(1)
    united = (size + other) / (1 + wanted)
    spread = filled * wanted * (1 - wanted) * np.maximum(1 - filled / united, 1 / 9)
    return agree >= filled * wanted - 5 * np.sqrt(spread) - 2, agree / filled


def _alike(root: np.ndarray, size: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Pairs of rows of different components that may be similar enough, and the share of bins that agree.

    The least shingle of a bin that either text fills is a draw, without returning any, from their united shingles,
    and the bytes agree if both texts have it. A pair passes unless it is five standard deviations of such draws
    below the wanted similarity; the spread is never taken as less than a third of that of draws with returning,
    and two bins are granted besides. All but one in three million links pass.
    Every pair has a row outside of the largest component, so only those are gone through.
    """
    none = np.zeros(0, np.int64)
    left, right, agreeing = [none], [none], [np.zeros(0)]
    roots, which, counts = np.unique(root, return_inverse=True, return_counts=True)
    if len(roots) > 1:
        outside = which != counts.argmax()
        for at in np.flatnonzero(outside):
            fits = (root != root[at]) & (100 * np.minimum(size, size[at]) >= percent * np.maximum(size, size[at]))
            fits[:at] &= ~outside[:at]  # seen from the other row
            every = np.flatnonzero(fits)
            for begin in range(0, len(every), 1 << 13):
                other = every[begin:begin + (1 << 13)]
                passed, agree = _passes(sketch[other], sketch[at], size[other], size[at], percent)
                left.append(np.full(passed.sum(), at))
                right.append(other[passed])
                agreeing.append(agree[passed])
    return np.concatenate(left), np.concatenate(right), np.concatenate(agreeing)


def _confirmed(likely: DataFrame, signed: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    pairs = stored(likely.select("a", "b", "n_a", "n_b").distinct(), "likely-pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _full_sets(docs, nodes.join(signed.select("node", "doc_id", "repeated"), "node"), width)
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return stored(both.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b"), "links")


def _linked(members: DataFrame, signed: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components which all links inside the nodes of ``members`` would join.

    Of a node go on the texts that are in a likely pair, with their whole sets, in blocks of about BLOCK shingles, and
    each pair of blocks meets in a task. So rows grow with the texts, not with the pairs. Every likely pair is
    confirmed on the whole sets unless links found before join its texts already.
    """
    def taking_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            picked = [np.zeros(0, np.int64)]
            for begin, end, root, size, sketch in _nodes(table):
                x, y, _ = _alike(root, size, sketch, percent)
                picked.append(begin + np.union1d(x, y))
            yield from table.take(pa.array(np.concatenate(picked))).combine_chunks().to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            left, right = [], []
            for begin, end, root, size, sketch in _nodes(table):
                x, y, agree = _alike(root, size, sketch, percent)
                sets, node = table["shingles"].slice(begin, end - begin), table["node"].slice(begin, end - begin).to_numpy()
                for a, b in _joining(x, y, agree, root, size, sets, percent):
                    left.append(min(node[a], node[b]))
                    right.append(max(node[a], node[b]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    side = signed.select("node", "n_shingles", "sketch")
    rows = members.select("key", "node", "root").join(side, "node").select("key", "node", "root", "n_shingles", "sketch")
    part = stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(taking_part, rows.schema), "taking-part")
    if part.isEmpty():
        return part.select(F.col("node").alias("a"), F.col("node").alias("b"))
    wanted = part.select("node").distinct().join(signed.select("node", "doc_id", "repeated"), "node")
    sets = _full_sets(docs, wanted, width)
    parts = part.groupBy("key").agg(F.ceil(F.sum("n_shingles") / BLOCK).alias("parts"))
    dealt = _dealt(part.join(parts, "key"), "root", "n_shingles", "sketch").join(sets, "node")
    return stored(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(confirm, "a long, b long")
                  .distinct(), "links")


def _nodes(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last row of each node of a table sorted by key, and its roots, sizes and sketches."""
    key = table["key"].to_numpy()
    first = np.flatnonzero(np.diff(key, prepend=key[:1] ^ 1))
    for begin, end in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=False):
        own = table.slice(begin, end - begin)
        sketch = np.frombuffer(b"".join(own["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
        yield begin, end, own["root"].to_numpy(), own["n_shingles"].to_numpy(), sketch


def _joining(x: np.ndarray, y: np.ndarray, agree: np.ndarray, root: np.ndarray, size: np.ndarray,
             sets: pa.ChunkedArray, percent: int) -> Iterator[tuple[int, int]]:
    """Of the pairs (x, y) the links on whole sets that join components, the most alike tried first."""
    above: dict[int, int] = {}

    def top(r: int) -> int:
        while r in above:
            r = above[r]
        return r

    held: dict[int, np.ndarray] = {}
    for k in np.argsort(-agree, kind="stable").tolist():
        a, b = int(x[k]), int(y[k])
        low, high = top(int(root[a])), top(int(root[b]))
        if low == high:
            continue
        for at in (a, b):
            if at not in held:
                held[at] = sets[at].values.to_numpy(zero_copy_only=False)
        shared = len(np.intersect1d(held[a], held[b], assume_unique=True))
        if 100 * shared >= percent * (int(size[a]) + int(size[b]) - shared):
            above[low] = high
            yield a, b


def _rooted(members: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Members with the component each belongs to by now; a text that isn't linked is its own."""
    if joined is None:
        return members.select("key", "node", F.col("node").alias("root"))
    return members.join(joined, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))


def _in_blocks(members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Members of a node dealt to pairs of blocks of about ``block`` texts, each a node of its own."""
    parts = sizes.select("key", F.ceil(F.col("size") / block).alias("parts"))
    return _dealt(members.join(parts, "key"), "root")


def _dealt(members: DataFrame, *columns: str) -> DataFrame:
    """Members (key, node, parts) dealt by their node to ``parts`` blocks, and each pair of blocks a node of its own."""
    own = members.withColumn("own", F.pmod(F.xxhash64("node"), "parts")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return own.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", *columns)


def links(docs: DataFrame, signed: DataFrame, width: int, percent: int, roots: int, leaf: int, cross: int,
          depth: int, block: int) -> DataFrame:
    """node, root of the texts in ``signed`` that are linked with others: the components of all links.

    Each text starts at ``roots`` roots, by the tokens at as many places; those of the first tree go first, and what
    they join needs no more links. A node of at most ``leaf`` texts is compared as a whole, and the pairs most alike
    that can join it are confirmed; of a larger one all are confirmed with one pivot. Nodes in which a pair was
    refused, and larger ones with at most ``cross`` pairs between different components left, are then compared for all
    such pairs; others are branched further. After ``depth`` levels what is left is compared in blocks of texts.
    Every proposal is confirmed on the whole sets.
    """
    side = signed.select("node", "n_shingles", "sketch")
    joined = None
    for places in (range(min(2, roots)), range(min(2, roots), roots)):
        if not len(places):
            continue
        starts = [F.xxhash64(F.lit(p), F.element_at("tokens", p % TOKENS + 1)) for p in places]
        members = signed.select("node", F.explode(F.array(*starts)).alias("key"))
        for level in range(depth + 1):
            rooted = stored(_rooted(members, joined), "members")
            sizes = rooted.groupBy("key").agg(
                F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(
                    F.struct(F.xxhash64("key", "node").alias("order"), "node", "root")).alias("pivot")).where("low <> high")
            inside = stored(rooted.join(sizes, "key").drop("low", "high"), "sized-members")
            if inside.isEmpty():  # every node lies in one component
                break
            small, large = inside.where(F.col("size") <= leaf), inside.where(F.col("size") > leaf)
            stars = large.where("root <> pivot.root").select("key", "node", F.col("pivot.node").alias("pivot"))
            likely = stored(_likely(small.select("key", "node", "root").join(side, "node"), percent).unionByName(
                _likely_stars(stars, side, percent)), "proposed")
            now = _confirmed(likely, signed, docs, width, percent)
            joined = _joined_by(joined, now)
            refused = likely.join(now, ["a", "b"], "left_anti").select("key").distinct()
            left = stored(_rooted(inside.select("key", "node"), joined), "rooted")
            counts = left.groupBy("key", "root").count().groupBy("key").agg(
                F.sum("count").alias("size"), F.sum(F.col("count") * F.col("count")).alias("same"))
            counts = stored(counts.withColumn("pairs", (F.col("size") * F.col("size") - F.col("same")) / 2)
                            .where("pairs > 0"), "counts")
            if counts.isEmpty():
                break
            fit = F.col("pairs") <= cross
            again = counts.where((F.col("size") <= leaf)).join(refused, "key", "left_semi").unionByName(
                counts.where((F.col("size") > leaf) & fit))
            rest = left.join(again.select("key"), "key", "left_semi")
            wide = counts.where((F.col("size") > leaf) & ~fit)
            open_ = left.join(wide.select("key"), "key", "left_semi")
            if level == depth:
                rest = rest.unionByName(_in_blocks(open_, wide, block))
            joined = _joined_by(joined, _linked(rest, signed, docs, width, percent))
            if level == depth or wide.isEmpty():
                break
            members = stored(_children(open_.select("key", "node"), signed, level).distinct(), "children")
    return joined if joined is not None else components(signed.select(F.col("node").alias("a"), F.col("node").alias("b")))


def _joined_by(joined: DataFrame | None, now: DataFrame) -> DataFrame:
    """Components of what was joined before and the new links."""
    if joined is None:
        return components(now)
    if now.isEmpty():
        return joined
    return components(now.unionByName(joined.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_copies(docs: DataFrame, width: int = 5, percent: int = 75, missed: float = 1e-6, leaf: int = 48,
                cross: int = 200_000, depth: int = 3, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Texts are linked if their sets of ``width``-word shingles share at least ``percent`` percent of their union.
    component_id is the smallest doc_id that can be reached, and that document is kept. A link at the limit meets in no
    node with a probability of ``missed`` at most. Exact copies are one text in the search, so a group of them costs
    no pairs. Null, empty and blank texts have no shingles and no links. Rows with a null doc_id take no part: their
    component_id is null and they are kept. Rows that repeat a doc_id belong to one component, whatever their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = stored(signatures(rows, width), "signatures")
    ids = each.where("node IS NOT NULL AND doc_id IS NOT NULL")
    counts = ids.groupBy("node", "doc_id").agg(F.count("*").alias("copies"))
    texts = counts.groupBy("node").agg(F.min(F.struct("doc_id", "copies")).alias("least")).select("node", "least.*")
    one = ids.select("node", "doc_id", "n_shingles", "tokens", "sketch").join(texts, ["node", "doc_id"]).withColumn(
        "repeated", F.col("copies") > 1).drop("copies")
    single = one.where("NOT repeated").unionByName(one.where("repeated").dropDuplicates(["node"]))
    signed = stored(single, "signed")
    roots = roots_needed(percent, missed, depth)
    joined = links(rows, signed, width, percent, roots, leaf, cross, depth, block)
    names = signed.select("node", "doc_id")
    linked = joined.join(names.toDF("node", "a"), "node").join(names.toDF("root", "b"), "root").select("a", "b")
    copies = ids.select("node", F.col("doc_id").alias("a")).join(names.withColumnRenamed("doc_id", "b"), "node")
    roots_of = components(linked.unionByName(copies.select("a", "b")))
    final = each.select("doc_id", "n_shingles").join(roots_of, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("root", "doc_id")
    return final.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
