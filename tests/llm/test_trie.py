import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from trustframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def by_hand(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), set()).add(c)
    out = []
    for node, members in nodes.items():
        below = [k for k in nodes if k[:len(node)] == node]
        inner = {k[:-1] for k in below if k != node}
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members),
                    sum(k[:-1] == node and len(k) == len(node) + 1 for k in nodes),
                    sum(k not in inner for k in below),
                    sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit(1) for c in ("place", "rank", "depth", "a", "b", "n", "h", "base", "shard", "length", "leaves")})
    return sorted(repr(tuple(r)) for r in trie.trie(df, **options).collect())


def conversations(seed, n=60, hot=0):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        count = hot if hot and c == 7 else draw.randint(1, 12)
        first = draw.choice(["hello", "hi", "Übung"])
        for t in range(count):
            rows.append((c, t, "user" if t % 2 == 0 else None, first if t == 0 else draw.choice("xyz") * (t % 4)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [None, 1, 2, 5, 16])
def test_equal_to_brute_force(spark, shards):
    rows = conversations(3)
    assert run(spark, rows, shards=shards) == by_hand(rows)


def test_a_long_conversation_and_small_pieces(spark):
    rows = conversations(4, hot=300)
    assert run(spark, rows, shards=7, chunk=2) == by_hand(rows)


def test_a_common_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(200, 320) for t in range(10)]
    assert run(spark, rows, shards=4, chunk=16) == by_hand(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 3, "user", ""), (1, 2, "", None),
            (None, 1, "user", "of none"), (2, 5, "user", "only"), (-4, 1, "user", "below zero"), (10, 1, "a", "b"),
            (10, 1, "a", "b"), (11, None, None, None), (5, 2, "user", "long " * 40000)]
    assert run(spark, rows) == by_hand(rows)


def test_conversations_without_turns_left(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 5)]  # no donor, and none has as many turns as it gives up
    assert any(not t for t in rebuilt(rows).values())
    assert run(spark, rows) == by_hand(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_texts_of_nodes(spark):
    rows = conversations(5, n=12)
    df = spark.createDataFrame(rows, SCHEMA)
    convs = rebuilt(rows)
    for r in trie.node_turns(df, trie.trie(df)).collect():
        wanted = convs[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None)
        assert (r["role"], r["text"]) == wanted


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_totals_of_any_tree(spark, shards):
    draw = random.Random(shards)
    nodes, up = [(0, 0, None, None, 0, 1)], {0: (0, 0)}
    for k in range(1, 400):
        above = up[draw.choice([k - 1, draw.randrange(k)])]  # long chains and bushes, parents in any shard
        conv = draw.randrange(1000) * 1000 + k
        up[k] = (conv, above[1] + 1)
        nodes.append((*up[k], *above, draw.randint(0, 3), k))
    totals = {n[:2]: list(n[4:]) for n in nodes}
    for conv, depth, up_conv, up_depth, *_ in sorted(nodes, key=lambda n: -n[1]):
        if up_conv is not None:
            for j in (0, 1):
                totals[up_conv, up_depth][j] += totals[conv, depth][j]
    got = trie.subtree_totals(spark.createDataFrame(nodes, trie.TREE), shards).collect()
    assert {(r["conv_id"], r["depth"]): [r["leaves"], r["saved"]] for r in got} == totals and len(got) == 400
