import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from trustframe.llm import common
from trustframe.llm.automaton import SuffixAutomaton
from trustframe.llm.components import _least, components


def test_word_hashes_follow_the_words():
    texts = [b"The cat  the CAT\n", None, b"", b"dog", b"\xc3\xa9t\xc3\xa9 cat"]
    hashes, bounds = common.word_hashes(texts, common.SPACED, True)
    words = [w for t in texts for w in (t or b"").lower().split()]
    assert bounds.tolist() == [0, 4, 4, 4, 5, 7] and len(hashes) == len(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (a == b) == (hashes[i] == hashes[j])


def test_words_over_the_edge_of_a_piece(monkeypatch):
    draw = random.Random(1)
    text = b" ".join(bytes(draw.choices(b"abc", k=draw.randint(1, 9))) for _ in range(500)) + b" " + b"x" * 200 + b" end"
    whole, _ = common.word_hashes([text], common.SPACED, False)
    monkeypatch.setattr(common, "PIECE", 64)
    common._POWERS.clear()
    cut, bounds = common.word_hashes([text, b"x" * 200], common.SPACED, False)
    common._POWERS.clear()
    assert np.array_equal(whole[:500], cut[:500]) and whole[-1] == cut[501] and len(cut) == 503
    assert cut[500] == cut[502] and bounds.tolist() == [0, 502, 503]


def test_automaton_knows_all_runs():
    draw = random.Random(2)
    texts = [[draw.randint(0, 2) for _ in range(draw.randint(0, 12))] for _ in range(20)]
    automaton = SuffixAutomaton()
    for text in texts:
        automaton.add(text)
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}

    def known(run):
        state = 0
        for symbol in run:
            if symbol not in automaton.next[state]:
                return False
            state = automaton.next[state][symbol]
        return True

    assert all(known(run) for run in runs)
    assert not any(known(run) for run in {r + (x,) for r in runs for x in range(4)} - runs)


@pytest.mark.parametrize("held", [2, 25, 1 << 18])
def test_components_of_chains_stars_and_nothing(spark, held):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 30)] + [(3, 3), (200, 7), (None, 4), (-5, 400)]
    random.Random(held).shuffle(edges)
    rows = components(spark.createDataFrame(edges + edges[:20], "a long, b long"), held).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [*range(7, 30), 200]} | {-5: -5, 400: -5}
    assert len(rows) == len(got)
    assert components(spark.createDataFrame([], "a long, b long"), held).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_least_ties_each_node_to_its_smallest(seed):
    draw = random.Random(seed)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(draw.choice([1, 30, 90, 300]))]
    root = {x: x for link in links for x in link}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    u, v = (x.tolist() for x in _least(*(np.array(x, np.int64) for x in zip(*links, strict=True))))
    assert dict(zip(u, v, strict=True)) == {x: r for x, r in root.items() if x != r}


def test_bitmap_misses_no_member(spark):
    rows = spark.createDataFrame([(k, str(k)) for k in range(1000)] + [(None, "x")], "doc_id long, text string")
    some = common.Bitmap(spark.range(0, 1000, 10))
    inside = {r[0] for r in some.rows(rows, "doc_id").collect()}
    outside = {r[0] for r in some.rows(rows, "doc_id", inside=False).collect()}
    assert set(range(0, 1000, 10)) <= inside and None in outside and len(inside) + len(outside) == 1001


def test_bitmap_passes_no_rows_through_python(spark):
    rows = spark.createDataFrame([(1, "a long text"), (2, "b")], "doc_id long, text string")
    plan = common.Bitmap(spark.range(1, 2)).rows(rows, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan


def test_bitmap_of_hashes_is_asked_inside_tasks(spark):
    hashes = np.array([-1, 0, 5, 1 << 62, -(1 << 63)])
    some = common.Bitmap(spark.createDataFrame([(int(x),) for x in hashes], "h long"), 10, hashed=True)
    assert some.mask()(hashes).all() and some.mask()(hashes.view(np.uint64)).all()
    assert some.mask()(np.arange(1024)).sum() == 3  # slots 0, 5 and 1023
    rows = spark.createDataFrame([(int(x),) for x in hashes] + [(7,), (None,)], "h long")
    assert some.rows(rows, "h").count() == 5 and some.rows(rows, "h", inside=False).count() == 2


def test_free_memory_of_a_task_goes_back():
    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    batch = pa.RecordBatch.from_pydict({"a": [1]})
    before = held()
    for _ in common.released([batch, batch]):
        arrays = [np.ones(8000) for _ in range(4000)]  # 256 MB in pieces too small for mappings of their own
        pin, arrays = arrays[-1], None
    assert len(pin) and held() < before + 64
