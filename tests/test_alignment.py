"""Best partial alignments against a plain table of distances."""

import random

import numpy as np
import pytest

from trustframe.functions import alignment
from trustframe.operators import ground


def plain(pattern: str, text: str) -> tuple[int, int, int]:
    """Every cell holds (edits, start); of equal edits the latest start."""
    row = [(0, -j) for j in range(len(text) + 1)]
    for i, p in enumerate(pattern, 1):
        now = [(i, 0)]
        for j, c in enumerate(text, 1):
            now.append(min((row[j][0] + 1, row[j][1]), (row[j - 1][0] + (p != c), row[j - 1][1]), (now[-1][0] + 1, now[-1][1])))
        row = now
    edits = min(e for e, _ in row)
    end = next(j for j, (e, _) in enumerate(row) if e == edits)
    return edits, -row[end][1], end


def test_places_equal_the_plain_table():
    draw = random.Random(3)
    for _ in range(3000):
        pattern = "".join(draw.choices("abß", k=draw.randint(1, 9)))
        text = "".join(draw.choices("abß", k=draw.randint(0, 14)))
        assert alignment.best_place(pattern, text) == plain(pattern, text), (pattern, text)
    for size in (63, 64, 65, 200):
        pattern = "".join(draw.choices("abcd ", k=size))
        text = "".join(draw.choices("abcd ", k=300))
        noisy = pattern[:size // 2] + "x" + pattern[size // 2 + 2:]
        assert alignment.best_place(pattern, text + noisy + text) == plain(pattern, text + noisy + text)


def test_odd_places():
    assert alignment.best_place("", "abc") == (0, 0, 0)
    assert alignment.best_place("abc", "") == (3, 0, 0)
    assert alignment.best_place("abc", "zzz") == (3, 0, 0)
    assert alignment.best_place("cxt sat", "the cat sat down") == (1, 4, 11)
    assert alignment.best_place("cat sat", "the caat sat down") == (1, 6, 12)  # "at sat" is shorter than "caat sat"


def test_aligned_evidence(spark):
    answers = spark.createDataFrame(
        [(1, ["The Cat sat", "dogs bark"]), (2, ["alone"]), (3, ["x", None]), (4, []), (5, None)], "k int, claims array<string>")
    contexts = spark.createDataFrame(
        [(1, 7, "so the cat sxt here"), (1, 8, "THE CAT SXT"), (1, 9, None), (3, 4, ""), (4, 1, "t"), (6, 1, "unused")],
        "k int, doc_id int, text string")
    found = {(r.k, r.pos): r for r in ground.aligned_evidence(answers, contexts, ["k"]).collect()}
    assert set(found) == {(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)}
    best = found[1, 0]
    assert (best.evidence_doc, best.edits, best.start, best.end) == (7, 1, 3, 14)
    assert best.score == pytest.approx(100 * 10 / 11)
    for key in ((2, 0), (3, 1)):
        assert (found[key].evidence_doc, found[key].edits, found[key].score, found[key].start) == (None, None, 0.0, None)
    assert (found[3, 0].edits, found[3, 0].score, found[3, 0].end) == (1, 0.0, 0)


def test_clashing_names_are_refused(spark):
    frame = spark.createDataFrame([(1, ["a"], "a")], "pos int, claims array<string>, text string")
    with pytest.raises(ValueError, match="pos"):
        alignment.align(frame)


def test_edits_of_many_pairs_equal_single_ones(monkeypatch):
    draw = random.Random(4)
    claims = ["".join(draw.choices("abc ß🙂", k=k)) for k in (0, 1, 63, 64, 65, 128, 129, 200)]
    texts = ["".join(draw.choices("abc ß🙂", k=k)) for k in (0, 1, 64, 90, 128, 150)]
    one, other = (x.ravel() for x in np.indices((len(claims), len(texts))))
    expected = [list(alignment._distances(claims[a], texts[b], True))[-1] if claims[a] and texts[b]
                else len(claims[a] + texts[b]) for a, b in zip(one, other, strict=True)]
    for cells in (alignment.CELLS, 300):  # all at once, and a few at a time
        monkeypatch.setattr(alignment, "CELLS", cells)
        assert alignment.edit_distances(claims, texts, one, other).tolist() == expected


def test_gold_is_aligned_in_blocks_of_pairs(spark):
    rows = [(1, "the tower is tall", [("the tower is not tall", "a"), None, ("the tower is tall!", "b"), (None, "c")]),
            (2, "x", [("a much longer text", "a")]), (3, None, [("x", "a")]), (4, "x", None), (5, "x", []), (6, "", [("", "a")]),
            (7, "same", [("sama", "a"), ("samb", "b")])]
    claims = spark.createDataFrame(rows, "id long, claim string, gold array<struct<text: string, label: string>>")
    aligned = ground.align_gold(claims)
    assert aligned.columns == ["id", "claim", "gold", "gold_label", "gold_similarity"]
    assert "levenshtein" not in aligned._jdf.queryExecution().toString()
    found = {r["id"]: (r["gold_label"], r["gold_similarity"]) for r in aligned.collect()}
    none = (None, None)
    assert found == {1: ("b", 0.944444444), 2: none, 3: none, 4: none, 5: none, 6: none, 7: ("a", 0.75)}
