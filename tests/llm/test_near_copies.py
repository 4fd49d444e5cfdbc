import random

import pytest

from trustframe.llm import near_copies


def by_hand(rows):
    sets, root = {}, {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().lower().split()
        own = {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()
        sets[doc_id], root[doc_id] = own, doc_id

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {x: (len(sets[x]), find(x)) for x in sets}


def test_components_by_brute_force(make_docs, prose):
    wanted = by_hand(prose)
    got = near_copies.near_copies(make_docs(prose)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    # small limits: nodes are branched, compared with pivots and across components
    small = near_copies.near_copies(make_docs(prose), leaf=4, cross=20, depth=3, block=8).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in small} == wanted


def families(n, words=120, seed=9):
    """Large families of near copies, some at the limit, and texts that share half with a family."""
    draw = random.Random(seed)
    rows = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(words)]
        for _ in range(n // 4):
            text = list(base)
            for _ in range(draw.choice([1, 1, 2, 3, 6])):
                text[draw.randrange(words)] = f"x{draw.randrange(10**9)}"
            rows.append(" ".join(text))
    base = [f"h{k}" for k in range(words)]
    for k in range(n - len(rows)):  # alike by half: many unlikely and likely pairs, none linked
        rows.append(" ".join(base[:80] + [f"own{k}v{j}" for j in range(40)]))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_large_families_by_brute_force(make_docs):
    rows = families(2000)
    wanted = by_hand(rows)
    got = near_copies.near_copies(make_docs(rows, clash=False)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == wanted


@pytest.mark.parametrize("options", [{"leaf": 4, "cross": 20, "depth": 0, "block": 16}, {"leaf": 8, "cross": 50, "depth": 2, "block": 10}])
def test_small_limits_branch_and_deal_in_blocks(make_docs, monkeypatch, options):
    monkeypatch.setattr(near_copies, "BLOCK", 4000)  # whole sets of about forty texts
    rows = families(260)
    got = near_copies.near_copies(make_docs(rows, clash=False), **options).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_hand(rows)


@pytest.mark.parametrize("swap", [False, True])
def test_one_id_with_two_texts(make_docs, swap):
    long = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(60 if swap else 20))
    rows = [(1, long), (5, other), (5, long + " end"), (7, other + " end"), (5, other), (9, "alone in here with words")]
    got = near_copies.near_copies(make_docs(rows[::-1] if swap else rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 5: 1, 7: 1, 9: 9} and len(got) == 6


def test_roots_follow_the_recall_wanted():
    for depth in (0, 2, 3):
        for missed in (1e-3, 1e-6):
            n = near_copies.roots_needed(75, missed, depth)
            meet = 0.75 * 0.9375 ** depth
            assert (1 - meet) ** n <= missed < (1 - meet) ** (n - 1)


def test_odd_rows(make_docs, odd_rows):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
                  for r in near_copies.near_copies(make_docs(odd_rows)).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True),
                          (None, 1, None, True), (6, 1, 6, True), (7, 1, 7, True)], key=str)
    assert near_copies.near_copies(make_docs([])).count() == 0


def test_case_and_spacing_make_no_difference(make_docs):
    rows = [(5, "One two  three\tfour five SIX"), (3, "one TWO three four five six"), (9, "one two three four five sixÉ"),
            (8, "short text"), (2, "Short Text")]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(make_docs(rows)).collect()}
    assert got == {5: 3, 3: 3, 9: 9, 8: 2, 2: 2}


def test_a_star_makes_one_row_per_text(make_docs, monkeypatch):
    rows = families(160)
    seen, plain = [], near_copies._likely_stars

    def spied(stars, side, percent):
        seen.append((stars.count(), stars.select("key", "node").distinct().count()))
        return plain(stars, side, percent)

    monkeypatch.setattr(near_copies, "_likely_stars", spied)
    got = near_copies.near_copies(make_docs(rows), leaf=16, depth=0).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_hand(rows)
    assert seen[0][0] and all(pairs == texts for pairs, texts in seen)
