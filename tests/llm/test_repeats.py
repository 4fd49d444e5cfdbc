import hashlib

import pytest

from trustframe.llm import repeats
from trustframe.llm.common import Bitmap


def by_hand(rows, window=13):
    first, out = {}, {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            if doc_id is not None:
                first[key] = min(doc_id, first.get(key, doc_id))
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[k:k + window])] < doc_id:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.setdefault(doc_id, []).append((len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def found(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    return out


def test_removed_words_by_brute_force(make_docs, prose):
    wanted = by_hand(prose)
    assert found(repeats.remove_repeats(make_docs(prose))) == wanted
    assert sum(n for rows in wanted.values() for _, n, _ in rows) > 1000


def test_wide_anchors_and_many_shards(make_docs, prose, monkeypatch):
    whole = repeats.covered_windows
    monkeypatch.setattr(repeats, "covered_windows",
                        lambda docs, window: whole(docs, window, shard_pieces=50, anchor_pieces=2))
    assert found(repeats.remove_repeats(make_docs(prose))) == by_hand(prose)


def test_odd_rows(make_docs, odd_rows):
    rows = odd_rows + [(8, "word " * 40, "en", "c", 1), (8, "word " * 40, "en", "c", 1), (None, "word " * 40, "x", "c", 1)]
    frame = repeats.remove_repeats(make_docs(rows), carry=("source",))
    assert found(frame) == by_hand(rows)
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert texts[1] is None and texts[3] == " \t\n" and texts[8] == "" and texts[None] in ("no id here", "word " * 40)
    assert repeats.remove_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("swap", [False, True])
def test_one_id_with_two_texts(make_docs, swap):
    shared = " ".join(f"s{k}" for k in range(30))
    rows = [(1, shared), (2, "short one"), (2, "a b " + shared), (2, " ".join(f"clean{k}" for k in range(60))), (2, "a b " + shared)]
    got = repeats.remove_repeats(make_docs(rows[::-1] if swap else rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [
        (1, 30, 0), (2, 2, 0), (2, 32, 30), (2, 32, 30), (2, 60, 0)]


def test_anchors_are_sifted_where_they_are_found(make_docs, prose):
    docs = make_docs(prose, clash=False).select("doc_id", "text")
    every = repeats.anchors(docs, 13)
    wanted = every.select("anchor").distinct().limit(50)
    sifted = repeats.anchors(docs, 13, Bitmap(wanted, 20, hashed=True))
    assert sifted._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    key = lambda df: sorted(map(tuple, df.select("anchor", "doc_id").collect()))
    known = {r[0] for r in wanted.collect()}
    assert [x for x in key(sifted) if x[0] in known] == [x for x in key(every) if x[0] in known]
    assert sifted.count() < every.count()


def test_words_move_only_for_anchors_with_different_surroundings(make_docs, monkeypatch):
    shared = " ".join(f"s{k}" for k in range(30))
    rows = [(k, f"{shared} " + " ".join(f"own{k}w{j}" for j in range(12))) for k in range(40)]
    rows += [(100 + k, " ".join(f"copy{j}" for j in range(30))) for k in range(40)]
    labels, whole = {}, repeats.stored

    def spied(df, label):
        labels[label] = whole(df, label)
        return labels[label]

    monkeypatch.setattr(repeats, "stored", spied)
    got = repeats.remove_repeats(make_docs(rows)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {
        **{k: 30 * (k > 0) for k in range(40)}, **{100 + k: 30 * (k > 0) for k in range(40)}}
    assert "words" not in labels["pieces"].columns
    worded = labels["worded-pieces"].count() if "worded-pieces" in labels else 0
    assert worded < labels["pieces"].count() / 2
