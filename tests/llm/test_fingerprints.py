import hashlib

import numpy as np

from trustframe.llm import fingerprints


def test_edited_texts_by_brute_force(make_docs, odd_rows):
    rows = odd_rows + [(10 + 3 * k, f"text number {k} " * (k % 9 + 1)) for k in range(40)] + [(71, "Café 🙂 " * 5, "en", "a", 1)]
    rows = [r if len(r) == 5 else (*r, "en", "a", 1) for r in rows]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for size in (7, 1000):  # several ranges, and one
        got = fingerprints.fingerprint(make_docs(rows), rows_per_range=size).collect()
        wanted = []
        for k, (doc_id, text, *_) in enumerate(order):
            text, after = text or "", order[(k + 1) % len(order)][1] or ""
            n = len(text) // 4
            edited = text[:len(text) - n] + after[:n]
            wanted.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest()))
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(wanted)
        prints = {}
        for r in got:
            text = next(t for i, t, *_ in rows if i == r["doc_id"])
            assert prints.setdefault(text or "", r["fingerprint"]) == r["fingerprint"]
            assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert fingerprints.fingerprint(make_docs([])).count() == 0
    alone = fingerprints.fingerprint(make_docs([(5, "abcdefgh")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1


def test_walk_takes_the_shared_coins():
    draw = np.random.default_rng(0)
    pauses = fingerprints._pauses()
    texts = [draw.integers(0, 256, n) for n in (5, 0, 40, 1)]
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    flat = np.concatenate([np.append(t, 0) for t in texts])
    reached = fingerprints.walk(flat, starts, sizes)
    for text, start in zip(texts, starts, strict=True):
        step = 0
        for k, c in enumerate(text):
            assert reached[start + k] == step
            step += int(pauses[c * fingerprints.PERIOD + step % fingerprints.PERIOD])
        assert reached[start + len(text)] == step


def test_likeness_falls_with_the_edit_distance():
    near = []
    for edits in (0, 3, 30, 3000):
        total = 0.0
        for seed in range(6):  # one walk may fail to meet again after an edit, so the mean counts
            draw = np.random.default_rng(seed)
            letters = list(draw.choice(list("abcdefghij "), 3000))
            text = "".join(letters)
            for at in draw.integers(0, 2900, edits):
                letters[at] = ""
            a, b = fingerprints.fingerprints([text, "".join(letters)])
            total += float(fingerprints.likeness(a, b)) / 6
        near.append(total)
    assert near[0] > 0.999 > near[1] > near[2] > near[3] and near[1] > 0.7 and near[3] < 0.1


def test_walks_go_on_from_a_replaced_quarter():
    texts, tails = ["some text of words", "x" * 200, "", "abcdefgh"], ["TAIL", "y" * 50, "", "z"]
    own, changed = fingerprints.fingerprints(texts, tails)
    assert np.array_equal(own, fingerprints.fingerprints(texts))
    whole = [x[:len(x) - len(x) // 4] + y for x, y in zip(texts, tails, strict=True)]
    assert np.array_equal(changed, fingerprints.fingerprints(whole))


def test_banding_finds_small_edits(make_docs):
    draw = np.random.default_rng(2)
    texts = ["".join(draw.choice(list("abcdefghij "), 400)) for _ in range(30)]
    texts += [texts[k][:100] + "X" + texts[k][101:] for k in range(10)] + [texts[3]]
    docs = make_docs(list(enumerate(texts)), clash=False)
    pairs = fingerprints.similar_pairs(fingerprints.fingerprint(docs), docs).collect()
    found, wanted = {(r["a"], r["b"], r["distance"]) for r in pairs}, {(k, 30 + k, 1) for k in range(10)}
    assert found <= wanted and len(found) >= 7  # a walk may fail to meet again after an edit


def test_different_texts_of_one_fingerprint_are_paired(make_docs):
    draw = np.random.default_rng(6)
    text = "".join(draw.choice(list("abcdefghij "), 3000))
    edited = next(x for x in (text[:k] + "X" + text[k + 1:] for k in range(2999, 0, -1))
                  if np.array_equal(*fingerprints.fingerprints([text, x])))
    docs = make_docs([(1, text), (2, edited), (3, text), (4, edited), (5, None), (6, "")], clash=False)
    found = fingerprints.similar_pairs(fingerprints.fingerprint(docs), docs).collect()
    assert [(r["a"], r["b"], r["distance"]) for r in found] == [(1, 2, 1)]
    assert sorted((r["doc_id"], r["stands"]) for r in fingerprints.members(docs).collect()) == [
        (1, 1), (2, 2), (3, 1), (4, 2), (5, 5), (6, 5)]
