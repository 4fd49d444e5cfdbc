import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from trustframe.llm import manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                       for v in (doc_id, source, lang, n_chars, text)))


def lowered(row):
    doc_id, text = row[:2]
    if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 5:
        return row
    return (doc_id, "".join(c.lower() if "A" <= c <= "Z" else c for c in text), *row[2:])


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k:k + 16])) for k in range(0, len(last), 16)])
    return levels


def steps(levels, at):
    for level in levels[:-1]:
        begin = at // 16 * 16
        yield level[begin:at], level[at + 1:begin + 16]
        at //= 16


def by_hand(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append((leaf(*row), leaf(*lowered(row)), row[0]))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
        trees[name] = tree([x[0] for x in sources[name]])
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for at, (digest, found, doc_id) in enumerate(sources[name]):
            proof, folded = "", found
            for before, after in [*steps(trees[name], at), *steps(top, place)]:
                proof += "".join(before + after)
                folded = sha("".join(before) + folded + "".join(after))
            out.append((doc_id, digest, trees[name][-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return sorted(map(repr, out))


def run(docs):
    found = manifest.with_lower_case(F.col("text"), F.col("doc_id"))
    return sorted(repr(tuple(r)) for r in manifest.verify(docs, found).collect())


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, "b": 1, None: 3}, {"hot": 700, "": 2, "ü": 257},
                                   {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_equal_to_a_tree_by_hand(make_docs, sizes):
    rows = [(1000 * k + d, f"Text {d} von Übung A", "en", s, d) for k, (s, n) in enumerate(sizes.items())
            for d in range(n)]
    assert run(make_docs(rows)) == by_hand(rows)


def test_odd_rows_and_ties(make_docs, odd_rows):
    rows = [*odd_rows, (4, "Another text of that ID", "en", "a", 1), (None, None, None, None, None),
            (20, "A B", "en", "-", 3), (21, "A B", "en", "=", 3)]
    assert run(make_docs(rows)) == by_hand(rows)


def test_empty_table(make_docs):
    assert run(make_docs([])) == []


def test_any_changed_field_is_found(make_docs):
    rows = [(d, f"text {d}", "en", "ab"[d % 2], 6) for d in range(40)]
    docs = make_docs(rows)
    kept = manifest.proofs(docs).collect()
    assert len({r["root"] for r in kept}) == 1
    for k, value in ((1, "text 7"), (2, "de"), (3, "a|"), (4, 7)):
        other = [(*rows[0][:k], value, *rows[0][k + 1:]), *rows[1:]]
        assert manifest.proofs(make_docs(other)).first()["root"] != kept[0]["root"]


def test_a_proof_needs_its_own_leaf(make_docs):
    docs = make_docs([(d, f"T{d}", "en", "a", 2) for d in range(50)])
    got = {r["doc_id"]: r for r in manifest.verify(docs, F.when(F.col("doc_id") == 9, "other").otherwise(
        F.col("text"))).collect()}
    assert [d for d, r in got.items() if not r["verified"]] == [9]
    assert got[9]["leaf"] != got[8]["leaf"] and len({r["proof_sha256"] for r in got.values()}) == 50
