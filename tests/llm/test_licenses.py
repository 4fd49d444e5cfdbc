import random
import re

import pyarrow as pa

from trustframe.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_by_hand(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = sorted((k, label) for label, phrase in licenses.BASE for k in range(len(words))
                   if words[k:k + len(phrase.split())] == phrase.split())
    return len(words), found


def test_base_phrases_by_brute_force(make_docs, odd_rows):
    draw = random.Random(3)
    parts = ["mit", "license", "apache", "general", "public", "the", "MIT License", "É", "x", "-", ".", "permission is"]
    rows = odd_rows + [(100 + k, " ".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))) for k in range(200)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                 for r in licenses.scan(make_docs([r if len(r) == 5 else (*r, "en", "a", 1) for r in rows])).collect())
    wanted = []
    for doc_id, text, *_ in rows:
        n, found = base_by_hand(text)
        wanted.append((str(doc_id), n, len(found), found[0][0] if found else None, found[-1][0] if found else None,
                       ",".join(sorted({label for _, label in found}))))
    assert got == sorted(wanted, key=lambda r: r)


def test_notices_are_chained_into_spans(make_docs):
    mit = licenses.NOTICES[0][1]
    broken = mit.replace("free of charge", "FREE of any charge").replace("sublicense,", "sub license")
    texts = ["before " + mit + " after", "before " + broken, mit[:200], "Licensed under CC BY-NC 4.0.",
             "permission is the public license of the software", ""]
    rows = {r["doc_id"]: r for r in licenses.scan(make_docs(list(enumerate(texts)))).collect()}
    assert [rows[k]["labels"] for k in range(6)] == ["mit", "mit", "", "cc-by-nc", "", ""]
    span = rows[0]["spans"][0]
    assert span["first"] == 1 and span["last"] == base_by_hand(mit)[0] and span["covered"] == 1.0
    assert 0.8 < rows[1]["score"] < 1 and 0 < rows[2]["score"] < 0.8 and rows[5]["score"] == 0
    assert licenses.scan(make_docs([])).count() == 0


class Batches:
    """Stands for a table: a function over batches is run on the given ones at once."""

    def __init__(self, *batches):
        self.batches = batches

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):  # noqa: N802
        return list(function(iter(self.batches)))


def test_a_batch_is_scanned_some_texts_at_a_time(spark):
    texts = [f"mit license {k} " + "word " * 60_000 for k in range(20)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(21), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    empty = batch.slice(0, 0)
    got = licenses.scan(Batches(batch, empty))
    assert [x for part in got for x in part["doc_id"].to_pylist()] == list(range(21))
    assert [x for part in got for x in part["n_base"].to_pylist()] == [1] * 20 + [0]
    assert len(got) > 5 and max(map(len, got)) < 10
