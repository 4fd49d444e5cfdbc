import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trustframe.llm import token_counts

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def by_hand(text, spans, rule):
    counts = {}
    for a, b in TOKENIZER.encode(text, add_special_tokens=False).offsets:
        owners = [next((k for k, (x, y) in enumerate(spans) if x <= c < y), None) for c in range(a, b)]
        best = {"start": owners[0], "end": owners[-1], "most": max(owners, key=lambda o: (owners.count(o), -owners.index(o)))}
        counts[best[rule]] = counts.get(best[rule], 0) + 1
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines_and_given_spans(spark, make_docs, rule):
    texts = ["one two\n\n\n three\n", "Über ñandú\n漢字 🙂🙂\r\n  x", "no feed", "\n", "a\n\nb"]
    docs = make_docs(list(enumerate(texts)))
    got = {}
    for r in token_counts.token_counts(docs, rule=rule).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = r
    for k, text in enumerate(texts):
        lines = text.splitlines(keepends=True) if "\r" not in text else ["Über ñandú\n", "漢字 🙂🙂\r\n", "  x"]
        ends = [sum(map(len, lines[:n])) for n in range(len(lines) + 1)]
        spans = list(zip(ends, ends[1:], strict=False))
        wanted = by_hand(text, spans, rule)
        assert [(r["start"], r["stop"]) for _, r in sorted(got[k].items())] == spans
        assert {s: r["n_tokens"] for s, r in got[k].items() if r["n_tokens"]} == wanted
    given = docs.withColumn("parts", F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("stop"))))
    for r in token_counts.token_counts(given, spans="parts", rule=rule).collect():
        wanted = by_hand(texts[r["doc_id"]], [(1, 3)], rule)
        assert r["n_tokens"] == wanted.get(0 if r["section"] == 0 else None, 0)


def test_odd_texts(make_docs, odd_rows):
    rows = token_counts.token_counts(make_docs(odd_rows)).collect()
    totals = {}
    for r in rows:
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["n_tokens"]
    for doc_id, text, *_ in odd_rows:
        times = sum(x[0] == doc_id for x in odd_rows)
        assert totals[doc_id] == times * len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)
    assert token_counts.token_counts(make_docs([])).count() == 0
    nothing = make_docs([(1, "some words")]).withColumn("parts", F.lit(None).cast("array<struct<start:long,stop:long>>"))
    row = token_counts.token_counts(nothing, spans="parts").first()
    assert row["section"] is None and row["n_tokens"] == 2
