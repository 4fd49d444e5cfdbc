import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from trustframe.llm import packing, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_tokenizers_library():
    own, theirs = tokenizer.vocabulary(PATH), Tokenizer.from_file(PATH)
    texts = ["", " ", "It's  a test.\n\n  Don't!", "Über ñandú 漢字 🙂\t x²½ Ⅷ", "a<|endoftext|>b <|endoftext|>", "x" * 3000,
             "é    \u0085 ​ tail   ", "1234567 12,5 %_%", "'S 'll''re"]
    for text in texts:
        assert own.ids(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def pieces_by_hand(text, length=1024):
    ids = [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]
    first = len(ids) if len(ids) <= length else len(ids) % length or length
    edges = [0, *range(first, len(ids) + 1, length)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def packed_well(rows, length):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        assert own[-1][0] + own[-1][1] <= length
    return len(places)


def test_pieces_and_places(make_docs, odd_rows):
    rows = packing.pack(make_docs(odd_rows)).collect()
    wanted = sorted((str(r[0]), *p) for r in odd_rows for p in pieces_by_hand(r[1]))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    assert packed_well(rows, 1024) >= -(-sum(r["length"] for r in rows) // 1024)


def test_rounds_of_the_tree_merge_bins(make_docs):
    docs = make_docs([(k, "tok " * (3 + 7 * k % 50)) for k in range(300)])
    rows = packing.pack(docs, length=64, group_items=10, fan=4, slack=0).collect()
    total = sum(r["length"] for r in rows)
    whole, _, fills = packing.best_fit(sorted((r["length"] for r in rows), reverse=True), 64)
    local = packing.pack(docs, length=64, group_items=1 << 20).collect()
    assert packed_well(rows, 64) <= 1.1 * len(fills) and packed_well(local, 64) == len(fills)
    assert len(rows) == len(whole) >= 300 and total == sum(fills)


def test_no_documents(make_docs):
    assert packing.pack(make_docs([])).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, places, fills = packing.best_fit([7, 5, 3, 5, 2], 10)
    assert bins == [0, 1, 0, 1, 2] and places == [0, 0, 7, 5, 0] and fills == [10, 10, 2]
