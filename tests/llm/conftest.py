import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have columns of these names too.
CLASHING = ("node", "key", "size", "block", "tie", "starts", "anchors", "toxic", "range", "halo", "carried", "bin",
            "score", "held_out", "component_id", "bitmap_slot", "tokens", "shard")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clash=True):
        """Documents from (doc_id, text) or whole rows, with columns of clashing names."""
        full = [(*r, "en", "a", len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.withColumns({c: F.lit(1) for c in CLASHING}) if clash else df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, a long text."""
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", None, 3), (4, "one", "en", "a", 3),
            (4, "one", "en", "a", 3), (None, "no id here", "en", "b", 10), (6, "word " * 30000, "en", "b", 150000),
            (7, "Über ñandú 漢字 🙂 end", None, "b", 20)]


@pytest.fixture(scope="session")
def prose():
    """Texts of random words with copies, near copies and shared passages, the same on every run."""
    draw = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    passage = [draw.choice(words) for _ in range(40)]
    texts = []
    for k in range(160):
        text = [draw.choice(words) for _ in range(draw.randint(0, 120))]
        if k % 7 == 0:
            at = draw.randint(0, len(text))
            text[at:at] = passage
        if k % 5 == 0 and k:
            text = texts[draw.randrange(k)].split()
        if k % 10 == 0 and text:
            text[draw.randrange(len(text))] = "changed"
        texts.append(" ".join(text))
    for k in range(60):  # one large group of near copies
        text = ("base " + " ".join(words[:150])).split()
        text[3 + k] = f"new{k}"
        texts.append(" ".join(text))
    return list(enumerate(texts))
