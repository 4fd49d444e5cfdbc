"""Splitters of answers and extractors of facts as table functions, which callers may replace by their own.

A splitter gets an answer and yields (pos, claim); an extractor gets a text and yields (content, fact_type, confidence).
They run beside the data, as lateral joins, and may be anything from a pattern to a model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import functions as F

SPLIT = "pos int, claim string"
FACTS = "content string, fact_type string, confidence double"


@F.udtf(returnType=SPLIT)
class LineSplitter:
    """One claim per line or list item; marks of lists and lines under five characters are left out."""

    def eval(self, answer: str) -> Iterator[tuple[int, str]]:
        pos = 0
        for line in re.split(r"[\n;]", answer or ""):
            claim = re.sub(r"^[ \t]*(?:[-*]|[0-9]+[.)])[ \t]+", "", line).strip(" \t\r")
            if len(claim) >= 5:
                yield pos, claim
                pos += 1


@F.udtf(returnType=FACTS)
class MarkedFacts:
    """Facts in lines that begin with ``type:``, as authors write them down; others aren't facts."""

    def eval(self, text: str) -> Iterator[tuple[str, str, float]]:
        for kind, content in re.findall(r"^[ \t]*(definition|constraint|policy)[ \t]*:[ \t]*(\S.*?)[ \t]*$", text or "",
                                        re.MULTILINE | re.IGNORECASE):
            yield content, kind.lower(), 1.0
