"""Token counts per section: whole documents are encoded once, and token spans are joined to section spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustframe.llm import tokenizer

#: Stands for a null doc_id inside of a batch.
NO_ID = np.iinfo(np.int64).min
RULES = ("start", "end", "most")
COUNTED = "doc_id long, section int, start long, stop long, n_tokens long, n_crossing long, n_total long"


def _line_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
    if len(starts) > 1 and starts[-1] == len(points):
        starts = starts[:-1]  # a text that ends with a line feed has no empty line after it
    return starts, np.append(starts[1:], len(points))


def token_spans(data: bytes, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last, from the tokens' widths in bytes.

    A character that is split between tokens belongs to each of them.
    """
    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(widths)
    return character[ends - widths], character[ends - 1] + 1


def _section(starts: np.ndarray, stops: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the span that holds each character, -1 where none does."""
    found = np.searchsorted(starts, at, "right") - 1
    return np.where((found >= 0) & (at < stops[np.maximum(found, 0)]), found, -1)


def allocate(first: np.ndarray, after: np.ndarray, starts: np.ndarray, stops: np.ndarray,
             rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token by the rule, and whether the token reaches over a section's edge.

    ``start``: the section with its first character; ``end``: that with its last; ``most``: that with most of its
    characters, the earliest on a tie. -1 stands for characters outside of all sections.
    """
    head, tail = _section(starts, stops, first), _section(starts, stops, after - 1)
    crossing = head != tail
    if rule == "start":
        return head, crossing
    if rule == "end":
        return tail, crossing
    chosen = head.copy()
    for k in np.flatnonzero(crossing):
        owners = _section(starts, stops, np.arange(first[k], after[k]))
        kinds, begins, counts = np.unique(owners, return_index=True, return_counts=True)
        chosen[k] = kinds[np.lexsort((begins, -counts))[0]]
    return chosen, crossing


def token_counts(docs: DataFrame, path: str | None = None, spans: str | None = None,
                 rule: str = "start") -> DataFrame:
    """Tokens of each section of each text: doc_id, section, start, stop, n_tokens, n_crossing, n_total.

    ``spans`` names a column of array<struct<start, stop>> with sections in order that don't overlap; without it
    the lines are the sections. Every token is counted once, in the section that ``rule`` gives; tokens outside of
    all sections are in a row with a null section. n_crossing counts the section's tokens that cross its edge and
    n_total all tokens of the text. A null text counts as empty, and an empty text has one empty section; a null
    array of spans means no sections. Repeated rows give repeated results.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    path = path or tokenizer.default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokenizer.vocabulary(path)
        for batch in batches:
            given = batch["spans"].to_pylist() if spans else [None] * len(batch)
            parts: list[list[np.ndarray]] = [[] for _ in range(7)]
            for doc_id, text, own in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), given, strict=True):
                text = text or ""
                data = text.encode()
                if spans:
                    starts, stops = (np.array([x[k] for x in own or ()], np.int64) for k in ("start", "stop"))
                else:
                    starts, stops = _line_spans(np.frombuffer(text.encode("utf-32-le"), np.uint32))
                ids = vocabulary.ids(text)
                n, total = len(starts), len(ids)
                section, crossing = np.zeros(0, np.int64), np.zeros(0, bool)
                if total and n:
                    first, after = token_spans(data, vocabulary.widths[ids])
                    section, crossing = allocate(first, after, starts, stops, rule)
                elif total:
                    section, crossing = np.full(total, -1), np.zeros(total, bool)
                slots = np.where(section < 0, n, section)
                counts = np.bincount(slots, minlength=n + 1)
                crossed = np.bincount(slots[crossing], minlength=n + 1)
                rows = n + bool(counts[n])
                for column, values in zip(parts, (
                        np.full(rows, NO_ID if doc_id is None else doc_id), np.arange(rows), np.append(starts, -1)[:rows],
                        np.append(stops, -1)[:rows], counts[:rows], crossed[:rows], np.full(rows, total)),
                        strict=True):
                    column.append(np.asarray(values, np.int64))
                parts[1][-1] = np.where(np.arange(rows) < n, parts[1][-1], -1)
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts]
            outside = columns[1] < 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], mask=columns[0] == NO_ID),
                 pa.array(columns[1].astype(np.int32), mask=outside),
                 *[pa.array(columns[k], mask=outside) for k in (2, 3)], *map(pa.array, columns[4:])],
                names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing", "n_total"])

    chosen = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if spans:
        chosen.append(F.col(spans).cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))
    return docs.select(*chosen).mapInArrow(count, COUNTED)
