"""SQL text for the check queries: the same text rules written for DuckDB.

DuckDB's pattern engine has no look-around, so the claim splitter doubles every blank first; then a
boundary can consume the blank after it without hiding the next one.
"""

from __future__ import annotations

import re

from trustframe.functions import fixed
from trustframe.functions import text as T

MARK = T.MARK


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def word_list(words: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(T.SPACE + '+')}, ' ', 'g'))"


def tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), {q(T.WORD)})"


def space_words(e: str) -> str:
    return f"[w FOR w IN string_split({squeeze(f'lower({e})')}, ' ') IF w <> '']"


def less(e: str, stop: list[str]) -> str:
    return f"[w FOR w IN list_distinct({e}) IF NOT list_contains({word_list(stop)}, w)]"


def token_set(e: str, stop: list[str] | None = None) -> str:
    return less(tokens(e), stop) if stop else f"list_distinct({tokens(e)})"


def space_word_set(e: str, stop: list[str] | None = None) -> str:
    return less(space_words(e), stop) if stop else f"list_distinct({space_words(e)})"


def common(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def union_size(a: str, b: str) -> str:
    return f"len(list_distinct(list_concat({a}, {b})))"


def contains_any(e: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, {q(w)})" for w in words) + ")"


def count_contained(e: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({e}, {q(w)})::INT" for w in words) + ")"


def claims(e: str) -> str:
    """List of claims of a text."""
    out = squeeze(e)
    for i, a in enumerate(fixed.ABBREVIATIONS):
        out = f"regexp_replace({out}, {q(re.escape(a))}, {q(chr(0xE001 + i))}, 'gi')"
    out = f"replace({out}, ' ', '  ')"
    out = f"regexp_replace({out}, '(^|[^A-Z])([.!?])( |$)', '\\1\\2{MARK}\\3', 'g')"
    out = f"replace({out}, '  ', ' ')"
    piece = "trim(p)"
    for i, a in enumerate(fixed.ABBREVIATIONS):
        piece = f"replace({piece}, {q(chr(0xE001 + i))}, {q(a)})"
    return f"[c FOR c IN [{piece} FOR p IN string_split({out}, '{MARK}')] IF len(c) >= 5]"


def depends(claim: str) -> str:
    words = f"list_slice({space_words(claim)}, 1, 3)"
    bare = f"[regexp_replace(w, '^[.,;:?!]+|[.,;:?!]+$', '', 'g') FOR w IN {words}]"
    return f"list_has_any({bare}, {word_list(fixed.CONNECTORS)})"


def runs(words: str) -> str:
    """Distinct three-word runs of a word list column, or its distinct words when short."""
    return (f"list_distinct(CASE WHEN len({words}) >= 3 THEN "
            f"[array_to_string(list_slice({words}, i, i + 2), ' ') FOR i IN range(1, len({words}) - 1)] "
            f"ELSE {words} END)")


def numbers(e: str) -> str:
    p = q(T.NUMBER_WITH_UNIT)
    unit = (f"array_to_string([w FOR w IN {space_words('u')} IF len(w) > 2 AND NOT "
            f"list_contains({word_list(fixed.UNIT_STOPWORDS)}, w)], ' ')")
    values = f"[regexp_replace(v, '[.,]', '', 'g') FOR v IN regexp_extract_all({e}, {p}, 1)]"
    units = f"[{unit} FOR u IN [coalesce(x, '') FOR x IN regexp_extract_all({e}, {p}, 2)]]"
    return f"[n FOR n IN list_zip({values}, {units}) IF n[2] <> '']"


def numeric_conflict(a: str, b: str) -> str:
    """Whether two number lists disagree on a like unit; use as a correlated scalar."""
    return f"""(SELECT coalesce(bool_or(x[1] <> y[1] AND (contains(x[2], y[2]) OR contains(y[2], x[2])
        OR 1 - levenshtein(x[2], y[2]) / greatest(len(x[2]), len(y[2])) >= 0.8)), false)
      FROM (SELECT unnest({a}) AS x), (SELECT unnest({b}) AS y))"""


def points(e: str, shortest: int = 1) -> str:
    """Sentences cut at every point."""
    trimmed = f"regexp_replace(s, {q(f'^{T.SPACE}+|{T.SPACE}+$')}, '', 'g')"
    return f"[c FOR c IN [{trimmed} FOR s IN string_split({e}, '.')] IF len(c) >= {shortest}]"


def stops(e: str, shortest: int = 10) -> str:
    """Sentences cut after a stop and white space."""
    trimmed = f"regexp_replace(s, {q(f'^{T.SPACE}+|{T.SPACE}+$')}, '', 'g')"
    marked = f"regexp_replace({e}, {q('([.!?])' + T.SPACE + '+')}, '\\1{MARK}', 'g')"
    return f"[c FOR c IN [{trimmed} FOR s IN string_split({marked}, '{MARK}')] IF len(c) >= {shortest}]"


def divergence(e: str) -> str:
    plain = f"translate(lower({e}), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn')"
    return contains_any(plain, fixed.DIVERGENCE_MARKERS)


ACCENTED = "éçÈèêÊÜßäöÖüÄóíñÑÓÍÉÇã"


def edit_distance(a: str, b: str) -> str:
    """DuckDB measures edits in bytes; one-byte stand-ins make them characters."""
    codes = [c for c in range(1, 32) if c not in (9, 10, 11, 12, 13)][:len(ACCENTED)]
    stand_in = "||".join(f"chr({c})" for c in codes)
    return f"levenshtein(translate({a}, '{ACCENTED}', {stand_in}), translate({b}, '{ACCENTED}', {stand_in}))"
