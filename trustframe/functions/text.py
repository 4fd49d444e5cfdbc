"""Text columns: tokens, claim splitting, scanning, masking, redaction and parsing.

Word class and white space are spelled out instead of using ``\\w`` and ``\\s``, because the short
forms are ASCII only in Java and would split accented words.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import fixed
from trustframe.functions.modeljson import parse_decision, redact_json  # noqa: F401

WORD_CLASS = r"\p{L}\p{N}_"
WORD = f"[{WORD_CLASS}]+"
SPACE = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                           0x202F, 0x205F, 0x3000]))
MARK = chr(0xE0FF)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once inside a larger expression."""
    return F.get(F.transform(F.array(value), body), 0)


def each(frame: DataFrame, keep: list[str], array: Column, value: str, pos: str | None = None) -> DataFrame:
    """One row per array element. Elements must not be null.

    Unlike a plain explode this does not make the optimizer add a filter that computes the array a
    second time, below every exchange.
    """
    if pos is None:
        return frame.select(*keep, F.explode_outer(array).alias(value)).filter(F.col(value).isNotNull())
    return frame.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def record(**fields: Column) -> Column:
    """A struct with explicit names, which survive inside nested lambdas."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def words_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def squeeze(col: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(col, SPACE + "+", " "))


def space_words(col: Column) -> Column:
    """Lowercase words between white space, punctuation kept."""
    return F.filter(F.split(squeeze(F.lower(col)), " "), lambda w: w != "")


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def token_set(col: Column, stop: list[str] | None = None) -> Column:
    distinct = F.array_distinct(tokens(col))
    return F.array_except(distinct, words_array(stop)) if stop else distinct


def space_word_set(col: Column, stop: list[str] | None = None) -> Column:
    distinct = F.array_distinct(space_words(col))
    return F.array_except(distinct, words_array(stop)) if stop else distinct


def overlap_share(left: Column, right: Column) -> Column:
    """Share of the left set that the right set holds; 0 if either is empty."""
    return F.when((F.size(left) > 0) & (F.size(right) > 0),
                  F.size(F.array_intersect(left, right)) / F.size(left)).otherwise(F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    return F.when((F.size(left) > 0) & (F.size(right) > 0),
                  F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right))
                  ).otherwise(F.lit(0.0))


def contains_any(col: Column, words: list[str]) -> Column:
    """Whether the text holds any of the words as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def count_contained(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(col, F.lit(w)).cast("int") for w in words])


# ---------------------------------------------------------------------------- claim splitting

def _any_abbreviation() -> str:
    return "(?i)" + "|".join(re.escape(a) for a in fixed.ABBREVIATIONS)


def claims(col: Column) -> Column:
    """Split an answer into claims.

    A sentence ends at ``.``, ``!`` or ``?`` before a blank or the end, unless a capital letter
    stands before it or the point belongs to an abbreviation. Abbreviations match in any case and
    come back in their usual spelling. Pieces shorter than five characters are dropped.
    """
    text = squeeze(col)
    protected = reduce(
        lambda acc, item: F.regexp_replace(acc, "(?i)" + re.escape(item[1]), chr(0xE001 + item[0])),
        enumerate(fixed.ABBREVIATIONS), text)
    safe = F.when(F.rlike(text, F.lit(_any_abbreviation())), protected).otherwise(text)
    marked = F.regexp_replace(safe, r"(?<![A-Z])([.!?])(?=\s|$)", "$1" + MARK)

    def restore(piece: Column) -> Column:
        back = reduce(
            lambda acc, item: F.replace(acc, F.lit(chr(0xE001 + item[0])), F.lit(item[1])),
            enumerate(fixed.ABBREVIATIONS), piece)
        return F.when(F.rlike(piece, F.lit(f"[{chr(0xE001)}-{chr(0xE0FE)}]")), back).otherwise(piece)

    pieces = F.transform(F.split(marked, MARK), lambda p: restore(F.trim(p)))
    return F.filter(F.coalesce(pieces, F.array().cast("array<string>")), lambda p: F.length(p) >= 5)


def depends_on_previous(claim: Column) -> Column:
    """Whether one of the first three words is a pronoun or connector."""
    first = F.transform(F.slice(space_words(claim), 1, 3),
                        lambda w: F.regexp_replace(w, r"^[.,;:?!]+|[.,;:?!]+$", ""))
    return F.arrays_overlap(first, words_array(fixed.CONNECTORS))


def sentences_at_stops(col: Column, shortest: int = 10) -> Column:
    """Cut after ``.!?`` and white space; keep trimmed sentences of at least ``shortest``."""
    parts = F.transform(F.split(col, r"(?<=[.!?])" + SPACE + "+"), lambda s: squeeze_ends(s))
    return F.filter(parts, lambda s: F.length(s) >= shortest)


def squeeze_ends(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def sentences_at_points(col: Column, shortest: int = 1) -> Column:
    """Cut at every point; keep trimmed sentences of at least ``shortest`` characters."""
    parts = F.transform(F.split(col, r"\."), lambda s: squeeze_ends(s))
    return F.filter(parts, lambda s: F.length(s) >= shortest)


def sentences_loose(col: Column) -> Column:
    """Points, line ends and semicolons before a blank all end a sentence."""
    text = F.regexp_replace(F.regexp_replace(col, "\r", " "), "\n|; ", ". ")
    return sentences_at_points(text)


def has_divergence_marker(col: Column) -> Column:
    plain = F.translate(F.lower(col), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    return contains_any(plain, fixed.DIVERGENCE_MARKERS)


# ---------------------------------------------------------------------------- personal data

def pii_count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit("(?i)" + pattern))


MASK_ORDER = ["email", "cartao_credito", "cnpj", "cpf", "telefone_br", "rg", "ssn", "cep"]


def mask_pii(col: Column) -> Column:
    """Mask personal data, longest forms first so a part is not masked before the whole."""
    patterns = {kind: pattern for kind, pattern, _ in fixed.PII_PATTERNS}
    out = col
    for kind in MASK_ORDER:
        if kind == "email":
            out = F.regexp_replace(
                out, r"([a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "$1***@$2")
        elif kind == "cartao_credito":
            out = F.regexp_replace(
                out, r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?(\d{4})", "****-****-****-$1")
        elif kind == "cpf":
            out = F.regexp_replace(out, r"\d{3}\.?\d{3}\.?\d{3}-?(\d{2})", "***.***.***-$1")
        else:
            out = F.regexp_replace(out, patterns[kind], "[REDACTED]")
    return out


# ---------------------------------------------------------------------------- secrets

def is_secret_key(key: Column) -> Column:
    lower = F.lower(key)
    return contains_any(lower, fixed.SECRET_KEY_PARTS) & ~lower.isin(fixed.TOKEN_COUNT_KEYS)


def redact_map(attributes: Column) -> Column:
    """Replace the values of secret keys in a string map."""
    return F.transform_values(
        attributes, lambda k, v: F.when(is_secret_key(k), F.lit("[REDACTED]")).otherwise(v))


def replace_literal(col: Column, secrets: list[str]) -> Column:
    """Replace known secret strings wherever they stand."""
    return reduce(lambda acc, s: F.replace(acc, F.lit(s), F.lit("[REDACTED]")), secrets, col)


# ---------------------------------------------------------------------------- model output

FACT_LIST = "array<struct<content:string,type:string,confidence:double,entities:array<string>>>"


def parse_fact_list(text: Column) -> Column:
    """Facts from a model's text: the outermost JSON list; unknown types count as definitions."""
    listed = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), FACT_LIST)
    kinds = words_array(fixed.FACT_TYPES)

    def fact(f: Column) -> Column:
        kind = F.lower(F.coalesce(f["type"], F.lit("definition")))
        return record(content=F.coalesce(f["content"], F.lit("")),
                      fact_type=F.when(F.array_contains(kinds, kind), kind).otherwise(F.lit("definition")),
                      confidence=F.coalesce(f["confidence"], F.lit(0.7)),
                      entities=F.coalesce(f["entities"], F.array().cast("array<string>")))

    return F.coalesce(F.transform(listed, fact), F.array().cast(
        "array<struct<content:string,fact_type:string,confidence:double,entities:array<string>>>"))


def parse_label(text: Column) -> Column:
    """Struct (label, confidence, evidence_doc_idx) of a judge's JSON; unknown labels are unsupported."""
    label = F.get_json_object(text, "$.label")
    return record(
        label=F.when(label.isin("supported", "unsupported", "contradicted"), label).otherwise(F.lit("unsupported")),
        confidence=F.coalesce(F.get_json_object(text, "$.confidence").try_cast("double"), F.lit(0.0)),
        evidence_doc_idx=F.get_json_object(text, "$.evidence_doc_idx").try_cast("int"))


def guarded_decision(decision: Column, parse_status: Column, query: Column, evidence: Column) -> Column:
    """Correct a TRUE decision that its evidence forbids or does not cover."""
    seen, asked = F.lower(evidence), F.lower(query)
    uncovered = reduce(
        lambda a, b: a | b,
        [F.contains(asked, F.lit(m)) & ~F.contains(seen, F.lit(m)) for m in fixed.SCOPE_MARKERS])
    return (F.when(parse_status != "valid", F.lit("UNDECIDABLE"))
            .when(decision != "TRUE", decision)
            .when(contains_any(seen, fixed.PROHIBITION_MARKERS), F.lit("FALSE"))
            .when(uncovered, F.lit("UNDECIDABLE"))
            .otherwise(decision))


# ---------------------------------------------------------------------------- numbers with units

NUMBER_WITH_UNIT = (rf"\b(\d+(?:[.,]\d+)?)\b\s*"
                    rf"([{fixed.UNIT_LETTERS}]+(?:\s+[{fixed.UNIT_LETTERS}]+)?)?")


def numbers_with_units(col: Column) -> Column:
    """Array of (value, unit): digits without separators, unit words without stop words."""
    values = F.regexp_extract_all(col, F.lit(NUMBER_WITH_UNIT), F.lit(1))
    units = F.regexp_extract_all(col, F.lit(NUMBER_WITH_UNIT), F.lit(2))

    def clean(unit: Column) -> Column:
        kept = F.filter(space_words(unit), lambda w: (F.length(w) > 2)
                        & ~F.array_contains(words_array(fixed.UNIT_STOPWORDS), w))
        return F.array_join(kept, " ")

    pairs = F.zip_with(values, units, lambda v, u: record(
        value=F.regexp_replace(v, "[.,]", ""), unit=clean(u)))
    return F.filter(pairs, lambda p: p["unit"] != "")


def units_alike(a: Column, b: Column) -> Column:
    """One unit holds the other, or they differ by at most a fifth of the longer one."""
    close = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) >= 0.8
    return F.contains(a, b) | F.contains(b, a) | close


def numeric_conflict(left: Column, right: Column) -> Column:
    """Whether the two (value, unit) arrays give another value for a like unit."""
    return F.exists(left, lambda a: F.exists(
        right, lambda b: (a["value"] != b["value"]) & units_alike(a["unit"], b["unit"])))


# ---------------------------------------------------------------------------- ids

def text_digest(*parts: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)
