"""JSON in model output and traces: an iterative scanner, run over Arrow batches.

Nothing here recurses and no pattern spans a value, so depth and length of a value don't matter: brackets are kept on
a list, and strings are read by a pattern that never goes back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trustframe.functions import fixed

STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
TOKEN = re.compile(rf"[ \t\n\r]*(?:(?P<mark>[{{}}\[\],:])|(?P<text>{STRING})"
                   r"|(?P<plain>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null))")
BLANK = re.compile(r"[ \t\n\r]*")
ANY_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.DOTALL)
KEY = re.compile(r'"([^"]*)"\s*:\s*')
#: A string that is followed by what may stand behind a value; others may begin with a stray quote.
CLEAR_STRING = re.compile(rf"{ANY_STRING.pattern}(?=\s*(?:[,}}\]]|$))", re.DOTALL)
SCALAR = re.compile(r"[^,}\]\s]*")
FENCE = re.compile(r"```(json)?\s*(.*?)\s*```", re.DOTALL | re.IGNORECASE)
#: What replaces a secret value.
REDACTED = "[REDACTED]"


@dataclass
class Reading:
    """What a scan from one bracket found: ``end`` is None if the value is broken off or wrong.

    ``closed`` has the objects that came to their end, by their first place, ``opened`` the first places of all
    objects that were begun, ``members`` (key, end of the key, first place and end of the value) of all objects.
    """

    value: object = None
    end: int | None = None
    closed: dict[int, dict] = field(default_factory=dict)
    opened: set[int] = field(default_factory=set)
    members: list[tuple[str, int, int, int]] = field(default_factory=list)


def _text(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


def read(text: str, at: int = 0) -> Reading:
    """The JSON value at ``at`` (after blanks), with every object inside it; what follows it is not looked at."""
    out = Reading()
    stack: list[tuple] = []  # container, first place, key, end of the key, first place of the value
    wanted, key, key_end, begin = "value", None, 0, 0
    while True:
        token = TOKEN.match(text, at)
        if token is None:
            return out
        at, kind, piece = token.end(), token.lastgroup, token[token.lastgroup]
        first = at - len(piece)
        if kind == "text" and wanted in ("key", "key or end"):
            wanted, key, key_end = "colon", _text(piece), at
            continue
        if piece == ":" and wanted == "colon":
            wanted = "value"
            continue
        if piece == "," and wanted == "comma or end":
            wanted = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        if piece in "{[" and kind == "mark" and wanted in ("value", "value or end"):
            if piece == "{":
                out.opened.add(first)
            stack.append(({} if piece == "{" else [], first, key, key_end))
            wanted = "key or end" if piece == "{" else "value or end"
            continue
        if kind == "mark":
            ending = {"}": ("key or end", "comma or end"), "]": ("value or end", "comma or end")}.get(piece, ())
            if wanted not in ending or not stack or isinstance(stack[-1][0], dict) != (piece == "}"):
                return out
            value, begin, key, key_end = stack.pop()
            if piece == "}":
                out.closed[begin] = value
        elif wanted in ("value", "value or end"):
            value, begin = _text(piece) if kind == "text" else json.loads(piece), first
        else:
            return out
        if not stack:
            out.value, out.end = value, at
            return out
        if isinstance(stack[-1][0], dict):
            stack[-1][0][key] = value
            out.members.append((key, key_end, begin, at))
        else:
            stack[-1][0].append(value)
        wanted = "comma or end"


def whole(text: str) -> Reading | None:
    """The reading of a text that is one JSON value and nothing else."""
    found = read(text)
    return found if found.end is not None and BLANK.match(text, found.end).end() == len(text) else None


def objects(text: str) -> Iterator[tuple[int, dict]]:
    """Every JSON object that stands in the text, nested ones too, by its first place.

    Objects inside a broken one are found in the same scan; only brackets that it took for parts of strings are
    tried again.
    """
    found: dict[int, dict] = {}
    seen: set[int] = set()
    at = text.find("{")
    while at >= 0:
        if at not in seen:
            reading = read(text, at)
            found |= reading.closed
            seen |= reading.opened
            if reading.end is not None:
                at = reading.end - 1
        at = text.find("{", at + 1)
    yield from sorted(found.items(), key=lambda x: x[0])


def is_secret(key: str) -> bool:
    lower = key.lower()
    return lower not in fixed.TOKEN_COUNT_KEYS and any(part in lower for part in fixed.SECRET_KEY_PARTS)


def _value_end(text: str, at: int) -> int:
    """End of the value at ``at`` in a text that may be no JSON; a value without an end reaches to that of the text."""
    if text[at:at + 1] == '"':
        string = ANY_STRING.match(text, at)
        return string.end() if string else len(text)
    if text[at:at + 1] not in ("{", "["):
        return SCALAR.match(text, at).end()
    depth = 0
    while at < len(text):
        char = text[at]
        if char == '"':
            string = ANY_STRING.match(text, at)
            if string is None:
                return len(text)
            at = string.end()
            continue
        depth += (char in "{[") - (char in "}]")
        at += 1
        if depth == 0:
            return at
    return len(text)


def _unescaped(key: str) -> str:
    string = re.fullmatch(STRING, f'"{key}"') if "\\" in key else None
    return json.loads(string[0]) if string else key


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """End of the key and end of the value of each secret member, outermost ones, in order."""
    reading = whole(text)
    if reading is not None:
        at = 0
        for key, key_end, _, end in sorted(reading.members, key=lambda m: m[1]):
            if key_end >= at and is_secret(key):
                yield key_end, end
                at = end
        return
    found = KEY.search(text)
    while found:
        at = found.end()
        if is_secret(_unescaped(found[1])):
            yield found.end(1) + 1, (at := _value_end(text, at))
        elif string := CLEAR_STRING.match(text, at):
            at = string.end()
        found = KEY.search(text, at)


def redacted(text: str) -> str:
    parts, at = [], 0
    for key_end, end in _secrets(text):
        parts += [text[at:key_end], ':"', REDACTED, '"']
        at = end
    return "".join([*parts, text[at:]])


def redact_json(text: Column) -> Column:
    """Replace the values of secret keys at any depth of a JSON text, objects and arrays as a whole.

    Text that isn't JSON as a whole (cut off, or with prose around) is searched for members; a value that doesn't
    end is replaced up to the end of the text. Null stays null.
    """
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    return run(text)


def decision_of(text: str | None) -> tuple[str, str, str]:
    """(answer, decision, parse_status) of a model's text; see ``parse_decision``."""
    text = text or ""
    candidates = [r.value for r in map(whole, [m[2] for m in FENCE.finditer(text)] + [text]) if r]
    for value in [*candidates, *(v for _, v in objects(text))]:
        if not isinstance(value, dict):
            continue
        answer, decision = value.get("answer"), value.get("decision")
        if isinstance(answer, str) and answer.strip() and isinstance(decision, str):
            if decision.strip().upper() in ("TRUE", "FALSE", "UNDECIDABLE"):
                return answer.strip(), decision.strip().upper(), "valid"
    return "", "UNDECIDABLE", "malformed"


def parse_decision(text: Column) -> Column:
    """Struct (answer, decision, parse_status) of a model's text.

    Looked at are fenced blocks, the whole text, then every object in it at any depth, by its place. The first with
    a non-empty text as its answer and a known decision wins; anything else is malformed and UNDECIDABLE.
    """
    @F.pandas_udf("answer string, decision string, parse_status string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decision_of(t) for t in texts], columns=["answer", "decision", "parse_status"])

    return run(text)


# ---------------------------------------------------------------------------- hypotheses

HYPOTHESES = ("error_type string, error_message string, "
              "facts array<struct<subject:string,relation:string,object:string>>, "
              "rules array<struct<head:string,body:string>>, meta string")
#: fixed values: marks around a block, members that must be there
SENTINELS = ("BEGIN_HYPOTHESES_JSON", "END_HYPOTHESES_JSON")
FACT_FIELDS = ("subject", "relation", "object")
RULE_FIELDS = ("head", "body")

BLOCK = re.compile(rf"{SENTINELS[0]}\s*(.+?)\s*{SENTINELS[1]}", re.DOTALL | re.IGNORECASE)


def compact(value: object) -> str | None:
    """A value as text: strings as they are, null as null, others as compact JSON with sorted keys.

    Containers are written from a list of what is still to come, so depth doesn't matter.
    """
    if value is None or isinstance(value, str):
        return value
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        written, item = todo.pop()
        if written:
            out.append(item)
        elif isinstance(item, dict):
            todo.append((True, "}"))
            pairs = sorted(item.items())
            for k, (key, inner) in reversed(list(enumerate(pairs))):
                todo += [(False, inner), (True, ("," if k else "") + json.dumps(key, ensure_ascii=False) + ":")]
            todo.append((True, "{"))
        elif isinstance(item, list):
            todo.append((True, "]"))
            for k, inner in reversed(list(enumerate(item))):
                todo += [(False, inner), (True, "," if k else "")]
            todo.append((True, "["))
        else:
            out.append(json.dumps(item, ensure_ascii=False))
    return "".join(out)


def schema_fault(value: object) -> str | None:
    """What is wrong with a set of hypotheses, or None."""
    if not isinstance(value, dict):
        return "not an object"
    for name, kind in (("facts", list), ("rules", list), ("meta", dict)):
        if name not in value:
            return f"missing {name}"
        if not isinstance(value[name], kind):
            return f"{name} is no {'list' if kind is list else 'object'}"
    for name, fields in (("facts", FACT_FIELDS), ("rules", RULE_FIELDS)):
        for place, item in enumerate(value[name]):
            if not isinstance(item, dict):
                return f"{name} {place} is no object"
            for part in fields:
                if part not in item:
                    return f"{name} {place} lacks {part}"
    return None


def hypotheses_of(text: str | None, strict: bool) -> tuple:
    """(error_type, error_message, facts, rules, meta) of a model's text; see ``parse_hypotheses``."""
    text = text or ""
    blocks = [r for r in map(whole, [m[1] for m in BLOCK.finditer(text)]) if r]
    if not blocks:
        blocks = [r for r in map(whole, [m[2] for m in FENCE.finditer(text) if m[1]]) if r]
    if not blocks and not strict:
        first = next(objects(text), None)
        blocks = [Reading(value=first[1])] if first else []
    if not blocks:
        return "no_sentinels", "no JSON found", None, None, None
    if len(blocks) > 1:
        return "multiple_blocks", f"{len(blocks)} blocks", None, None, None
    value = blocks[0].value
    fault = schema_fault(value)
    if fault:
        return "invalid_schema", fault, None, None, None
    facts = [{k: compact(f[k]) for k in FACT_FIELDS} for f in value["facts"]]
    rules = [{k: compact(r[k]) for k in RULE_FIELDS} for r in value["rules"]]
    return None, None, facts, rules, compact(value["meta"])


def parse_hypotheses(text: Column, strict: bool = False) -> Column:
    """Struct (error_type, error_message, facts, rules, meta) of a model's text; both errors are null if it is right.

    Blocks between the two sentinels count first, then blocks fenced as json, then, unless ``strict``, the first JSON
    object of the text. More than one block is refused. The object needs lists ``facts`` and ``rules`` and an object
    ``meta``; facts need subject, relation and object, rules head and body. Values that aren't texts come as JSON.
    """
    @F.pandas_udf(HYPOTHESES)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hypotheses_of(t, strict) for t in texts],
                            columns=["error_type", "error_message", "facts", "rules", "meta"], dtype=object)

    return run(text)
