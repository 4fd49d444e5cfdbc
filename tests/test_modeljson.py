import json
import random

import pytest
from pyspark.sql import functions as F

from trustframe.functions import modeljson as M

GOOD = '{"facts": [{"subject": "a", "relation": "is", "object": "b"}], "rules": [{"head": "h", "body": "b"}], "meta": {}}'


def marked(body):
    return f"BEGIN_HYPOTHESES_JSON\n{body}\nEND_HYPOTHESES_JSON"


def fenced(body):
    return f"```json\n{body}\n```"


def kind(text, strict=False):
    return M.hypotheses_of(text, strict)[0]


def test_values_equal_the_standard_reader():
    draw = random.Random(3)

    def value(depth):
        pick = draw.random()
        if depth == 0 or pick < 0.3:
            return draw.choice([0, -1.5e3, 'q"{}', "ü\\", True, None, "", "\n"])
        if pick < 0.6:
            return [value(depth - 1) for _ in range(draw.randint(0, 3))]
        return {draw.choice(["a", "b:", 'c"']): value(depth - 1) for _ in range(draw.randint(0, 3))}

    decoder = json.JSONDecoder()
    for _ in range(500):
        wanted = value(5)
        text = json.dumps(wanted, indent=draw.choice([None, 2]), ensure_ascii=draw.random() < 0.5)
        assert M.whole(text).value == wanted and M.whole(text + " x") is None
        cut = text[:draw.randint(0, len(text))]
        mixed = f"words {{ {cut} more {text} end"
        got = dict(M.objects(mixed))
        for at, char in enumerate(mixed):
            if char == "{":
                try:
                    found = decoder.raw_decode(mixed[at:])[0]
                except ValueError:
                    assert at not in got
                    continue
                assert got.get(at, {}) == found  # an empty object inside a string may be left out


def test_depth_and_length_do_not_matter(spark):
    deep = '{"n":' * 3000 + '{"answer": "yes", "decision": "true"}' + "}" * 3000
    long = json.dumps({"api_key": 'k"\\' * 350_000, "total_tokens": 5})
    nested = '{"a":[' * 200 + '{"password": ["s", {"x": "]"}]}' + "]}" * 200
    df = spark.createDataFrame([(deep, long, nested)], "deep string, long string, nested string")
    row = df.select(M.parse_decision(F.col("deep")).alias("d"), M.redact_json(F.col("long")).alias("l"),
                    M.redact_json(F.col("nested")).alias("n")).first()
    assert tuple(row["d"]) == ("yes", "TRUE", "valid")
    assert json.loads(row["l"]) == {"api_key": "[REDACTED]", "total_tokens": 5}
    assert '{"password":"[REDACTED]"}' in row["n"] and '"s"' not in row["n"]


@pytest.mark.parametrize("text, wanted", [
    ('{"a": {"User_Token": [1, "]"]}, "b": 1}', '{"a": {"User_Token":"[REDACTED]"}, "b": 1}'),
    ('{"\\u0061pi_key": "x"}', '{"\\u0061pi_key":"[REDACTED]"}'),
    ('{"input_tokens": 5, "note": "\\"secret\\": kept"}', '{"input_tokens": 5, "note": "\\"secret\\": kept"}'),
    ('log: {"token": {"a": "b', 'log: {"token":"[REDACTED]"'),
    ('5" wide, "secret" : abc, "x": 1}', '5" wide, "secret":"[REDACTED]", "x": 1}'),
    ('say "a":" {"api_key":"s"}', 'say "a":" {"api_key":"[REDACTED]"}'),
    ('[{"password": null}, {"password": 1.5}]', '[{"password":"[REDACTED]"}, {"password":"[REDACTED]"}]'),
    ("no json", "no json"), ("", "")])
def test_redaction(text, wanted):
    assert M.redacted(text) == wanted


def test_redaction_of_nulls(spark):
    df = spark.createDataFrame([(None,), ('{"token":1}',)], "t string")
    assert [r[0] for r in df.select(M.redact_json(F.col("t"))).collect()] == [None, '{"token":"[REDACTED]"}']


def test_one_block_of_hypotheses():
    assert kind(marked(GOOD)) is None and kind(fenced(GOOD)) is None and kind(f"so {{x}} {GOOD} {{}}") is None
    assert kind(marked(GOOD).lower()) is None
    assert kind(marked(GOOD) + marked(GOOD)) == "multiple_blocks" == kind(fenced(GOOD) + fenced(GOOD))
    assert kind(marked(GOOD) + fenced(GOOD)) is None  # marked blocks count first
    assert kind(GOOD, strict=True) == "no_sentinels" and kind(fenced(GOOD), strict=True) is None
    for nothing in (None, "", "  \n", "no json", '{"facts": [', marked('{"facts": [1,]}')):
        assert kind(nothing) == "no_sentinels"


@pytest.mark.parametrize("body, message", [
    ('{"facts": [], "rules": []}', "missing meta"), ('{"facts": {}, "rules": [], "meta": {}}', "facts is no list"),
    ('{"facts": [], "rules": [], "meta": []}', "meta is no object"), ("[1]", "not an object"),
    ('{"facts": [1], "rules": [], "meta": {}}', "facts 0 is no object"),
    ('{"facts": [{"subject": 1, "relation": 2}], "rules": [], "meta": {}}', "facts 0 lacks object"),
    ('{"facts": [], "rules": [{"head": 1}], "meta": {}}', "rules 0 lacks body")])
def test_faults_of_hypotheses(body, message):
    assert M.hypotheses_of(marked(body), False)[:2] == ("invalid_schema", message)


def test_hypotheses_as_columns(spark):
    nested = GOOD.replace('"b"}]', '{"host": {"port": [1, null]}, "code": "f() { }"}}]', 1)
    rows = [(1, nested), (2, "nothing"), (3, None)]
    got = {r["k"]: r["p"] for r in spark.createDataFrame(rows, "k int, t string").select(
        "k", M.parse_hypotheses(F.col("t")).alias("p")).collect()}
    fact = got[1]["facts"][0]
    assert (fact["subject"], fact["object"]) == ("a", '{"code":"f() { }","host":{"port":[1,null]}}')
    assert got[1]["rules"][0].asDict() == {"head": "h", "body": "b"} and got[1]["error_type"] is None
    assert got[2]["error_type"] == got[3]["error_type"] == "no_sentinels" and got[2]["facts"] is None
