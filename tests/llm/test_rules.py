import random
import re

import pytest

from trustframe.llm import rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for k in range(len(words) - 4):
        seen.setdefault(tuple(words[k:k + 5]), []).append(k)
    covered = {k + j for starts in seen.values() if len(starts) > 1 for k in starts for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines),
            len(lines) - len(set(lines)), len(covered))


def texts():
    draw = random.Random(8)
    for _ in range(150):
        words = [draw.choice(["a", "bb", "ü#", "漢字🙂", "|", "d"]) for _ in range(draw.randint(0, 60))]
        yield "".join(w + draw.choice([" ", "\n", "\t ", "\r\n", "\x0b"]) for w in words)


def measured(docs):
    return sorted(repr((r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                                                      "n_repeat_words")])) for r in rules.judge(docs).collect())


def test_measurements_by_hand(make_docs, odd_rows):
    rows = [*odd_rows, *enumerate(texts(), 100), (90, "a b \x1c c\x85d"), (91, " x y z v w x y z v w"), (92, "\n\n a\n a\na")]
    assert measured(make_docs(rows)) == sorted(repr((r[0], *by_hand(r[1]))) for r in rows)


def test_verdicts_follow_rules_and_policy(make_docs):
    rows = list(enumerate(texts()))
    for r in rules.judge(make_docs(rows)).collect():
        words, chars, symbols, lines, again, repeated = by_hand(rows[r["doc_id"]][1])
        fails = {"few_words": words < 10, "repeated_words": 100 * repeated > 20 * words,
                 "many_symbols": 10 * symbols > 3 * words, "short_words": chars < 2 * words,
                 "long_words": chars > 20 * words, "repeated_lines": 2 * again > lines,
                 "some_symbols": 10 * symbols > words, "some_repeated_words": 10 * repeated > words,
                 "some_repeated_lines": 10 * again > 3 * lines}
        assert r["failed"] == sum(fails[rule.name] << k for k, rule in enumerate(rules.RULES))
        assert r["base_failed"] == (fails["few_words"] or fails["repeated_words"])
        policy = rules.POLICIES[-1]
        out = any(fails[n] for n in policy.strict) or sum(fails[n] for n in policy.weak) >= policy.most
        assert r["kept"] == (not out) and r["policy"] == policy.version


def test_ablations_count_what_only_one_rule_rejects(make_docs):
    rows = rules.ledger(make_docs(list(enumerate(texts())))).cache()
    bits = [r["failed"] for r in rows.select("failed").collect()]

    def out(policy, value, without=0):
        strict, weak = (rules.mask(names) & ~without for names in (policy.strict, policy.weak))
        return bool(value & strict) or (value & weak).bit_count() >= policy.most

    wanted = {}
    for policy in rules.POLICIES:
        for name in (*policy.strict, *policy.weak):
            bit = rules.mask([name])
            wanted[policy.version, name] = (len(bits), sum(bool(b & bit) for b in bits), sum(out(policy, b) for b in bits),
                                            sum(out(policy, b) and not out(policy, b, bit) for b in bits))
    got = {(r["policy"], r["rule"]): tuple(r)[2:] for r in rules.ablations(rows).collect()}
    assert got == wanted


def test_policies_apply_to_a_stored_ledger(make_docs, tmp_path):
    rules.ledger(make_docs(list(enumerate(texts())))).write.parquet(str(tmp_path / "ledger"))
    rows = make_docs([]).sparkSession.read.parquet(str(tmp_path / "ledger"))
    kept = [rules.apply(rows, p).where("kept").count() for p in rules.POLICIES]
    assert kept[0] >= kept[1] > 0


def test_empty_tables_and_unknown_rules(make_docs):
    assert rules.judge(make_docs([])).collect() == [] and rules.ablations(rules.ledger(make_docs([]))).collect() == []
    with pytest.raises(KeyError):
        rules.mask(["no such rule"])
    with pytest.raises(ValueError):
        rules.ledger(make_docs([]), [rules.Rule(f"r{k}", "false") for k in range(64)])


def test_no_python_in_the_plan(make_docs):
    plan = rules.judge(make_docs([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
