"""Quality rules as a ledger of failure bits: every rule is evaluated once, policies are applied to the bits later."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; the rule's place in its list is its bit, so lists only ever grow."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of what counts: any failure of a rule in ``strict`` rejects, or ``most`` failures of ``weak`` rules."""

    version: str
    strict: tuple[str, ...]
    weak: tuple[str, ...] = ()
    most: int = 2


#: Thresholds are ratios of whole numbers, compared without division.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("some_symbols", "10 * n_symbols > n_words"),
    Rule("some_repeated_words", "10 * n_repeat_words > n_words"),
    Rule("some_repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
)
BASE = ("few_words", "repeated_words")
POLICIES = (
    Policy("base", BASE),
    Policy("v1", (*BASE, "many_symbols", "short_words", "long_words", "repeated_lines"),
           ("some_symbols", "some_repeated_lines")),  # a repeated line is a repeated run of words too: counted once
)


def _window_hashes(words: Column) -> Column:
    """Hash of every window of five words, in their order."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words stand between white space; a null text has none. Lines are parts between ``\\n`` with at least one word.
    A word counts as repeated if a window of five words that holds it occurs twice or more in the text. Windows are
    compared by 64-bit hashes, sorted inside their row, so a text of one repeated word costs no more than another of
    its length and nothing is shuffled. Rows come out as they come in: repeated rows twice, a null doc_id as null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pieces = docs.select("doc_id", text.alias("text")).select("*", F.split("text", SPACE, -1).alias("pieces"))
    worded = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x, F.lit(" \t\n\v\f\r"))) > 0)
    words = pieces.select(
        "doc_id", F.filter("pieces", lambda x: x != "").alias("words"),
        (F.length("text") - F.size("pieces") + 1).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), worded.alias("lines"))
    counted = words.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _window_hashes(F.col("words")).alias("hashes"))
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    windows = counted.select("*", F.when(repeated, placed).otherwise(nothing).alias("windows")).drop("hashes")
    like = (lambda x, k, step: F.coalesce(F.get("windows", k + step)["h"] == x["h"], F.lit(False)))
    again = F.filter("windows", lambda x, k: like(x, k, 1) | F.when(k > 0, like(x, k, -1)).otherwise(F.lit(False)))
    starts = windows.select("*", F.sort_array(F.transform(again, lambda x: x["i"])).alias("starts")).drop("windows")
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("until"), F.lit(0).alias("total")),
        lambda s, i: F.struct((i + WINDOW).alias("until"),
                              (s["total"] + i + WINDOW - F.greatest(s["until"], i)).alias("total")),
        lambda s: s["total"])
    return starts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                         covered.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """``measured`` and ``failed``: bit k is set if rule k fails. At most 63 rules.

    Every rule is evaluated once; a rule whose condition is null doesn't fail. An empty table gives no rows.
    """
    rules = list(rules)
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    bits = F.lit(0).cast("long")
    for place, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << place).cast("long"))
                              .otherwise(F.lit(0).cast("long")))
    return measured(docs).withColumn("failed", bits)


def mask(names: Iterable[str], rules: Iterable[Rule] = RULES) -> int:
    """The bits of the named rules; an unknown name is an error."""
    places = {rule.name: place for place, rule in enumerate(rules)}
    return sum(1 << places[name] for name in set(names))


def rejected(policy: Policy, rules: Iterable[Rule] = RULES, without: int = 0) -> Column:
    """Whether the bits in ``failed`` reject a row; bits in ``without`` are left out."""
    strict = F.lit(mask(policy.strict, rules) & ~without).cast("long")
    weak = F.lit(mask(policy.weak, rules) & ~without).cast("long")
    failed = F.col("failed")
    return (failed.bitwiseAND(strict) != 0) | (F.bit_count(failed.bitwiseAND(weak)) >= policy.most)


def apply(rows: DataFrame, policy: Policy, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Adds ``kept`` and ``policy`` to a ledger; no text is read again."""
    return rows.withColumns({"kept": ~rejected(policy, rules), "policy": F.lit(policy.version)})


def ablations(rows: DataFrame, policies: Iterable[Policy] = POLICIES, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Per policy and rule: rows that fail the rule, that the policy rejects, and that only this rule rejects.

    Columns policy, rule, n_rows, n_failed, n_rejected, n_saved. Rows are first counted by their bits, so what follows
    works on at most one row per combination of failures that occurs. An empty ledger gives no rows.
    """
    rules = list(rules)
    counts = rows.groupBy("failed").agg(F.count("*").alias("n"))
    entries = []
    for policy in policies:
        for name in (*policy.strict, *policy.weak):
            bit = mask([name], rules)
            hit, out = F.col("failed").bitwiseAND(F.lit(bit).cast("long")) != 0, rejected(policy, rules)
            saved = out & ~rejected(policy, rules, bit)
            entries.append(F.struct(F.lit(policy.version).alias("policy"), F.lit(name).alias("rule"),
                                    hit.alias("hit"), out.alias("out"), saved.alias("saved")))
    total = (lambda flag: F.coalesce(F.sum(F.when(F.col(f"entry.{flag}"), F.col("n"))), F.lit(0)).cast("long"))
    return (counts.select("n", F.explode(F.array(*entries)).alias("entry"))
            .groupBy("entry.policy", "entry.rule")
            .agg(F.sum("n").alias("n_rows"), total("hit").alias("n_failed"), total("out").alias("n_rejected"),
                 total("saved").alias("n_saved")))


def judge(docs: DataFrame, policy: Policy = POLICIES[-1], rules: Iterable[Rule] = RULES) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's ``kept``, which is false wherever the base rules fail."""
    rules = list(rules)
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE, rules)).cast("long")) != 0
    rows = apply(ledger(docs, rules), policy, rules).withColumn("base_failed", base)
    return rows.withColumn("kept", F.col("kept") & ~F.col("base_failed"))
