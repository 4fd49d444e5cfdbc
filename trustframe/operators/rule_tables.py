"""Texts against tables of rules and policies of many tenants.

``guard.scan`` compiles a short list of rules into one projection. Here rules are rows: those of a tenant meet its
texts in cells of bounded size. In a cell all keywords, exceptions and the fixed parts of all patterns become one
automaton, every text is read once, and a pattern is only tried where its fixed part stands.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import fixed
from trustframe.functions.session import cut_lineage
from trustframe.operators import guard
from trustframe.operators.ordered import Running, running

#: Texts of a cell, about.
CELL_ROWS = 2048
OVERLAP = 0.35
WORD = re.compile(r"\w+")
#: Letters that a pattern without case takes for others, beyond their lower case.
FOLDS = str.maketrans({"ſ": "s", "ı": "i", "̇": "", "ς": "σ", "µ": "μ"})
RULE_COLUMNS = ("rule_id", "standard", "severity", "is_regex", "patterns", "description", "remediation",
                "context_required", "exceptions", "scope", "enabled")
POLICY_COLUMNS = ("policy_id", "state", "confidence", "subject", "object", "pattern", "scope")
FOUND = f"row bigint, violations array<{guard.VIOLATION}>, denied_by array<string>, allowed double"


def folded(text: str) -> str:
    return text.lower().translate(FOLDS)


#: What a pattern is made of: groups and classes, escapes, letters, repetitions.
PIECE = re.compile(r"(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<escape>\\.)|(?P<times>[*?]|\{\d*,?\d*\})|(?P<other>[.^$+()])|(?P<letter>.)",
                   re.DOTALL)


def fixed_part(pattern: str) -> str | None:
    """The longest run of letters that every match of a pattern surely holds, in lower case, or None if under three.

    Only what stands outside of groups counts, and nothing in a pattern with alternatives.
    """
    runs, run, depth = [], "", 0
    for piece in PIECE.finditer(pattern):
        kind, found = piece.lastgroup, piece[0]
        depth += (found == "(") - (found == ")")
        if kind == "letter" and found == "|":
            return None
        if depth == 0 and (kind == "letter" or kind == "escape" and not found[1].isalnum()):
            run += found[-1]
            continue
        runs.append(run[:-1] if kind == "times" else run)
        run = ""
    best = max(map(folded, [*runs, run]), key=len)
    return best if len(best) >= 3 else None


@dataclass
class Matcher:
    """The rules and policies of one tenant, ready for texts."""

    rules: list[dict]
    policies: list[dict]
    pairs: list[tuple[dict, str, re.Pattern | None, str | None]] = field(default_factory=list)
    automaton: ahocorasick.Automaton | None = None
    by_word: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self):
        parts: set[str] = set()
        for rule in self.rules:
            for pattern in rule["patterns"] or []:
                regex = re.compile(pattern, re.IGNORECASE) if rule["is_regex"] else None
                part = fixed_part(pattern) if regex else folded(pattern)
                self.pairs.append((rule, pattern, regex, part))
                parts.add(part)
            parts |= {folded(e) for e in rule["exceptions"] or []}
        for place, policy in enumerate(self.policies):
            policy["regex"] = re.compile(policy["pattern"], re.IGNORECASE) if policy["pattern"] else None
            policy["part"] = fixed_part(policy["pattern"]) if policy["pattern"] else None
            parts.add(policy["part"])
            words = WORD.findall(f"{policy['subject'] or ''} {policy['object'] or ''}".lower())
            for word in set(words) - set(fixed.OVERLAP_STOPWORDS):
                self.by_word.setdefault(word, []).append(place)
        parts -= {None, ""}
        if parts:
            self.automaton = ahocorasick.Automaton()
            for part in parts:
                self.automaton.add_word(part, part)
            self.automaton.make_automaton()

    def violations(self, text: str, keys: set[str], scope: str | None, standing: set[str]) -> list[dict]:
        out, lower = [], text.lower()
        for rule, pattern, regex, part in self.pairs:
            if part and part not in standing:
                continue
            if rule["scope"] and scope and rule["scope"] != scope:
                continue
            if rule["context_required"] and not keys & set(rule["context_required"]):
                continue
            if any(e.lower() in lower for e in rule["exceptions"] or []):
                continue
            if regex:
                match = regex.search(text)
                if match is None or not match[0]:
                    continue
                at, matched = match.start(), match[0]
            else:
                at = lower.find(pattern.lower())
                if at < 0:
                    continue
                matched = text[at:at + len(pattern)]
            out.append({**{c: rule[c] for c in ("rule_id", "standard", "severity", "description", "remediation")},
                        "severity_rank": fixed.SEVERITIES.index(rule["severity"]), "matched": matched, "position": at,
                        "snippet": text[max(0, at - guard.SNIPPET):at + len(matched) + guard.SNIPPET]})
        return out

    def held(self, text: str, scope: str | None, standing: set[str]) -> tuple[list[str], float | None]:
        """Policies that deny the text, and the highest confidence of one that allows it."""
        words = set(WORD.findall(text.lower())) - set(fixed.OVERLAP_STOPWORDS) if self.policies else set()
        shared = [0] * len(self.policies)
        for word in words:
            for place in self.by_word.get(word, ()):
                shared[place] += 1
        denied, allowed = [], None
        for count, policy in zip(shared, self.policies, strict=True):
            if policy["scope"] and scope and policy["scope"] != scope:
                continue
            hit = bool(words) and count / len(words) >= OVERLAP
            if not hit and policy["regex"] and (policy["part"] is None or policy["part"] in standing):
                hit = policy["regex"].search(text) is not None
            if hit and policy["state"] == "FALSE":
                denied.append(policy["policy_id"])
            elif hit and policy["state"] == "TRUE":
                allowed = max(allowed or 0.0, policy["confidence"])
        return sorted(denied), allowed

    def found(self, text: str | None, keys: list[str] | None, scope: str | None) -> dict:
        text = text or ""
        keys = set(keys or []) | ({scope} if scope else set())
        standing = {part for _, part in self.automaton.iter(folded(text))} if self.automaton else set()
        denied, allowed = self.held(text, scope, standing)
        return {"violations": self.violations(text, keys, scope, standing), "denied_by": denied, "allowed": allowed}


def _config(table: DataFrame, kind: str, columns: tuple[str, ...], tenant: str) -> DataFrame:
    """Rows of a table as (tenant, kind, JSON); columns that it lacks count as null."""
    have = [F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return table.select(F.col(tenant).alias("tenant"), F.lit(kind).alias("kind"), F.to_json(
        F.struct(*have), {"ignoreNullFields": "false"}).alias("body"))


def scan(texts: DataFrame, column: str, rules: DataFrame, policies: DataFrame | None = None,
         tenant: str = "tenant_id", context_keys: str | None = None, scope: str | None = "output",
         cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``violations``, ``denied_by`` and ``allowed`` to each text by the rules and policies of its tenant.

    ``rules`` has a tenant and the columns of ``guard.Rule``, ``policies`` a tenant and those of
    ``knowledge.TextPolicy``; rows of a null tenant hold for all tenants. A text without a tenant meets only those.
    ``context_keys`` names an array column; ``scope`` counts as a key, as required contexts see it. A violation is
    the first match of a (rule, pattern); an exception anywhere in the text switches its rule off. Disabled rules
    are left out; a pattern that isn't valid is an error. A null text counts as empty, repeated rows are each judged.

    A tenant's texts are dealt to as many cells as their number needs, so a large tenant is spread over tasks; its
    rules go to each of its cells. Nothing limits the number of rules.
    """
    keys = F.col(context_keys) if context_keys else F.lit(None).cast("array<string>")
    numbered = cut_lineage(texts.withColumn("_row", F.monotonically_increasing_id()))
    counts = numbered.groupBy(F.col(tenant).alias("tenant")).agg(F.ceil(F.count("*") / cell_rows).alias("cells"))
    named = counts.withColumn("name", F.coalesce(F.concat(F.lit("="), "tenant"), F.lit("-")))
    placed = cut_lineage(running(named, [], ["name"], {"last": Running("sum", F.col("cells"))}).select(
        "tenant", "cells", (F.col("last") - F.col("cells")).alias("first"), "last"))
    total = placed.agg(F.max("last")).first()[0] or 0
    config = _config(rules.where(F.coalesce(F.col("enabled"), F.lit(True))) if "enabled" in rules.columns else rules,
                     "rule", RULE_COLUMNS, tenant)
    if policies is not None:
        config = config.unionByName(_config(policies, "policy", POLICY_COLUMNS, tenant))
    own = config.where("tenant IS NOT NULL").join(placed, "tenant").select(
        "kind", "body", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("cell"))
    shared = config.where("tenant IS NULL").select("kind", "body", F.explode(
        F.sequence(F.lit(0), F.lit(max(total, 1) - 1)).cast("array<bigint>")).alias("cell"))
    marks = placed.select(F.col("tenant").alias("_tenant"), "cells", "first")
    dealt = numbered.join(marks, F.equal_null(F.col(tenant), F.col("_tenant"))).select(
        F.col("_row").alias("row"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"), keys.alias("keys"),
        (F.col("first") + F.pmod(F.xxhash64("_row"), "cells")).alias("cell"))
    schema = pa.schema([("row", pa.int64()), ("violations", pa.list_(pa.struct([
        (c, pa.int32() if c in ("severity_rank", "position") else pa.string()) for c in (
            "rule_id", "standard", "severity", "severity_rank", "description", "remediation", "matched", "position",
            "snippet")]))), ("denied_by", pa.list_(pa.string())), ("allowed", pa.float64())])

    def judge(cell: pa.Table, configured: pa.Table) -> pa.Table:
        parts: dict[str, list[dict]] = {"rule": [], "policy": []}
        for kind, body in zip(configured["kind"].to_pylist(), configured["body"].to_pylist(), strict=True):
            parts[kind].append(json.loads(body))
        matcher = Matcher(sorted(parts["rule"], key=lambda r: r["rule_id"]), parts["policy"])
        rows = []
        for batch in cell.to_batches(max_chunksize=256):
            for row, text, own_keys in zip(*[batch[c].to_pylist() for c in ("row", "text", "keys")], strict=True):
                rows.append({"row": row, **matcher.found(text, own_keys, scope)})
        return pa.Table.from_pylist(rows, schema)

    found = dealt.groupBy("cell").cogroup(own.unionByName(shared).groupBy("cell")).applyInArrow(judge, FOUND)
    return numbered.join(found.withColumnRenamed("row", "_row"), "_row").drop("_row")


def decided(scanned: DataFrame) -> DataFrame:
    """Adds decision, recommended_action and confidence to ``scan``'s rows.

    A blocking violation or a denying policy gives FALSE, any other violation UNDECIDABLE, else the text is TRUE with
    the confidence of the strongest policy that allows it.
    """
    out = F.col("violations")
    denied: Column = guard.blocking(out) | (F.size("denied_by") > 0)
    review = F.size(out) > 0

    def pick(no, unsure, yes) -> Column:
        return F.when(denied, F.lit(no)).when(review, F.lit(unsure)).otherwise(yes)

    return scanned.withColumns({
        "decision": pick("FALSE", "UNDECIDABLE", F.lit("TRUE")), "recommended_action": pick("block", "warn", F.lit("allow")),
        "confidence": pick(1.0, 0.5, F.coalesce("allowed", F.lit(1.0)))})
