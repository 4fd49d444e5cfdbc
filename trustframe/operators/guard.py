"""Guardrail scans: compliance rules, personal data, attack detectors and the input risk."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import fixed, text, truth

SNIPPET = 50
RISK_LIMIT = 0.7
MOST_RULES = 5000
VIOLATION = ("struct<rule_id:string,standard:string,severity:string,severity_rank:int,description:string,"
             "remediation:string,matched:string,position:int,snippet:string>")


@dataclass
class Rule:
    """One compliance rule. Rules are configuration and compile to columns of one scan."""

    rule_id: str
    standard: str
    severity: str
    is_regex: bool
    patterns: list[str]
    description: str = ""
    remediation: str = ""
    context_required: list[str] = field(default_factory=list)
    exceptions: list[str] = field(default_factory=list)
    scope: str | None = None
    enabled: bool = True


def default_rules(standards: list[str] | None = None) -> list[Rule]:
    return [Rule(i, std, sev, rx, pats, desc, fix, ctx)
            for i, std, sev, rx, pats, desc, fix, ctx in fixed.COMPLIANCE_RULES
            if standards is None or std in standards]


def rules_from_frame(frame: DataFrame) -> list[Rule]:
    """Rules of a table as configuration. The table must be small; more rows are an error."""
    rows = frame.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; split them by tenant")
    names = Rule.__dataclass_fields__
    def value(row, name):
        v = row[name] if name in row else None
        return (list(v or []) if name in ("patterns", "context_required", "exceptions") else v)
    return [Rule(**{n: value(r, n) for n in names if value(r, n) is not None}) for r in rows]


def scan(frame: DataFrame, column: str, rules: list[Rule], context_keys: str | None = None,
         scope: str | None = None, out: str = "violations") -> DataFrame:
    """Add the violations of each text: the first match of every (rule, pattern).

    All patterns are columns of one projection. A rule needs one of its context keys in the row's
    ``context_keys`` array, and is switched off by any of its exceptions standing in the text.
    """
    active = [r for r in rules if r.enabled and (r.scope is None or scope is None or r.scope == scope)
              and (not r.context_required or context_keys is not None)]
    pairs = [(r, p) for r in active for p in r.patterns]
    words = [(r, p) for r, p in pairs if not r.is_regex]
    regexes = [(r, p) for r, p in pairs if r.is_regex]
    lower = f"_{column}_lower"
    body = F.col(column)
    frame = frame.withColumn(lower, F.lower(body))

    def allowed(rule: Rule, found: Column) -> Column:
        if rule.context_required:
            found = F.when(F.arrays_overlap(F.col(context_keys), text.words_array(rule.context_required)), found)
        if rule.exceptions:
            excepted = text.contains_any(F.col(lower), [e.lower() for e in rule.exceptions])
            found = F.when(~excepted, found)
        return found

    positions = F.array(*[allowed(r, F.instr(F.col(lower), p.lower())) for r, p in words]) if words else (
        F.array().cast("array<int>"))
    matches = F.array(*[allowed(r, F.regexp_extract(body, "(?i)" + p, 0)) for r, p in regexes]) if regexes else (
        F.array().cast("array<string>"))
    frame = frame.withColumn("_positions", positions).withColumn("_matches", matches)
    # where the match stands, which for a pattern with context isn't where its text stands first
    places = F.array(*[F.when(F.get("_matches", F.lit(i)) != "", F.regexp_instr(body, F.lit("(?i)" + p)))
                       for i, (_, p) in enumerate(regexes)])

    def meta(items: list[tuple[Rule, str]]) -> Column:
        return F.array(*[text.record(
            rule_id=F.lit(r.rule_id), standard=F.lit(r.standard), severity=F.lit(r.severity),
            severity_rank=F.lit(fixed.SEVERITIES.index(r.severity)), remediation=F.lit(r.remediation),
            description=F.lit(r.description), size=F.lit(len(p))) for r, p in items])

    def violation(m: Column, matched: Column, at: Column) -> Column:
        start = F.greatest(F.lit(0), at - SNIPPET)
        return text.record(
            rule_id=m["rule_id"], standard=m["standard"], severity=m["severity"],
            severity_rank=m["severity_rank"], description=m["description"], remediation=m["remediation"],
            matched=matched, position=at,
            snippet=F.substring(body, start + 1, at + F.length(matched) + SNIPPET - start))

    found = []
    if words:
        hits = F.filter(F.transform("_positions", lambda p, i: text.record(p=p, i=i)), lambda h: h["p"] > 0)
        found.append(F.transform(hits, lambda h: text.let(F.get(meta(words), h["i"]), lambda m: violation(
            m, F.substring(body, h["p"], m["size"]), h["p"] - 1))))
    if regexes:
        frame = frame.withColumn("_places", places)
        hits = F.filter(F.transform("_matches", lambda p, i: text.record(p=p, i=i, at=F.get("_places", i))),
                        lambda h: h["p"] != "")
        found.append(F.transform(hits, lambda h: violation(F.get(meta(regexes), h["i"]), h["p"], h["at"] - 1)))
    none = F.array().cast(f"array<{VIOLATION}>")
    return frame.withColumn(out, F.concat(*found) if found else none).drop("_positions", "_matches", "_places", lower)


def violation_rows(scanned: DataFrame, keys: list[str], column: str = "violations") -> DataFrame:
    return text.each(scanned, keys, F.col(column), "v").select(*keys, "v.*")


def ranked_violations(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of each text, most severe first, then by rule and position."""
    ordered = F.array_sort(F.transform("violations", lambda v: text.record(
        severity_rank=v["severity_rank"], rule_id=v["rule_id"], position=v["position"])))
    return text.each(scanned, keys, ordered, "v", "place").select(*keys, "place", "v.*")


def status(violations: Column) -> Column:
    def any_of(severity: str) -> Column:
        return F.exists(violations, lambda v: v["severity"] == severity)

    return (F.when(F.size(violations) == 0, F.lit("compliant"))
            .when(any_of("critical"), F.lit("critical_violation"))
            .when(any_of("high"), F.lit("high_risk")).otherwise(F.lit("needs_review")))


def blocking(violations: Column) -> Column:
    return F.exists(violations, lambda v: v["severity"].isin("critical", "high"))


def report(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Per text: status, whether it blocks, and counts by severity."""
    v = F.col("violations")

    def of(severity: str) -> Column:
        return F.size(F.filter(v, lambda x: x["severity"] == severity))

    return scanned.select(
        *keys, status(v).alias("status"), blocking(v).alias("blocking"),
        F.size(v).alias("total_violations"), *[of(s).alias(s) for s in fixed.SEVERITIES])


def mask_rules(column: Column, rules: list[Rule]) -> Column:
    """Mask what the rules find, keeping the last digits of cards, phones and tax numbers."""
    out = column
    for rule in rules:
        for pattern in rule.patterns:
            what = rule.description.lower()
            found = "(?i)" + (pattern if rule.is_regex else _literal(pattern))
            if "cartão" in what:
                out = F.regexp_replace(out, found + r"(?<=(\d{4}))" if rule.rule_id == "PCI-CC-001" else found,
                                       "****-****-****-$1" if rule.rule_id == "PCI-CC-001" else "****")
            elif "cpf" in what:
                out = F.regexp_replace(out, found + r"(?<=(\d{2}))", "***.***.***-$1")
            elif "telefone" in what:
                out = F.regexp_replace(out, found + r"(?<=(\d{4}))", "(**) *****-$1")
            elif "email" in what:
                out = F.regexp_replace(
                    out, r"([a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "$1***@$2")
            else:
                out = F.regexp_replace(out, found, "[REDACTED]")
    return out


def _literal(keyword: str) -> str:
    return "\\Q" + keyword + "\\E"


# ---------------------------------------------------------------------------- input risk

def _pii(column: str) -> list[tuple[str, float, Column]]:
    """Counts per kind of personal data, gated by a cheap test every match must pass."""
    digits = F.rlike(F.col(column), F.lit(r"\d\d"))
    at_sign = F.contains(F.col(column), F.lit("@"))
    return [(kind, sev, F.when(at_sign if kind == "email" else digits,
                               text.pii_count(F.col(column), pattern)).otherwise(F.lit(0)))
            for kind, pattern, sev in fixed.PII_PATTERNS]


def pii_counts(frame: DataFrame, column: str) -> DataFrame:
    return frame.select("*", *[count.alias(f"n_{kind}") for kind, _, count in _pii(column)])


def _flag(found: Column) -> Column:
    return F.coalesce(found.cast("int"), F.lit(0))


def threat_signals(column: str) -> list[tuple[str, str, float, Column]]:
    """(threat type, kind, severity, count) of every detector with a fixed severity."""
    body, lower = F.col(column), F.lower(F.col(column))
    out = [("pii_exposure", k, sev, n) for k, sev, n in _pii(column)]
    for kind, sev, words in fixed.INJECTION_KEYWORDS:
        threat = "jailbreak_attempt" if kind == "jailbreak" else "prompt_injection"
        out.append((threat, kind, sev, _flag(text.contains_any(lower, words))))
    for kind, sev, words in fixed.INAPPROPRIATE_KEYWORDS:
        out.append(("inappropriate_content", kind, sev, _flag(text.contains_any(lower, words))))
    for kind, pattern, sev in fixed.ENCODING_PATTERNS:
        out.append(("encoding_attack", kind, sev, _flag(F.rlike(body, F.lit("(?i)" + pattern)))))
    for kind, sev, patterns in fixed.TECHNICAL_PATTERNS:
        threat = "sql_injection" if kind == "sql_injection" else "command_injection"
        any_of = F.rlike(body, F.lit("(?id)" + "|".join(patterns)))
        out.append((threat, kind, sev, _flag(any_of)))
    return out


def intent_matches(column: str) -> Column:
    lower = F.lower(F.col(column))
    total = F.lit(0)
    for group in fixed.INTENT_GROUPS:
        every = F.lit(True)
        for word in group:
            every = every & F.contains(lower, F.lit(word))
        total = total + _flag(every)
    return total


def shield(frame: DataFrame, column: str, violations: str | None = None, rate_exceeded: str | None = None,
           undecided: str = "allow_with_flag", limit: float = RISK_LIMIT) -> DataFrame:
    """Add threats, risk, decision and whether the input is allowed.

    ``violations`` names a scanned violations column and ``rate_exceeded`` a boolean column when
    those layers are wanted. Works on a stream as well: it is a projection.
    """
    signals = threat_signals(column)
    frame = frame.withColumn("_n", F.array(*[c for *_, c in signals])).withColumn(
        "_intent", intent_matches(column))
    n = [F.get("_n", i) for i in range(len(signals))]
    intent = F.when(F.col("_intent") > 0, F.least(F.lit(0.95), 0.5 + 0.2 * F.col("_intent")))
    parts = [(t, F.when(c > 0, F.lit(sev)), c, c * F.lit(sev)) for (t, _, sev, _), c in zip(signals, n)]
    parts.append(("malicious_intent", intent, F.when(intent.isNotNull(), 1).otherwise(0),
                  F.coalesce(intent, F.lit(0.0))))
    if rate_exceeded:
        hit = F.col(rate_exceeded)
        parts.append(("rate_abuse", F.when(hit, F.lit(0.8)), _flag(hit), _flag(hit) * 0.8))
    if violations:
        weight = F.transform(violations, lambda v: F.when(v["severity"].isin("critical", "high"), F.lit(0.9))
                             .otherwise(F.lit(0.6)))
        parts.append(("compliance_violation", F.array_max(weight), F.size(violations),
                      F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)))
    top, count, total = F.greatest(*[p[1] for p in parts]), F.lit(0), F.lit(0.0)
    for _, _, c, s in parts:
        count, total = count + c, total + s
    frame = (frame.withColumn("threats", count).withColumn("_top", F.coalesce(top, F.lit(0.0)))
             .withColumn("_sum", total)
             .withColumn("threat_types", F.array_sort(F.array_distinct(F.filter(F.array(*[
                 F.when(c > 0, F.lit(t)) for t, _, c, _ in parts]), lambda x: x.isNotNull())))))
    risk = F.when(F.col("threats") > 0, 0.7 * F.col("_top") + 0.3 * F.col("_sum") / F.col("threats")
                  ).otherwise(F.lit(0.0))
    frame = frame.withColumn("risk", F.round(risk, 9)).drop("_n", "_intent", "_top", "_sum")
    r = F.col("risk")
    decision = (F.when(r >= limit, F.lit("FALSE")).when(r >= limit * 0.5, F.lit("UNDECIDABLE"))
                .otherwise(F.lit("TRUE")))
    state = (F.when(F.col("threats") == 0, truth.from_bool(F.lit(True), F.lit(0.95)))
             .when(r >= limit, truth.from_bool(F.lit(False), F.least(r, F.lit(0.95))))
             .when(r >= limit * 0.5, truth.undecidable(1 - r))
             .otherwise(truth.from_bool(F.lit(True), 1 - r)))
    allowed = (F.when(r >= limit, F.lit(False)).when(r >= limit * 0.5, F.lit(undecided != "block"))
               .otherwise(F.lit(True)))
    flagged = (decision == "UNDECIDABLE") & F.lit(undecided == "allow_with_flag")
    return (frame.withColumn("decision", decision).withColumn("state", state)
            .withColumn("allowed", allowed).withColumn("flagged", flagged))


def basic_safety(column: Column) -> Column:
    """Struct (allowed, violations) of the single-keyword safety check."""
    bad = F.contains(F.lower(column), F.lit("danger"))
    return text.record(allowed=~bad, violations=F.when(bad, text.words_array(["dangerous_request"]))
                       .otherwise(F.array().cast("array<string>")))
