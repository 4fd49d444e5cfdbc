"""Facts and concepts from documents: patterns, keywords, chunks and incremental sync."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import fixed, text

LEAST_CONFIDENCE = 0.6
FACTS_PER_DOCUMENT = 50
PER_CONCEPT = 10


def normalise(col: Column) -> Column:
    return F.trim(F.regexp_replace(text.squeeze(col), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def pattern_text(pattern: str) -> str:
    return pattern.replace("[W", "[" + text.WORD_CLASS)


def _regex(pattern: str) -> str:
    """The pattern with its free leading words tried only where a run of words begins.

    A match that starts inside a run also starts at the run's beginning, or where the last match
    ended, so the other places need no try and long texts stay linear.
    """
    start = rf"(?:\G|(?<![{text.WORD_CLASS}\s]))" if pattern.startswith("([W") else ""
    return "(?iu)" + start + pattern_text(pattern)


def _contents(body: Column, kind: str, pattern: str, names: list[str]) -> Column:
    """Fact texts of one pattern, null where a needed part is empty."""
    regex = _regex(pattern)
    groups = {n: F.regexp_extract_all(body, F.lit(regex), F.lit(i + 1)) for i, n in enumerate(names)}
    if kind == "temporal":
        return F.transform(F.regexp_extract_all(body, F.lit(regex), F.lit(0)), lambda w: F.trim(w))

    def joined(first: str, second: str, need_first: bool) -> Column:
        def build(a: Column, b: Column) -> Column:
            a, b = F.trim(a), F.trim(b)
            whole = F.concat(a, F.lit(": "), b)
            if need_first:
                return F.when((a != "") & (b != ""), whole)
            return F.when(b != "", F.when(a != "", whole).otherwise(b))
        return F.zip_with(groups[first], groups[second], build)

    if kind == "definition":
        return joined("term", "definition", True)
    if kind == "numeric" and "unit" in groups:
        return F.zip_with(groups["value"], groups["unit"], lambda v, u: F.when(
            F.trim(v) != "", F.concat(F.lit(": "), F.trim(v), F.when(u != "", F.concat(F.lit(" "), u)).otherwise(F.lit("")))))
    if kind == "numeric":
        return F.zip_with(groups["context"], groups["value"], lambda c, v: F.when(
            F.trim(v) != "", F.concat(F.trim(c), F.lit(": "), F.trim(v))))
    if kind == "rule" and "subject" in groups:
        return joined("subject", "rule", False)
    if kind == "constraint" and "action" in groups:
        return F.zip_with(groups["condition"], groups["action"], lambda c, a: F.when(
            (F.trim(c) != "") & (F.trim(a) != ""), F.concat(F.lit("Somente "), F.trim(c), F.lit(" pode "), F.trim(a))))
    if kind == "constraint" and "context" in groups:
        return joined("context", "constraint", False)
    only = groups[names[0]]
    return F.transform(only, lambda w: F.when(F.trim(w) != "", F.trim(w)))


def confidence(content: Column, kind: Column, lower_body: Column) -> Column:
    """0.7, more for longer, numeric and repeated facts, less for vague ones."""
    start = F.substring(F.lower(content), 1, 30)
    times = (F.length(lower_body) - F.length(F.replace(lower_body, start, F.lit("")))) / F.length(start)
    points = (F.lit(70) + F.when(F.length(content) > 20, 5).otherwise(0) + F.when(F.length(content) > 50, 5).otherwise(0)
              + F.when((kind == "numeric") & F.rlike(content, F.lit(r"\d+[.,]\d+")), 10).otherwise(0)
              - F.when(text.contains_any(F.lower(content), fixed.GENERIC_WORDS), 15).otherwise(0)
              + F.when(times > 1, 5).otherwise(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), points)) / 100.0


def pattern_facts(documents: DataFrame, keys: list[str], column: str = "text",
                  least: float = LEAST_CONFIDENCE, most: int = FACTS_PER_DOCUMENT) -> DataFrame:
    """Facts of each document: all patterns in one projection, first of equal texts, best first.

    ``most`` is the documented number of facts kept per document.
    """
    frame = documents.select(*keys, normalise(F.col(column)).alias("body")).withColumn("lower_body", F.lower("body"))

    def facts_of(kind: str, pattern: str, names: list[str], keywords: list[str]) -> Column:
        possible = text.contains_any(F.col("lower_body"), keywords)
        contents = F.when(possible, _contents(F.col("body"), kind, pattern, names)).otherwise(
            F.array().cast("array<string>"))
        return F.transform(contents, lambda c: text.record(kind=F.lit(kind), content=c))

    found = F.concat(*[facts_of(*row, words) for row, words in zip(fixed.FACT_PATTERNS, fixed.FACT_KEYWORDS)])
    frame = frame.withColumn("found", F.filter(found, lambda f: f["content"].isNotNull()))
    scored = F.transform("found", lambda f, i: text.record(
        content=f["content"], kind=f["kind"], place=i, key=F.substring(F.lower(F.trim(f["content"])), 1, 100),
        confidence=confidence(f["content"], f["kind"], F.col("lower_body"))))
    frame = frame.withColumn("scored", F.filter(scored, lambda f: f["confidence"] >= least))
    frame = frame.withColumn("names", F.transform("scored", lambda f: f["key"]))
    firsts = F.filter("scored", lambda f, i: F.array_position("names", f["key"]) == i + 1)
    ordered = F.slice(F.array_sort(F.transform(firsts, lambda f: text.record(
        rank=-f["confidence"], place=f["place"], content=f["content"], kind=f["kind"], confidence=f["confidence"]))), 1, most)
    return text.each(frame, keys, ordered, "f", "pos").select(
        *keys, "pos", F.col("f.content").alias("content"), F.col("f.kind").alias("fact_type"),
        F.round("f.confidence", 6).alias("confidence"))


def facts_by(documents: DataFrame, keys: list[str], extractor, column: str = "text") -> DataFrame:
    """Facts that a Python table function yields for each text: the keys, content, fact_type, confidence."""
    frame = documents.withColumn("_text", F.col(column))
    return frame.lateralJoin(extractor(F.col("_text").outer())).where(F.col("content").isNotNull()).select(
        *keys, "content", "fact_type", "confidence")


def merge_extractors(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of several extractors' facts; of equal texts in a document the surest stays."""
    rows = reduce(DataFrame.unionByName, parts)
    key = F.substring(F.lower(F.trim("content")), 1, 100)
    return rows.groupBy(*keys, key.alias("_key")).agg(F.max_by(
        F.struct("content", "fact_type", "confidence"), F.struct("confidence", F.col("content"))).alias("f")).select(*keys, "f.*")


def subject_of(content: Column, fact_type: Column) -> Column:
    """Subject of an extracted fact: what stands before the first colon, else by type."""
    head = F.trim(F.substring_index(content, ":", 1))
    return (F.when(F.contains(content, F.lit(":")) & (head != ""), head).when(fact_type == "constraint", F.lit("constraint"))
            .when(fact_type == "policy", F.lit("policy")).otherwise(F.lit("document_fact")))


def relation_of(fact_type: Column) -> Column:
    return (F.when(fact_type == "definition", F.lit("defined_as")).when(fact_type == "constraint", F.lit("constrained_by"))
            .when(fact_type == "policy", F.lit("governed_by")).when(fact_type == "synonym", F.lit("has_synonym"))
            .when(fact_type == "concept", F.lit("is_a")).otherwise(F.lit("has_fact")))


# ---------------------------------------------------------------------------- concepts

def concepts(documents: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """Regulation concepts named in each document with up to ten fact and constraint sentences.

    The sentences are searched only for concepts that a cheap test of the whole text leaves possible.
    """
    frame = documents.select(*keys, F.col(column).alias("body"), F.lower(F.col(column)).alias("lower_body"))
    sentences = text.sentences_loose(F.col("body"))

    def named_in(terms: list[str]) -> Column:
        # a text that holds a term, with any spacing, holds the term's longest word
        return text.contains_any(F.col("lower_body"), sorted({max(t.split(), key=len) for t in terms}))

    frame = frame.withColumn("sentences", F.transform(sentences, lambda s: text.record(
        raw=s, plain=text.squeeze(F.lower(s)))))

    def entry(framework: str, concept: str, articles: list[str], terms: list[str]) -> Column:
        named = F.when(named_in(terms), F.filter("sentences", lambda s: text.contains_any(s["plain"], terms)))
        forbids = lambda s: text.contains_any(s["plain"], fixed.CONCEPT_CONSTRAINT_MARKS)

        def keep(items: Column) -> Column:
            return F.slice(F.array_distinct(F.transform(items, lambda s: s["raw"])), 1, PER_CONCEPT)

        source = framework + (":" + ",".join(articles) if articles else "")
        return text.let(named, lambda n: text.record(
            framework=F.lit(framework), concept=F.lit(concept), source=F.lit(source),
            facts=keep(F.filter(n, lambda s: ~forbids(s))), constraints=keep(F.filter(n, forbids))))

    rows = text.each(frame, keys, F.array(*[entry(*row) for row in fixed.CONCEPT_TERMS]), "e")
    return rows.filter((F.size("e.facts") > 0) | (F.size("e.constraints") > 0)).select(*keys, "e.*")


# ---------------------------------------------------------------------------- chunks

def chunks(col: Column, max_tokens: int = 2000) -> Column:
    """Pack sentences greedily into chunks of at most ``4 * max_tokens`` characters."""
    limit = 4 * max_tokens
    sentences = F.split(col, r"(?<=[.!?])" + text.SPACE + "+")

    def step(acc: Column, s: Column) -> Column:
        full = F.length(acc["now"]) + F.length(s) > limit
        pushed = F.when(full & (acc["now"] != ""), F.concat(acc["done"], F.array(text.squeeze_ends(acc["now"])))
                        ).otherwise(acc["done"])
        return text.record(done=pushed, now=F.when(full, s).otherwise(F.concat(acc["now"], F.lit(" "), s)))

    start = text.record(done=F.array().cast("array<string>"), now=F.lit(""))
    packed = F.aggregate(sentences, start, step, lambda acc: F.when(
        acc["now"] != "", F.concat(acc["done"], F.array(text.squeeze_ends(acc["now"])))).otherwise(acc["done"]))
    return F.when(F.length(col) <= limit, F.array(col)).otherwise(packed)


def regroup(chunk_rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Chunks of one document back into one text, in order."""
    return chunk_rows.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order, content))), lambda c: c[content]), " ").alias("content"),
        F.count("*").alias("chunks"))


def first_hits(hits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First hit of each document over several sample queries."""
    rest = [c for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("h")).select(key, "h.*")


# ---------------------------------------------------------------------------- sync

def unprocessed(documents: DataFrame, processed: DataFrame, key: str, force: bool = False) -> DataFrame:
    return documents if force else documents.join(processed.select(key), key, "left_anti")


def sync(documents: DataFrame, processed: DataFrame, known: DataFrame, key: str, column: str = "text",
         force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new facts, one row of run statistics) of the documents not processed before.

    ``known`` is (content) of facts in the ontology; a content already there is not added again.
    """
    todo = unprocessed(documents, processed, key, force)
    facts = pattern_facts(todo, [key], column)
    distinct = facts.groupBy("content").agg(F.min_by(F.struct(key, "fact_type", "confidence"), key).alias("f"))
    added = distinct.join(known.select("content").distinct(), "content", "left_anti").select("content", "f.*")
    one = F.lit(1).alias("one")
    stats = (documents.agg(F.count("*").alias("documents_checked"), one)
             .join(todo.agg(F.count("*").alias("documents_synced"), one), "one")
             .join(facts.agg(F.count("*").alias("facts_extracted"), one), "one")
             .join(added.agg(F.count("*").alias("facts_added"), one), "one").drop("one"))
    return added, stats
