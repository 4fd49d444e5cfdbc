"""Readers of record files, each split into what is usable and what is not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions import fixed
from trustframe.sources import schemas

BAD = "_corrupt_record"


@dataclass
class Split:
    """Rows that passed the checks and rows that did not, with the reason."""

    valid: DataFrame
    quarantine: DataFrame


def split_by(frame: DataFrame, problems: dict[str, Column]) -> Split:
    """Quarantine rows with any problem; ``problems`` maps a reason to a condition."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in problems.items()]))
    checked = frame.withColumn("problems", reasons)
    return Split(checked.filter(F.size("problems") == 0).drop("problems"), checked.filter(F.size("problems") > 0))


def read_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines with a fixed schema; a broken line keeps its text in ``_corrupt_record``."""
    return (spark.read.schema(f"{ddl}, {BAD} string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD).json(path))


def read_cases(spark: SparkSession, path: str) -> Split:
    frame = read_lines(spark, path, schemas.CASE)
    return split_by(frame, {
        "broken line": F.col(BAD).isNotNull(), "no case_id": F.col("case_id").isNull(),
        "no query": F.coalesce("query", F.lit("")) == "", "no documents": F.col("documents").isNull()})


def case_tables(cases: DataFrame) -> dict[str, DataFrame]:
    """Cases as flat tables: cases, documents, relevant and retrieved ids with their place."""
    def ids(column: str) -> DataFrame:
        return cases.select("case_id", F.posexplode(column).alias("pos", "document_id"))

    return {
        "cases": cases.select("case_id", "query", "answer", "expected_decision", "metadata"),
        "documents": cases.select("case_id", F.posexplode("documents").alias("pos", "d")).select("case_id", "pos", "d.*"),
        "relevant": ids("relevant_document_ids"), "retrieved": ids("retrieved_document_ids")}


def read_samples(spark: SparkSession, path: str) -> Split:
    frame = read_lines(spark, path, schemas.SAMPLE)
    return split_by(frame, {
        "broken line": F.col(BAD).isNotNull(), "no id": F.col("id").isNull(), "no lang": F.col("lang").isNull(),
        "no question": F.col("question").isNull(), "no answer": F.col("answer").isNull(),
        "no contexts": F.col("contexts").isNull(),
        "bad span": F.exists("gold.unsupported_spans", lambda s: s["end"] < s["start"])})


def sample_profile(samples: DataFrame) -> DataFrame:
    """Totals, mean contexts and mean answer length per language and overall."""
    out = samples.rollup("lang").agg(
        F.count("*").alias("samples"), F.avg(F.size("contexts")).alias("mean_contexts"),
        F.avg(F.length("answer")).alias("mean_answer_chars"))
    return out.withColumn("lang", F.coalesce("lang", F.lit("all")))


def with_language(samples: DataFrame, lang: str) -> DataFrame:
    return samples if lang == "all" else samples.filter(F.lower(F.trim("lang")) == lang.lower().strip())


def with_gold(samples: DataFrame) -> DataFrame:
    return samples.filter(F.size("gold.claims") > 0)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Declared label counts of a dataset manifest as (value, declared)."""
    frame = spark.read.option("multiLine", True).schema("labels map<string,bigint>").json(path)
    return frame.select(F.explode("labels").alias("value", "declared"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRACE).json(path)


def read_ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines of a folder; broken lines are skipped."""
    frame = spark.read.schema(schemas.LEDGER_LINE).option("mode", "DROPMALFORMED").json(path)
    none = F.array().cast("array<string>")
    return frame.filter(F.col("query_id").isNotNull()).select(
        "query_id", *[F.coalesce(f"prove.{c}", none).alias(c) for c in ("proved", "rejected", "undecidable")])


def read_fact_files(spark: SparkSession, path: str) -> DataFrame:
    """Fact entries of fact files with their domain and source."""
    frame = spark.read.option("multiLine", True).schema(schemas.FACT_FILE).json(path)
    return frame.select("domain", F.coalesce("source", F.input_file_name()).alias("source"),
                        F.explode("facts").alias("f")).select("domain", "source", "f.*")


def read_rules(spark: SparkSession, path: str) -> Split:
    """Compliance rules; records with an unknown standard or severity are set aside."""
    frame = read_lines(spark, path, schemas.RULE)
    frame = frame.withColumn("enabled", F.coalesce("enabled", F.lit(True))).withColumn(
        "is_regex", F.coalesce("is_regex", F.lit(False)))
    return split_by(frame, {
        "broken line": F.col(BAD).isNotNull(), "no rule_id": F.col("rule_id").isNull(),
        "unknown standard": ~F.col("standard").isin(fixed.STANDARDS),
        "unknown severity": ~F.col("severity").isin(fixed.SEVERITIES)})


def read_annotations(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    return (spark.read.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"')
            .option("multiLine", True).schema(schemas.ANNOTATION).csv(path))


def check_decisions(decisions: DataFrame) -> Split:
    """Decision records: known values, spans in order, and no action against the decision."""
    d, a = F.col("decision"), F.col("recommended_action")
    return split_by(decisions, {
        "unknown decision": ~F.coalesce(d.isin("TRUE", "FALSE", "UNDECIDABLE"), F.lit(False)),
        "confidence out of range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "TRUE cannot block or abstain": (d == "TRUE") & a.isin("block", "abstain"),
        "FALSE cannot allow": (d == "FALSE") & (a == "allow"),
        "span ends before it starts": F.exists("evidence", lambda e: e["span_end"] < e["span_start"])})
