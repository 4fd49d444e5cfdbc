"""Retrieval queries: every fiftieth vector is a case that is searched in all vectors.

Of its eight followers, those of its label are relevant, and the first two are its declared documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions.session import cut_lineage, read_table, read_texts
from trustframe.functions.vectors import hash_embedding_entries
from trustframe.operators import rag, search
from trustframe.plans import sqltext as S
from trustframe.plans.registry import query

NEIGHBOURS = 8
TOP_K = 3
RELATIVE = 0.85


def found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, top, first): every fiftieth vector asks for its nearest among all others."""
    vectors = read_table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    near = asked.select(F.col("vec_id").alias("case_id"), F.col("label").alias("case_label"),
                        F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + NEIGHBOURS)).alias("document_id"))
    judged = cut_lineage(near.join(vectors.select(F.col("vec_id").alias("document_id"), "label"), "document_id")
                         .where("label = case_label").select("case_id", "document_id"))
    gold = judged.groupBy("case_id").agg(F.array_sort(F.collect_list("document_id")).alias("relevant"))
    last = vectors.agg(F.max("vec_id")).first()[0]
    declared = F.filter(F.array(F.col("vec_id") + 1, F.col("vec_id") + 1, F.col("vec_id") + 2), lambda d: d <= last)
    cases = asked.select(
        F.col("vec_id").alias("case_id"), declared.alias("retrieved"),
        F.when(F.col("label") % 2 == 0, "TRUE").otherwise("FALSE").alias("expected_decision"),
        F.when(F.col("vec_id") % 100 == 0, "TRUE").when(F.col("label") % 5 > 0, "FALSE").alias("observed_decision")
    ).join(gold, "case_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<bigint>")))
    top, first = search.search(
        asked.select(F.col("vec_id").alias("case_id"), F.col("vec_id").alias("own_id"), F.col("embedding").alias("vector")),
        vectors.select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector")), TOP_K, judged)
    return cases, top, first


def results(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    cases, top, first = found(spark, sf)
    return rag.searched_results(cases, top, first, TOP_K, policy, 0.10, RELATIVE)


PAIRS_SQL = f"""
pairs AS (
  SELECT c.vec_id AS case_id, d.vec_id AS document_id,
         c.label = d.label AND d.vec_id BETWEEN c.vec_id + 1 AND c.vec_id + {NEIGHBOURS} AS relevant,
         round(list_dot_product(c.embedding::DOUBLE[], d.embedding::DOUBLE[])
               / (sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))
                  * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 9) AS score
  FROM embeddings c JOIN embeddings d ON d.vec_id <> c.vec_id WHERE c.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, document_id) AS rank FROM pairs),
base AS (
  SELECT e.vec_id AS case_id, count(r.document_id) AS n_docs,
         count(*) FILTER (WHERE r.relevant) AS n_gold, min(CASE WHEN r.relevant THEN r.rank END) AS first_rank,
         coalesce(max(r.score), 0) AS top1,
         coalesce(max(CASE WHEN r.relevant AND r.rank <= {TOP_K} THEN 1.0 END), 0.0) AS hit
  FROM embeddings e LEFT JOIN ranked r ON r.case_id = e.vec_id WHERE e.vec_id % 50 = 0 GROUP BY 1),
judged AS (SELECT vec_id AS case_id, CASE WHEN label % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS expected,
  CASE WHEN vec_id % 100 = 0 THEN 'TRUE' WHEN label % 5 > 0 THEN 'FALSE' END AS observed FROM embeddings WHERE vec_id % 50 = 0)
"""


@query("rag_rank_topk", f"""
WITH {PAIRS_SQL}
SELECT case_id, document_id, score, relevant, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= {TOP_K}""")
def rag_rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf)[1]


def stage_sql(policy: str) -> str:
    if policy == "adaptive":
        context = (f"SELECT r.case_id, r.document_id, r.relevant FROM ranked r JOIN base b USING (case_id) "
                   f"WHERE r.rank <= {TOP_K} AND r.score >= greatest(0.10, b.top1 * {RELATIVE})")
    else:
        context = "SELECT * FROM declared"
    return f"""
WITH {PAIRS_SQL},
declared AS (
  SELECT p.case_id, p.document_id, p.relevant FROM pairs p, (VALUES (1), (1), (2)) AS o(k)
  WHERE p.document_id = p.case_id + o.k),
context AS ({context}),
measure AS (
  SELECT b.*, (SELECT count(*) FROM context c WHERE c.case_id = b.case_id) AS size,
    (SELECT count(DISTINCT document_id) FROM context c WHERE c.case_id = b.case_id) AS uniq,
    (SELECT count(DISTINCT document_id) FROM context c WHERE c.case_id = b.case_id AND c.relevant) AS hits,
    (SELECT count(*) FROM declared c WHERE c.case_id = b.case_id) AS csize,
    (SELECT count(DISTINCT document_id) FROM declared c WHERE c.case_id = b.case_id) AS cuniq,
    (SELECT count(DISTINCT document_id) FROM declared c WHERE c.case_id = b.case_id AND c.relevant) AS chits
  FROM base b)
SELECT CAST(count(*) AS BIGINT) AS sample_count,
  round(avg(CASE WHEN n_gold > 0 THEN hit END), 9) AS hit_at_k,
  round(avg(CASE WHEN n_gold > 0 THEN coalesce(1.0 / first_rank, 0) END), 9) AS mrr,
  round(avg(top1), 9) AS top1_similarity,
  CAST(count(*) FILTER (WHERE n_gold > 0) AS BIGINT) AS evaluable_queries,
  round(avg(CASE WHEN size > 0 THEN hits / uniq END), 9) AS context_precision,
  round(avg(CASE WHEN n_gold > 0 THEN hits / n_gold END), 9) AS context_recall,
  round(avg(CASE WHEN size > 0 THEN (size - uniq) / size END), 9) AS duplicate_rate,
  round(avg(CASE WHEN n_gold > 0 THEN hits / n_gold END), 9) AS evidence_coverage,
  round(avg(CASE WHEN csize > 0 THEN chits / cuniq WHEN n_docs > 0 THEN NULL END), 9) AS candidate_context_precision,
  round(avg(CASE WHEN n_gold > 0 THEN chits / n_gold END), 9) AS candidate_context_recall,
  round(avg(CASE WHEN csize > 0 THEN (csize - cuniq) / csize END), 9) AS candidate_duplicate_rate,
  round(avg(size), 9) AS context_size,
  round(avg(CASE WHEN size = 0 THEN 1.0 ELSE 0.0 END), 9) AS context_abstention_rate,
  CAST(count(*) FILTER (WHERE size > 0) AS BIGINT) AS context_evaluable_cases,
  (SELECT round(coalesce(avg((expected = observed)::INT), 0), 9) FROM judged) AS decision_accuracy
FROM measure"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("rag_stage_metrics", stage_sql("adaptive"))
def rag_stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rag.stage_metrics(results(spark, sf, "adaptive")))


@query("rag_stage_metrics_declared", stage_sql("declared"))
def rag_stage_metrics_declared(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rag.stage_metrics(results(spark, sf, "declared")))


CURVE_SQL = f"""
WITH {PAIRS_SQL},
grid AS (SELECT round(0.0 + i * 0.01, 4)::DOUBLE AS threshold FROM range(0, 61) t(i)),
cells AS (
  SELECT g.threshold, b.case_id, b.n_gold,
         count(r.document_id) AS size, count(*) FILTER (WHERE r.relevant) AS hits
  FROM grid g CROSS JOIN base b
  LEFT JOIN ranked r ON r.case_id = b.case_id AND r.rank <= {TOP_K}
       AND r.score >= greatest(g.threshold, b.top1 * {RELATIVE})
  GROUP BY 1, 2, 3),
points AS (
  SELECT threshold,
    round(coalesce(avg(CASE WHEN size > 0 THEN hits / size END), 0), 9) AS context_precision,
    round(avg(CASE WHEN n_gold > 0 THEN hits / n_gold END), 9) AS context_recall,
    round(avg(CASE WHEN size = 0 THEN 1.0 ELSE 0.0 END), 9) AS abstention_rate,
    round(coalesce(avg(CASE WHEN n_gold = 0 THEN CASE WHEN size = 0 THEN 1.0 ELSE 0.0 END END), 0), 9) AS useful_abstention_rate,
    round(coalesce(avg(CASE WHEN n_gold > 0 THEN CASE WHEN size = 0 THEN 1.0 ELSE 0.0 END END), 0), 9) AS harmful_abstention_rate,
    round(avg(size), 9) AS mean_context_size,
    CAST(count(*) FILTER (WHERE size > 0) AS BIGINT) AS precision_evaluable_cases,
    CAST(count(*) FILTER (WHERE n_gold > 0) AS BIGINT) AS recall_evaluable_queries
  FROM cells GROUP BY 1),
curve AS (
  SELECT p.*, CASE WHEN context_precision + context_recall > 0
      THEN round(2 * context_precision * context_recall / (context_precision + context_recall), 9) ELSE 0.0 END AS context_f1,
    (SELECT round(avg(CASE WHEN n_gold > 0 THEN hit END), 9) FROM base) AS hit_at_k,
    (SELECT round(avg(CASE WHEN n_gold > 0 THEN coalesce(1.0 / first_rank, 0) END), 9) FROM base) AS mrr
  FROM points p)
"""


def curve(spark: SparkSession, sf: str) -> DataFrame:
    return rag.threshold_curve(results(spark, sf, "adaptive"), rag.threshold_grid(0.0, 0.6), RELATIVE)


@query("rag_threshold_sweep", CURVE_SQL + "SELECT * FROM curve")
def rag_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return curve(spark, sf)


@query("rag_threshold_recommendation", CURVE_SQL + """
SELECT threshold, context_f1, context_precision, harmful_abstention_rate FROM curve
ORDER BY context_f1 DESC, context_precision DESC, harmful_abstention_rate, threshold DESC LIMIT 1""")
def rag_threshold_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    return rag.recommend_threshold(curve(spark, sf))


def text_entries_sql(source: str, text: str) -> str:
    return f"""(WITH w AS (SELECT doc_id, unnest({S.space_words(text)}) AS word FROM {source}),
  h AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256(word), 1, 8) AS BIGINT) % 128 AS INTEGER) AS dim, count(*) AS n FROM w GROUP BY 1, 2)
  SELECT doc_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS weight FROM h)"""


@query("rag_text_search", f"""
WITH docs AS {text_entries_sql("documents", "text")},
asked AS (SELECT doc_id, split_part(text, chr(10), 1) AS question FROM documents WHERE doc_id % 50 = 0),
questions AS {text_entries_sql("asked", "question")},
norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM docs GROUP BY 1),
asked_norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM questions GROUP BY 1),
products AS (SELECT q.doc_id AS case_id, d.doc_id AS document_id, sum(q.weight * d.weight) AS p
  FROM questions q JOIN docs d ON d.dim = q.dim GROUP BY 1, 2),
scored AS (SELECT a.doc_id AS case_id, d.doc_id AS document_id, coalesce(round(p.p / (a.n * d.n), 9), 0) AS score
  FROM asked_norms a CROSS JOIN norms d LEFT JOIN products p ON p.case_id = a.doc_id AND p.document_id = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, document_id) AS rank FROM scored),
base AS (SELECT a.doc_id AS case_id, coalesce(max(r.score), 0) AS top1, min(r.rank) FILTER (r.document_id = r.case_id) AS own
  FROM asked a LEFT JOIN ranked r ON r.case_id = a.doc_id GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS sample_count, round(avg(CASE WHEN own <= {TOP_K} THEN 1.0 ELSE 0.0 END), 9) AS hit_at_k,
  round(avg(coalesce(1.0 / own, 0)), 9) AS mrr, round(avg(top1), 9) AS top1_similarity FROM base""")
def rag_text_search(spark: SparkSession, sf: str) -> DataFrame:
    """First lines of every fiftieth document, searched in all documents by their words."""
    docs = read_texts(spark, sf, "documents").select("doc_id", "text")
    asked = cut_lineage(docs.where("doc_id % 50 = 0").select("doc_id", F.split_part(
        "text", F.lit("\n"), F.lit(1)).alias("question")))
    corpus = search.dense(hash_embedding_entries(docs, "doc_id", "text"), "doc_id")
    questions = search.dense(hash_embedding_entries(asked, "doc_id", "question"), "doc_id")
    own = asked.select(F.col("doc_id").alias("case_id"), F.col("doc_id").alias("document_id"))
    top, first = search.search(questions.withColumnRenamed("doc_id", "case_id"),
                               corpus.withColumnRenamed("doc_id", "document_id"), TOP_K, own)
    cases = own.select("case_id", F.array("document_id").alias("relevant"), F.lit(None).cast("array<bigint>").alias("retrieved"))
    metrics = rag.stage_metrics(rag.searched_results(cases, top, first, TOP_K, "adaptive", 0.0, RELATIVE))
    return rounded(metrics.select("sample_count", "hit_at_k", "mrr", "top1_similarity"))
