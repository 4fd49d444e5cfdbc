"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from trustframe.plans import catalogue

HEADLINE = [
    "rag_rank_topk", "rag_stage_metrics", "rag_threshold_sweep", "claims_split", "document_claims", "evidence_match",
    "claim_propagation", "groundedness_report", "gold_scores", "hybrid_cost_sweep", "pii_scan", "pii_mask",
    "compliance_scan", "compliance_report", "shield_documents", "output_quality", "conversation_cycle",
    "fact_relevance", "similar_facts", "keyword_search", "ontology_claim_check", "claim_check", "answer_decision",
    "action_authorisation", "policy_scan", "validation_cascade", "constraint_scan", "state_algebra", "fact_closure",
    "snapshot_diff", "fact_versions", "rule_upsert", "fact_ingest", "rate_limit_window", "budget_cutoff",
    "ledger_append", "ledger_verify", "ledger_stats", "trace_summary", "fact_extraction", "concept_extraction",
    "chunk_pack", "hash_embedding", "annotator_agreement", "conformal_quantile", "calibration_ece",
    "stream_rate_limit", "stream_trace_window", "hypothesis_parse", "tenant_policy_scan", "rag_text_search",
    "numeric_conflicts", "ledger_seal",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .config("spark.trustframe.textPartitions", cpus)
             # rows are few but heavy, so small partitions still deserve a task of their own
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the first timing
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
