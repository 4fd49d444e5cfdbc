"""Every query is registered once and a part of them is compared with its check SQL."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_point  # noqa: E402
from check import TABLES, plain  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUICK = ["rag_rank_topk", "rag_threshold_sweep", "claims_split", "evidence_match", "groundedness_report", "pii_scan",
         "compliance_scan", "shield_risk", "output_quality", "fact_relevance", "ontology_claim_check", "action_authorisation",
         "missing_inverse", "fact_closure", "snapshot_diff", "ledger_append", "trace_summary", "rate_limit_window",
         "stream_rate_limit", "fact_extraction"]
NAMES = sorted(entry_point.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK


def test_names():
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 120


def test_entry(spark):
    assert entry_point.entry(spark).count() == 61


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry_point.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = con.execute(entry_point.oracle_sql()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=str)
    assert got == want
