"""Run queries and compare them with their check SQL in DuckDB.

usage: python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from trustframe.plans import catalogue  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="check-"))
             .config("spark.trustframe.textPartitions", "8")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def kind(value):
    return "null" if value is None else type(value).__name__


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--show", type=int, default=3)
    args.add_argument("names", nargs="*")
    opt = args.parse_args()
    spark, con = session(), duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{opt.sf}/{table}.parquet'")
    names = [n for n in catalogue.QUERIES if not opt.names or any(n.startswith(p) for p in opt.names)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = catalogue.QUERIES[name](spark, opt.sf)
            columns = sorted(df.columns)
            rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in catalogue.CHECK_SQL:
            print(f"rows {name}: {len(rows)} rows {took:.1f}s  e.g. {rows[:opt.show]}"[:600], flush=True)
            continue
        start = time.time()
        try:
            cursor = con.execute(catalogue.CHECK_SQL[name])
            got = [d[0] for d in cursor.description]
            order = [got.index(c) for c in columns] if sorted(got) == columns else None
            wanted = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()] if order is not None else None
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL sql {name}: {str(error)[:1500]}", flush=True)
            continue
        sql_took = time.time() - start
        if wanted is None:
            bad += 1
            print(f"DIFF {name}: columns {columns} but {sorted(got)}", flush=True)
            continue
        key = lambda r: tuple((v is None, str(v)) for v in r)
        a, b = sorted(rows, key=key), sorted(wanted, key=key)
        kinds = lambda rs: [sorted({kind(r[i]) for r in rs} - {"null"}) for i in range(len(columns))]
        if a == b and kinds(a) == kinds(b):
            print(f"ok   {name}: {len(a)} rows {took:.1f}s / {sql_took:.1f}s  e.g. {a[:1]}"[:420], flush=True)
            continue
        bad += 1
        print(f"DIFF {name}: {len(a)} rows, wanted {len(b)}; types {kinds(a)} / {kinds(b)}; {columns}", flush=True)
        missing = [r for r in b if r not in set(a)][:opt.show]
        extra = [r for r in a if r not in set(b)][:opt.show]
        print("   extra  ", str(extra)[:1500], "\n   missing", str(missing)[:1500], flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
