"""Ordered operators: slices must equal a plain window, also for a hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trustframe.operators import ordered
from trustframe.operators.ordered import Running


def rows(seed=1, n=600):
    rng = random.Random(seed)
    # one key holds about half of all rows
    return [(rng.choice(["hot", "hot", "hot", "a", "b", "c"]), i, rng.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("keys", [["k"], []])
def test_sliced_equals_plain(spark, keys):
    df = spark.createDataFrame(rows(), "k string, t int, v int").repartition(5)
    columns = {"total": Running("sum", F.col("v")), "before": Running("sum", F.col("v"), before=True),
               "top": Running("max", F.col("v")), "last": Running("previous", F.col("v")), "n": Running("sum")}
    order = ["t"]
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("*", F.sum("v").over(upto), F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, -1)),
                      F.max("v").over(upto), F.lag("v").over(window), F.count("*").over(upto)).collect()
    sliced = ordered.running(df, keys, order, columns, slices=4).collect()
    assert sorted(map(str, map(tuple, plain))) == sorted(map(str, map(tuple, sliced)))
    seen = {}
    for k, t, v in sorted(rows(), key=lambda r: r[1]):
        seen.setdefault(k if keys else "", []).append(v)
    biggest = {}
    for r in sliced:
        key = r["k"] if keys else ""
        biggest[key] = max(biggest.get(key, 0), r["total"])
    assert biggest == {k: sum(v) for k, v in seen.items()}


def test_order_statistic_is_exact(spark):
    values = [random.Random(3).randrange(20) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    for position in (1, 7, 150, 300):
        assert ordered.order_statistic(df, "v", position).first()["v"] == sorted(values)[position - 1]


def test_rate_counts_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.choice(["u", "u", "w"]), rng.randrange(600)) for _ in range(200)] + [("u", 0), ("u", 60)]
    df = spark.createDataFrame(data, "user string, s int").withColumn("ts", F.timestamp_seconds("s")).withColumn(
        "id", F.monotonically_increasing_id())
    got = ordered.rate_counts(df, "user", "ts", 60).collect()
    assert len(got) == len(data)
    for r in got:
        # a row exactly 60 seconds old is out
        assert r["in_window"] == sum(1 for u, s in data if u == r["user"] and r["s"] - 60 < s <= r["s"])
