import random

import pytest
from pyspark.sql import functions as F

from tidegauge.plans import segments as G
from tidegauge.plans.spread import spread


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    times = sorted(rnd.sample(range(5000), 900))
    return [("hot" if i % 3 == 0 else rnd.choice("abc"), t, rnd.randint(-9, 9))
            for i, t in enumerate(times)]


def walk(rows, start, step):
    state, out = {}, {}
    for k, t, v in rows:
        shown, state[k] = step(state.get(k, start), v)
        out[(k, t)] = shown
    return out


def check(spark, rows, function, expected, **kwargs):
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = function(df, ["k"], F.expr("t DIV 100"), "t", **kwargs)
    assert {(r.k, r.t): r.out for r in got.collect()} == expected


def test_lag(spark, rows):
    check(spark, rows, G.lag_across, walk(rows, None, lambda s, v: (s, v)), value="v", out="out")


def test_running_sum(spark, rows):
    check(spark, rows, G.running_sum, walk(rows, 0, lambda s, v: (s + v, s + v)),
          value=F.col("v"), out="out")


def test_running_max(spark, rows):
    check(spark, rows, G.running_max, walk(rows, -99, lambda s, v: (max(s, v), max(s, v))),
          value=F.col("v"), out="out")


def test_rank(spark, rows):
    check(spark, rows, G.rank_across, walk(rows, 0, lambda s, v: (s + 1, s + 1)), out="out")


def test_top_per_key(spark, rows):
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = G.top_per_key(df, ["k"], ["v", "t"], 7, F.col("t"), "n", buckets=5).collect()
    want = set()
    for key in {r[0] for r in rows}:
        mine = sorted((v, t) for k, t, v in rows if k == key)[:7]
        want |= {(key, t, i + 1) for i, (v, t) in enumerate(mine)}
    assert {(r.k, r.t, r.n) for r in got} == want


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file of one row group has as many splits as cores, but only one of them has rows."""
    path = str(tmp_path / "one")
    spark.range(200_000).coalesce(1).write.parquet(path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 << 10))
    try:
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        parts = spread(rows, "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert max(r["count"] for r in parts) < 200_000 / 16
