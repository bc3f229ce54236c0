"""Ordered helpers keep rows with null keys and equal plain windows, also where
a key spans many range partitions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import metrics
from ledgerline.operators.ordering import exact_quantiles, rank_within, running_max, running_sum, with_last


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(k, rng.choice([None, "hot", "hot", "hot", "a", "b", f"k{k % 40}"]), rng.randrange(30), rng.randrange(9)) for k in range(900)]
    return spark.createDataFrame(data, "id long, k string, t int, v int").repartition(5).cache()


def test_rank_and_running_sum_equal_windows(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {r.id: (r.p, r.s) for r in rows.select("id", F.row_number().over(w).alias("p"), F.sum("v").over(w.rowsBetween(
        Window.unboundedPreceding, 0)).alias("s")).collect()}
    assert {r.id: r.pos for r in rank_within(rows, ["k"], ["t", "id"]).collect()} == {i: p for i, (p, _) in want.items()}
    assert {r.id: r.running for r in running_sum(rows, ["k"], ["t", "id"], "v").collect()} == {i: x for i, (_, x) in want.items()}


@pytest.mark.parametrize("size", [1, 2, 10, 60])
def test_last_rows_equal_a_window(rows, size):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {r.id: r.x for r in rows.select("id", F.collect_list("v").over(w.rowsBetween(-(size - 1), 0)).alias("x")).collect()}
    got = with_last(rows, ["k"], ["t", "id"], ["v"], size).collect()
    assert {r.id: r.last_v for r in got} == want


def test_two_key_columns_with_nulls(spark):
    data = [(k, None if k % 3 == 0 else "x", None if k % 2 else k % 4, k) for k in range(60)]
    df = spark.createDataFrame(data, "id long, a string, b int, t int")
    w = Window.partitionBy("a", "b").orderBy("t")
    want = {r.id: r.p for r in df.select("id", F.row_number().over(w).alias("p")).collect()}
    assert {r.id: r.pos for r in rank_within(df, ["a", "b"], ["t"]).collect()} == want


def test_no_exchange_on_the_key(spark, rows):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rank_within(rows, ["k"], ["t", "id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(k#" not in plan


def test_quantiles_of_repeated_and_no_values(spark):
    df = spark.createDataFrame([(float(k % 7),) for k in range(500)] + [(None,)], "x double")
    want = df.selectExpr("percentile(x, 0.5) a", "percentile(x, 0.95) b", "percentile(x, 0.99) c").first()
    got = exact_quantiles(df, "x", [0.5, 0.95, 0.99], with_count=True).first()
    assert (got.p50, got.p95, got.p99, got.n) == (want.a, want.b, want.c, 500)
    none = exact_quantiles(df.where("x > 100"), "x", [0.5], with_count=True).first()
    assert none.p50 is None and none.n == 0


def test_call_rates_and_limits_keep_null_targets(spark):
    calls = spark.createDataFrame([(k, None if k < 4 else "t", f"2024-01-01 00:00:0{k % 2}", k % 2 == 0, 10) for k in range(9)],
                                  "id long, target string, ts string, failed boolean, dur_ms long") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert metrics.rolling_call_rates(calls).count() == 9
    assert metrics.rate_limit_excess(calls, 1).where("target is null").count() == 2
    assert metrics.concurrency_peaks(calls).where("target is null").first().peak == 2


@pytest.fixture
def many_parts(spark):
    """Range partitions are not coalesced, so the small tables span many of them."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("keys", [[None, "hot", "hot", "hot", "a"], ["one"], [None], ["a", "b", "c", "d", "e", "f"]])
def test_runs_over_many_partitions_equal_windows(spark, many_parts, keys):
    rng = random.Random(len(keys))
    data = [(k, rng.choice(keys), rng.randrange(40), rng.choice([None, None, 1, 5, -3])) for k in range(400)]
    df = spark.createDataFrame(data, "id long, k string, t int, v int").cache()
    w = Window.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r for r in df.select("id", F.row_number().over(w).alias("p"), F.sum("v").over(upto).alias("s"),
                                       F.max("v").over(upto).alias("m"),
                                       F.collect_list("id").over(w.rowsBetween(-49, 0)).alias("l")).collect()}
    order = ["t", "id"]
    assert {r.id: r.pos for r in rank_within(df, ["k"], order).collect()} == {i: r.p for i, r in want.items()}
    assert {r.id: r.running for r in running_sum(df, ["k"], order, "v").collect()} == {i: r.s for i, r in want.items()}
    assert {r.id: r.max_v for r in running_max(df, ["k"], order, ["v"]).collect()} == {i: r.m for i, r in want.items()}
    assert {r.id: (r.pos, r.last_id) for r in with_last(df.select("*"), ["k"], order, ["id"], 50).collect()} \
        == {i: (r.p, r.l) for i, r in want.items()}


def test_quantiles_over_many_partitions_read_few(spark, many_parts):
    rng = random.Random(5)
    df = spark.createDataFrame([(float(rng.choice([rng.randrange(900), 7])),) for _ in range(1500)], "x double")
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    want = df.selectExpr(*[f"percentile(x, {p}) p{int(p * 100)}" for p in probs]).first()
    assert exact_quantiles(df, "x", probs).first() == want
    assert exact_quantiles(df.limit(1), "x", [0.5]).first().p50 is not None
