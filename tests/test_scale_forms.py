"""Shadow model, inbox window and quantile sketches against plain forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import append, inbox, shadow, sketches
from ledgerline.session import scratch_path

DAY = dt.date(2024, 1, 10)


def test_shadow_reads_only_what_differs(spark, tmp_path):
    rows = [(k, f"s{k % 4}" if k % 9 else None, k * 1.5) for k in range(4000)] + [(None, "no key", 1.0)]
    schema, cols = "k long, status string, amount double", ["status", "amount"]
    other = [(k, None if k == 77 else "changed" if k == 900 else s, a) for k, s, a in rows if k != 1234] + [(9_000_001, "new", None)]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for base, data in ((one, rows), (two, other)):
        shadow.store(spark.createDataFrame(data, schema).repartition(3), base, "k", cols, 256)
    got = {(r.k, r.cls) for r in shadow.compare(spark, one, two, "k", cols, 256).collect()}
    assert got == {(77, "different"), (900, "different"), (1234, "extra"), (9_000_001, "missing")}
    report = {r.cls: (r.n, r.rows_read, r.rows_stored) for r in shadow.report(spark, one, two, "k", cols, 256).collect()}
    assert {c: v[0] for c, v in report.items()} == {"different": 2, "extra": 1, "missing": 1, "same": 4001 - 3}
    assert 0 < report["same"][1] < 200 and report["same"][2] == 4001 + 4001
    leaves, compared = shadow.differing_leaves(spark, one, two, 256)
    assert 1 <= len(leaves) <= 4 and compared <= 1 + 16 + 4 * 16
    plan = shadow.compare(spark, one, two, "k", cols, 256)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [_leaf") == 2


def test_shadow_of_equal_and_empty_models(spark, tmp_path):
    schema, cols = "k long, v string", ["v"]
    one, two, none = (str(tmp_path / n) for n in ("a", "b", "none"))
    data = spark.createDataFrame([(1, None), (2, "x"), (3, None)], schema)
    shadow.store(data, one, "k", cols, 16)
    shadow.store(data.repartition(2), two, "k", cols, 16)
    assert shadow.differing_leaves(spark, one, two, 16) == ([], 1)
    assert [tuple(r) for r in shadow.report(spark, one, two, "k", cols, 16).select("cls", "n", "rows_read").collect()] == [("same", 3, 0)]
    shadow.store(data.where("false"), none, "k", cols, 16)
    assert {r.cls for r in shadow.compare(spark, one, none, "k", cols, 16).collect()} == {"extra"}
    with pytest.raises(ValueError):
        shadow.store(data, one, "k", cols, shadow.MOST_LEAVES + 1)


def test_inbox_equals_the_plain_anti_join_and_prunes_days(spark, tmp_path):
    rng = random.Random(3)
    base = str(tmp_path / "inbox")
    seen = [(f"e{k}", DAY - dt.timedelta(days=rng.randrange(12))) for k in range(3000)]
    half = len(seen) // 2
    for part in (seen[:half], seen[half:], seen[:50]):
        inbox.record(spark.createDataFrame(part, "event_id string, day date"), base, blocks=4)
    ids = [(f"e{rng.randrange(6000)}", k) for k in range(1500)] + [(None, -1), ("e1", -2), ("e1", -3)]
    incoming = spark.createDataFrame(ids, "event_id string, n int")
    window = [(i, d) for i, d in seen if DAY - dt.timedelta(days=6) <= d <= DAY]
    want = append.unseen(incoming, spark.createDataFrame(window, "event_id string, day date"))
    for blocks in (4,):
        got = inbox.unseen(incoming, base, DAY, blocks=blocks)
        assert got.columns == incoming.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    # ids of one day only: the other days' folders are not in the scan
    one_day = [i for i, d in window if d == DAY - dt.timedelta(days=2)][:20]
    few = spark.createDataFrame([(i,) for i in one_day], "event_id string")
    days = {r.day for r in inbox.possible(few, base, DAY, blocks=4).collect()}
    read = inbox.stored_ids(spark, base, sorted(days), DAY)
    scanned = read._jdf.queryExecution().executedPlan().toString()
    assert DAY - dt.timedelta(days=2) in days and "PartitionFilters: [isnotnull(day" in scanned
    assert inbox.unseen(few, base, DAY, blocks=4).count() == 0
    assert inbox.unseen(few, base, DAY - dt.timedelta(days=30), blocks=4).count() == len(one_day)


def test_filters_rule_out_most_and_never_a_stored_id(spark, tmp_path):
    base = str(tmp_path / "inbox")
    inbox.record(spark.range(20_000).select(F.concat(F.lit("a"), "id").alias("event_id"), F.lit(DAY).alias("day")), base, blocks=16)
    hits = inbox.possible(spark.range(20_000).select(F.concat(F.lit("a"), "id").alias("event_id")), base, DAY, blocks=16)
    assert hits.count() == 20_000
    misses = inbox.possible(spark.range(20_000).select(F.concat(F.lit("b"), "id").alias("event_id")), base, DAY, blocks=16)
    assert misses.count() < 200
    assert inbox.possible(spark.range(3).select(F.col("id").alias("event_id")), scratch_path(spark, "no-inbox"), DAY).count() == 0


def test_sketches_merge_and_stay_close(spark):
    rows = spark.range(40_000).select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 5)").alias("t"), (F.pow(F.rand(7), 3) * 1000).alias("v"),
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g")).cache()
    value = F.when(F.col("v") > 1, F.col("v"))
    for by in (None, ["g"]):
        minutes = sketches.minute_sketches(rows, "t", value, by)
        days = sketches.roll_up(sketches.roll_up(minutes, "hour", by), "day", by, period="hour")
        whole = sketches.roll_up(days, "month", by, period="day")
        assert whole.agg(F.sum("n")).first()[0] == rows.where("v > 1").count() == days.agg(F.sum("n")).first()[0]
    estimates = sketches.quantiles(sketches.roll_up(sketches.minute_sketches(rows, "t", value), "day"))
    errors = sketches.measured_error(rows, estimates, "t", value, "day").collect()
    assert len(errors) == 3 and all(max(r.error_p50, r.error_p95, r.error_p99) < 0.025 for r in errors)
    assert sketches.quantiles(sketches.minute_sketches(rows.where("false"), "t", value)).count() == 0
    rows.unpersist()
