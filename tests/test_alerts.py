"""Alert rules with ``for``: batch = a loop over the minutes = the stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerline.operators import alerts as A
from ledgerline.streaming.runner import new_run_dir, run_foreach
from ledgerline.streaming.sources import read_event_stream, stage_in_order

T0 = dt.datetime(2024, 1, 1)
MIN = dt.timedelta(minutes=1)
RULES = (A.Rule("a", "pending", 3, 2), A.Rule("b", "failed_per_second", 1 / 60, 5), A.Rule("c", "breaker_open", 1, 1, at_least=True),
         A.Rule("d", "pending", 0, 0))


def loop(values, rules):
    """{(rule, minute): (state, since)} one minute at a time; values: {metric: [..]}."""
    out = {}
    for rule in rules:
        since, firing = None, False
        for k, v in enumerate(values[rule.metric]):
            true = v >= rule.threshold if rule.at_least else v > rule.threshold
            if not true:
                state, since, firing = (A.RESOLVED if firing else A.INACTIVE), None, False
            else:
                since = T0 + k * MIN if since is None else since
                firing = T0 + k * MIN - since >= rule.for_minutes * MIN
                state = A.FIRING if firing else A.PENDING
            out[rule.name, T0 + k * MIN] = (state, since)
    return out


def events(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        t = T0 + dt.timedelta(seconds=rng.randrange(60 * 240))
        burst = (t - T0).seconds // 60 % 60 < 25
        rows.append((t, rng.choices(["created", "settled", "failed", "call", "call_failed"], [3, 3, 3 if burst else 0, 2, 4 if burst else 0])[0]))
    return rows


def values_of(rows, minutes):
    count = {}
    for t, kind in rows:
        count[t.replace(second=0), kind] = count.get((t.replace(second=0), kind), 0) + 1
    at = lambda k, kind: count.get((T0 + k * MIN, kind), 0)
    pending, out, run = [], {"failed_per_second": [], "breaker_open": []}, 0
    for k in range(minutes):
        run += at(k, "created") - at(k, "settled")
        pending.append(run)
        out["failed_per_second"].append(sum(at(j, "failed") for j in range(max(0, k - 4), k + 1)) / 300.0)
        calls = at(k, "call") + at(k, "call_failed")
        out["breaker_open"].append(float(calls > 0 and at(k, "call_failed") >= calls * 0.5))
    return out | {"pending": pending}


def minute_counts(df):
    kinds = {"created": ("created",), "settled": ("settled",), "failed": ("failed",), "calls": ("call", "call_failed"), "call_failures": ("call_failed",)}
    return df.groupBy(F.date_trunc("minute", "t").cast("timestamp_ntz").alias("minute")).agg(*[F.count_if(F.col("kind").isin(*k)).alias(n) for n, k in kinds.items()])


def test_batch_equals_a_loop(spark):
    rows = events(4, 900)
    last = max(t for t, _ in rows)
    minutes = int((last - T0).total_seconds() // 60) + 1
    df = spark.createDataFrame(rows, "t timestamp_ntz, kind string").repartition(4)
    found = A.states(A.metrics(minute_counts(df), A.grid(T0, last, spark)), RULES)
    got = {(r.rule, r.minute): (r.state, r.since) for r in found.collect()}
    want = loop(values_of(rows, minutes), RULES)
    assert got == want and {s for s, _ in want.values()} == {A.INACTIVE, A.PENDING, A.FIRING, A.RESOLVED}
    changes = {(r.rule, r.minute): r.state for r in A.transitions(found).collect()}
    for rule in RULES:
        before = A.INACTIVE
        for k in range(minutes):
            state = want[rule.name, T0 + k * MIN][0]
            assert changes.get((rule.name, T0 + k * MIN)) == (state if state != before else None)
            before = state


def test_stream_equals_batch(spark):
    rows = events(9, 500)
    last = max(t for t, _ in rows).replace(second=0)
    df = spark.createDataFrame([(t, k) for t, k in rows], "event_ts timestamp, kind string")
    run = new_run_dir(spark, "alerts")
    tail = spark.createDataFrame([(last + dt.timedelta(hours=2), "none")], "event_ts timestamp, kind string")
    cap = stage_in_order(df, f"{run}/in", "event_ts", 4, files_per_slice=2, tail=tail)
    stream = read_event_stream(spark, f"{run}/in/*", df.schema, max_files=cap)
    writer = A.alert_writer(f"{run}/out", T0, RULES, until=last)
    run_foreach(A.minute_stream(stream), writer, f"{run}/ckpt", state_partitions=4)
    out = spark.read.parquet(f"{run}/out/states")
    want = loop(values_of(rows, int((last - T0).total_seconds() // 60) + 1), RULES)
    assert {(r.rule, r.minute): (r.state, r.since) for r in out.collect()} == want
    assert out.select("batch_id").distinct().count() > 2
    # a replayed micro-batch writes the same again
    again = max(r.batch_id for r in out.select("batch_id").distinct().collect())
    minutes = spark.read.parquet(f"{run}/out/minutes")
    mine = minutes.where(F.col("batch_id") == again).drop("batch_id")
    writer(spark.createDataFrame(mine.collect(), mine.schema), again)
    assert {(r.rule, r.minute): (r.state, r.since) for r in spark.read.parquet(f"{run}/out/states").collect()} == want
