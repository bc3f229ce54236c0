import datetime as dt

from pyspark.sql import functions as F

from ledgerline.streaming import jobs as J
from ledgerline.streaming.progress import ProgressLog, checkpoint_status, committed, offset_gaps, progress
from ledgerline.streaming.runner import new_run_dir, run_foreach, run_to_parquet
from ledgerline.streaming.sources import read_event_stream, stage_in_order

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, status string, event_ts timestamp"


def _stage(spark, rows, name, slices=3):
    run = new_run_dir(spark, name)
    df = spark.createDataFrame(rows, SCHEMA)
    cap = stage_in_order(df, f"{run}/in", "event_ts", slices, files_per_slice=2)
    return run, df.schema, cap


def test_late_rows_are_counted_and_diverted(spark):
    rows = [(i, "PUBLISHED", T0 + dt.timedelta(minutes=10 * i)) for i in range(30)]
    run, schema, cap = _stage(spark, rows, "late")
    # a late row: old event time, staged after everything else
    spark.createDataFrame([(999, "PUBLISHED", T0)], SCHEMA).coalesce(1).write.parquet(f"{run}/in/slice=9999")
    stream = read_event_stream(spark, f"{run}/in/*", schema, max_files=cap)
    run_foreach(stream, J.late_data_writer(f"{run}/out", allowed_lateness_s=3600), f"{run}/ckpt")
    late = spark.read.parquet(f"{run}/out/late")
    assert [r.id for r in late.collect()] == [999]
    assert spark.read.parquet(f"{run}/out/on_time").count() == 30


def test_fan_out_and_progress(spark):
    rows = [(i, "FAILED" if i % 3 == 0 else "PUBLISHED", T0 + dt.timedelta(minutes=i)) for i in range(60)]
    run, schema, cap = _stage(spark, rows, "fan")
    stream = read_event_stream(spark, f"{run}/in/*", schema, max_files=cap)
    subs = {"alerts": F.col("status") == "FAILED", "audit": F.lit(True)}
    with ProgressLog(spark, f"{run}/progress"):
        run_foreach(stream, J.fan_out_writer(f"{run}/out", subs), f"{run}/ckpt")
    assert spark.read.parquet(f"{run}/out/alerts").count() == 20
    assert spark.read.parquet(f"{run}/out/audit").count() == 60
    assert progress(spark, f"{run}/progress").agg(F.sum("input_rows")).first()[0] == 60


def test_a_stream_of_over_100_batches_is_counted_whole(spark):
    """recentProgress holds the newest 100 reports; the table holds all, and two runs of one query."""
    run = new_run_dir(spark, "long")
    n = 110
    spark.range(n).selectExpr("id", "id AS f").repartitionByRange(n, "f").select("id").write.option("maxRecordsPerFile", 1).parquet(f"{run}/in")
    spark.range(0).write.mode("append").parquet(f"{run}/in")
    stream = read_event_stream(spark, f"{run}/in", spark.range(1).schema, max_files=1)
    seen = []
    with ProgressLog(spark, f"{run}/progress", flush_every=40):
        q = run_foreach(stream, lambda b, i: (seen.append(i), b.count()), f"{run}/ckpt")
    reports = progress(spark, f"{run}/progress")
    assert len(q.recentProgress) <= 100 < len(seen) <= reports.count()
    assert reports.agg(F.sum("input_rows")).first()[0] == n
    status = checkpoint_status(reports).collect()
    assert len(status) == 1 and status[0].input_rows == n and not status[0].behind and status[0].last_offset
    assert offset_gaps(reports).count() == 0
    held = committed(spark, f"{run}/ckpt")
    assert held.where("NOT done").count() == 0 and held.agg(F.max("batch_id")).first()[0] == max(seen)
    before = reports.count()
    spark.range(1000, 1001).coalesce(1).write.mode("append").parquet(f"{run}/in")
    with ProgressLog(spark, f"{run}/progress"):
        run_foreach(stream, lambda b, i: b.count(), f"{run}/ckpt")
    again = progress(spark, f"{run}/progress")
    assert again.agg(F.sum("input_rows")).first()[0] == n + 1 and again.count() > before
    assert progress(spark, f"{run}/nothing").count() == 0


def test_consumer_batch_rerun_is_idempotent(spark):
    df = spark.createDataFrame(
        [(1, "OrderCreated", '{"orderId":"o1","version":"1.0"}', {"retryCount": "0"}),
         (2, "OrderCreated", "{{", None), (3, "Mystery", "{}", None),
         (4, "PaymentProcessed", '{"amount": 500.0, "version":"1.0"}', {"retryCount": "2"}),
         (5, "PaymentProcessed", '{"amount": 500.0, "version":"1.0"}', {"retryCount": "3"})],
        "id long, event_type string, payload string, properties map<string,string>")
    run = new_run_dir(spark, "consumer")
    ok = ~((F.col("event_type") == "PaymentProcessed"))
    w = J.consumer_batch_writer(f"{run}/out", ok)
    w(df, 0)
    w(df, 0)  # replay of batch 0
    parts = [spark.read.parquet(f"{run}/out/{o}") for o in ("ack", "retry", "dead_letter")]
    got = {r.id: r.outcome for p in parts for r in p.collect()}
    assert got == {1: "ack", 2: "dead_letter", 3: "ack", 4: "retry", 5: "dead_letter"}


def test_streaming_windows_equal_batch(spark):
    rows = [(i, "FAILED" if i % 4 == 0 else "PUBLISHED", T0 + dt.timedelta(seconds=17 * i)) for i in range(200)]
    run = new_run_dir(spark, "win")
    df = spark.createDataFrame(rows, SCHEMA)
    tail = spark.createDataFrame([(-1, "Sentinel", dt.datetime(2100, 1, 1))], SCHEMA)
    cap = stage_in_order(df, f"{run}/in", "event_ts", 3, files_per_slice=2, tail=tail)
    schema = df.schema
    stream = read_event_stream(spark, f"{run}/in/*", schema, max_files=cap)
    run_to_parquet(J.per_minute_stream(stream), f"{run}/out", f"{run}/ckpt")
    got = {(r.window_start, r.events, r.failures) for r in spark.read.parquet(f"{run}/out").collect()
           if r.window_start.year < 2100}
    want = {}
    for i, s, t in rows:
        k = t.replace(second=0)
        e, f = want.get(k, (0, 0))
        want[k] = (e + 1, f + (s == "FAILED"))
    assert got == {(k, e, f) for k, (e, f) in want.items()}
