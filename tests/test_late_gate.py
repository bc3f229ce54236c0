"""Kept and late rows add up to the input for every watermarked operator."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.streaming import jobs as J
from ledgerline.streaming import late as L
from ledgerline.streaming.progress import ProgressLog
from ledgerline.streaming.runner import new_run_dir, run_foreach, run_to_parquet
from ledgerline.streaming.sources import read_event_stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, status string, event_ts timestamp"


def test_rounds_of_gate_and_operators(spark):
    """Three rounds: each round new rows (some late) pass the gate, then each operator takes what passed."""
    run = new_run_dir(spark, "gate")
    jobs = {"dedup": lambda s: J.dedup_stream(s, horizon="10 minutes"), "minute": lambda s: J.per_minute_stream(s, delay="10 minutes"),
            "sliding": lambda s: J.sliding_rate_stream(s, delay="10 minutes")}
    schema = spark.createDataFrame([], SCHEMA).schema
    late, total = set(), 0
    for k in range(3):
        start = T0 + dt.timedelta(hours=k)
        rows = [(100 * k + i, "FAILED" if i % 3 else "PUBLISHED", start + dt.timedelta(minutes=i)) for i in range(50)]
        rows += [(900 + k, "FAILED", start - dt.timedelta(minutes=45)), (950 + k, "FAILED", None)]
        rows += [(970 + k, "PUBLISHED", start - dt.timedelta(minutes=15))]
        late |= ({900 + k} if k else set()) | {950 + k}
        total += len(rows)
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{run}/in/r={k}")
        with ProgressLog(spark, f"{run}/gate-progress"):
            run_foreach(L.observed(read_event_stream(spark, f"{run}/in/*", schema, max_files=0)), L.gate_writer(f"{run}/gate", 600), f"{run}/gate-ckpt")
        with ProgressLog(spark, f"{run}/op-progress"):
            for name, job in jobs.items():
                run_to_parquet(job(L.on_time(spark, f"{run}/gate", schema)), f"{run}/{name}", f"{run}/{name}-ckpt", state_partitions=2)
    # 15 minutes before the hour: 4 minutes after the mark of the hour before minus ten minutes
    got = {r.id for r in spark.read.schema(schema).parquet(f"{run}/gate/late").collect()}
    assert got == late
    for path in (None, f"{run}/gate-progress"):
        row = L.balance(spark, f"{run}/gate", schema, path).first()
        assert (row.arrived, row.kept, row.late, row.balanced) == (total, total - len(late), len(late), True)
    assert L.engine_dropped(spark, f"{run}/op-progress").first()[0] == 0
    assert spark.read.parquet(f"{run}/dedup").count() == total - len(late)


def test_replayed_batch_and_rows_at_the_mark(spark):
    run = new_run_dir(spark, "gate2")
    write = L.gate_writer(f"{run}/gate", 60)
    first = spark.createDataFrame([(1, "x", T0), (2, "x", T0 + dt.timedelta(minutes=10))], SCHEMA)
    second = spark.createDataFrame([(3, "x", T0 + dt.timedelta(minutes=9)), (4, "x", T0 + dt.timedelta(minutes=9, seconds=1)),
                                    (5, "x", T0 + dt.timedelta(minutes=30))], SCHEMA)
    for batch_id, rows in ((0, first), (1, second), (1, second), (0, first)):
        write(rows, batch_id)
    read = lambda name: {r.id for r in spark.read.parquet(f"{run}/gate/{name}").select("id").collect()}
    assert read("late") == {3} and read("on_time") == {1, 2, 4, 5}
    assert L.balance(spark, f"{run}/gate", first.schema).select(F.col("balanced")).first()[0]
