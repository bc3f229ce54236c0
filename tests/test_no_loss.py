"""Cases in which rows or versions must not get lost (one per operator)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline.operators import append as AP
from ledgerline.operators import commands as CMD
from ledgerline.operators import lifecycle as M
from ledgerline.operators import projection as P
from ledgerline.operators.quality import order_response
from ledgerline.sources import sinks
from ledgerline.streaming.sources import stage_in_order

from .helpers import by_id, log_rows, ts

NOW = "2024-01-31 00:00:00"


def test_snapshots_are_never_overwritten(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    assert sinks.commit_snapshot(spark.range(5), base) == 1

    def crash(*args):
        raise RuntimeError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_record", crash)
        with pytest.raises(RuntimeError):
            sinks.commit_snapshot(spark.range(1), base)
    assert sinks.latest_version(spark, base) == 1 and sinks.read_latest(spark, base).count() == 5
    assert sinks.commit_snapshot(spark.range(7), base) == 2
    assert sinks.read_latest(spark, base).count() == 7
    (tmp_path / "broken" / "_commits").mkdir(parents=True)
    (tmp_path / "broken" / "_commits" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        sinks.commit_snapshot(spark.range(1), str(tmp_path / "broken"))


def test_failures_without_text_count(spark):
    log = log_rows(spark, [{"id": 1, "status": "PROCESSING", "retry_count": 0}, {"id": 2, "status": "PROCESSING", "retry_count": 3},
                           {"id": 3, "status": "PROCESSING"}])
    failures = spark.createDataFrame([(1, None), (2, None), (1, "b"), (1, "a")], "id long, error string")
    got = by_id(M.handle_failure(log, failures, NOW))
    assert (got[1].status, got[1].retry_count, got[1].error_message) == (S.FAILED, 1, "a")
    assert got[2].status == S.DEAD_LETTER and got[2].error_message == "Max retries exceeded: null"
    assert got[3].status == "PROCESSING"


def test_saves_stamp_the_time(spark):
    log = log_rows(spark, [{"id": 1, "status": "FAILED", "next_retry_at": ts("2024-01-30 00:00:00")},
                           {"id": 2, "status": "PROCESSING", "updated_at": ts("2024-01-30 00:00:00")}])
    assert by_id(M.reset_due_failed(log, NOW))[1].updated_at == ts(NOW)
    assert by_id(M.reset_due_failed(log, NOW, limit=None))[1].updated_at == ts(NOW)
    assert by_id(M.recover_stuck(log, NOW))[2].updated_at == ts(NOW)


def orders(spark):
    rows = [(1, "CREATED", None, ts("2024-01-01 00:00:00")), (2, "SHIPPED", None, ts("2024-01-01 00:00:00"))]
    return spark.createDataFrame(rows, "id long, status string, cancellation_reason string, updated_at timestamp_ntz")


def test_commands_of_one_order_are_applied_in_turn(spark):
    cmds = spark.createDataFrame([(1, "PAID", "u", 1), (1, "SHIPPED", "u", 2), (1, "DONE", "u", 3), (9, "PAID", "u", 4)],
                                 "order_id long, new_status string, user_id string, seq int")
    r = CMD.apply_status_commands(orders(spark), cmds, NOW)
    assert sorted((x.id, x.status) for x in r["orders"].collect()) == [(1, "DONE"), (2, "SHIPPED")]
    assert [(x.old_status, x.new_status) for x in r["outcomes"].where("order_id = 1").collect()].__len__() == 3
    assert {(x.old_status, x.new_status) for x in r["outcomes"].where("order_id = 1").collect()} == {
        ("CREATED", "PAID"), ("PAID", "SHIPPED"), ("SHIPPED", "DONE")}
    cancels = spark.createDataFrame([(1, "a", "u", 1), (1, "b", "u", 2), (2, "c", "u", 3)], "order_id long, reason string, user_id string, seq int")
    r = CMD.apply_cancel_commands(orders(spark), cancels, NOW)
    assert {(x.reason, x.outcome, x.old_status) for x in r["outcomes"].collect()} == {
        ("a", "ACCEPTED", "CREATED"), ("b", "NOT_CANCELLABLE", "CANCELLED"), ("c", "NOT_CANCELLABLE", "SHIPPED")}
    assert r["orders"].count() == 2 and r["orders"].where("id = 1").first().cancellation_reason == "a"
    assert '"reason":"a"' in r["events"].first().payload


def test_ids_of_unversioned_events_differ(spark):
    ev = spark.createDataFrame([("o1", "ORDER", "OrderCreated", "{}"), ("o1", "ORDER", "OrderCancelled", "{}")],
                               "aggregate_id string, aggregate_type string, event_type string, payload string")
    assert AP.append_rows(ev, NOW).select("event_id").distinct().count() == 2


def test_equal_requests_stay_one_row_each(spark):
    log = log_rows(spark, [{"id": 1}])
    req = spark.createDataFrame([("order-123", "OrderCreated")] * 3, "aggregate_id string, event_type string")
    assert [r.exists for r in AP.event_exists(log, req).collect()] == [True] * 3


def test_one_append_per_expected_version(spark):
    current = spark.createDataFrame([("a", 3)], "aggregate_id string, version long")
    appends = spark.createDataFrame([("a", 3, "x"), ("a", 3, "y"), ("b", 0, "z")], "aggregate_id string, expected_version long, p string")
    got = {r.p: r.accepted for r in AP.version_conflicts(current, appends).collect()}
    assert got == {"x": True, "y": False, "z": True}


def test_upsert_keeps_untouched_rows(spark):
    model = spark.createDataFrame(
        [(k, 5, "12345678901234567.89", "EUR", 1, "addr", "CREATED", None, ts("2024-01-01 00:00:00"), ts("2024-01-02 00:00:00"), None) for k in (1, 2)],
        "order_id long, customer_id long, total_amount string, currency string, item_count int, shipping_address string, last_order_status string, "
        "cancellation_reason string, created_at timestamp_ntz, projected_at timestamp_ntz, last_correlation_id string") \
        .withColumn("total_amount", F.col("total_amount").cast("decimal(19,2)"))
    delta = spark.createDataFrame([(2, 9, "e9", "OrderStatusChanged", None, None, None, None, None, "PAID", None, ts("2024-01-03 00:00:00"), None)],
                                  "order_id long, seq int, event_id string, event_type string, customer_id long, total_amount double, currency string, "
                                  "item_count int, shipping_address string, new_status string, reason string, occurred_at timestamp_ntz, correlation_id string")
    got = {r.order_id: r for r in P.upsert(model, delta, NOW).collect()}
    assert got[1].projected_at == ts("2024-01-02 00:00:00") and got[2].projected_at == ts(NOW)
    assert str(got[1].total_amount) == str(got[2].total_amount) == "12345678901234567.89" and got[2].last_order_status == "PAID"


def test_fractions_of_seconds_are_printed(spark):
    rows = [(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:00:05"), (3, "2024-01-01 10:00:05.123456"), (4, "2024-01-01 10:00:00.5")]
    df = spark.createDataFrame(rows, "id long, c string").select(
        "id", F.lit(1).alias("customer_id"), F.lit(1.0).alias("total_amount"), F.lit("EUR").alias("currency"), F.lit(1).alias("item_count"),
        F.lit("CREATED").alias("status"), F.col("c").cast("timestamp_ntz").alias("created_at"))
    assert {r.orderId: r.createdAt for r in order_response(df).collect()} == {
        "1": "2024-01-01T10:00", "2": "2024-01-01T10:00:05", "3": "2024-01-01T10:00:05.123456", "4": "2024-01-01T10:00:00.500"}


def test_staging_keeps_rows_without_a_time(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k == 4 else dt.datetime(2024, 1, 1, 0, 0, k)) for k in range(11)], "id long, t timestamp")
    stage_in_order(df, str(tmp_path / "s"), "t", 3, files_per_slice=1)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 11
    stage_in_order(df.where("t is null"), str(tmp_path / "n"), "t", 3, files_per_slice=1)
    assert spark.read.parquet(str(tmp_path / "n")).count() == 1


def test_erasure_takes_whole_values_only(spark):
    from ledgerline.operators.log_queries import erase_subjects
    log = log_rows(spark, [{"id": 1, "payload": '{"u": 4}'}, {"id": 2, "payload": '{"u": 42}'}, {"id": 3, "payload": '{"x": 4}'},
                           {"id": 4, "payload": "broken 4"}, {"id": 5, "payload": '{"u": "4"}'}])
    kept, gone = erase_subjects(log, spark.createDataFrame([(4,), (4,), (None,)], "id long"), "$.u")
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4] and sorted(r.id for r in gone.collect()) == [1, 5]
