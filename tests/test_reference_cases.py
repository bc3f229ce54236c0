"""Integration cases of the reference, as small DataFrames."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline.operators import commands as CMD
from ledgerline.operators import lifecycle as M
from ledgerline.operators import read_model as RM
from ledgerline.operators.log_queries import backlog_size

from .conftest import NOW
from .helpers import by_id, log_rows, ts

OUT = "id long, ok boolean, error string"


def _cut(spark, df):
    return spark.createDataFrame(df.collect(), S.EVENT_LOG)


def test_one_event_published_with_time(spark):
    log = log_rows(spark, [{"id": 1}])
    out = by_id(M.delivery_step(log, spark.createDataFrame([(1, True, None)], OUT), NOW))[1]
    assert out["status"] == S.PUBLISHED and out["published_at"] == ts(NOW)


def test_five_events_leave_no_backlog(spark):
    log = log_rows(spark, [{"id": i, "aggregate_id": f"order-{i}", "partition_key": f"order-{i}"} for i in range(5)])
    oks = spark.createDataFrame([(i, True, None) for i in range(5)], OUT)
    assert backlog_size(M.delivery_step(log, oks, NOW)).first()[0] == 0


def test_one_failing_row_fails_its_key_group_only(spark):
    log = log_rows(spark, [{"id": 1, "partition_key": "a"}, {"id": 2, "partition_key": "a"},
                           {"id": 3, "partition_key": "b"}])
    outs = spark.createDataFrame([(1, True, None), (2, False, "boom"), (3, True, None)], OUT)
    got = {k: v["status"] for k, v in by_id(M.delivery_step(log, outs, NOW)).items()}
    assert got == {1: S.FAILED, 2: S.FAILED, 3: S.PUBLISHED}


def test_always_failing_stalls_then_sweep_dead_letters(spark):
    log = log_rows(spark, [{"id": 1}])
    fail = spark.createDataFrame([(1, False, "down")], OUT)
    t = ts(NOW)
    for i in range(5):
        now = t + dt.timedelta(minutes=10 * i)
        log = _cut(spark, M.delivery_step(M.reset_due_failed(log, now, limit=None), fail, now))
    row = by_id(log)[1]
    assert row["status"] == S.FAILED and row["retry_count"] == 3  # B1: never retried again
    assert by_id(M.dead_letter_sweep(log, NOW))[1]["status"] == S.DEAD_LETTER


def test_orders_by_customer_and_unknown_ids(spark):
    model = spark.createDataFrame(
        [(i, 7 if i < 3 else 8, 10.0, "USD", 1, "a", "CREATED", None, dt.datetime(2024, 1, i + 1), ts(NOW), None)
         for i in range(4)],
        "order_id long, customer_id long, total_amount double, currency string, item_count int, "
        "shipping_address string, last_order_status string, cancellation_reason string, "
        "created_at timestamp_ntz, projected_at timestamp_ntz, last_correlation_id string")
    mine = RM.customer_orders(model.where(F.col("customer_id") == 7)).collect()
    assert [r.order_id for r in mine] == [2, 1, 0]
    ids = spark.createDataFrame([(1,), (99,)], "order_id long")
    assert {r.order_id: r.found for r in RM.find_by_ids(model, ids).collect()} == {1: True, 99: False}


def test_commands_guard_and_unknown(spark):
    orders = spark.createDataFrame(
        [(1, "CREATED", None, ts(NOW)), (2, "SHIPPED", None, ts(NOW))],
        "id long, status string, cancellation_reason string, updated_at timestamp_ntz")
    cmds = spark.createDataFrame([(1, "changed mind", "u"), (2, "late", "u"), (3, "x", "u")],
                                 "order_id long, reason string, user_id string")
    r = CMD.apply_cancel_commands(orders, cmds, NOW)
    assert {x.order_id: x.outcome for x in r["outcomes"].collect()} == {
        1: "ACCEPTED", 2: "NOT_CANCELLABLE", 3: "ORDER_NOT_FOUND"}
    nxt = {x.id: (x.status, x.cancellation_reason) for x in r["orders"].collect()}
    assert nxt == {1: ("CANCELLED", "changed mind"), 2: ("SHIPPED", None)}
    assert r["events"].count() == 1
