"""Cases that earlier forms got wrong: repeated event ids in causation chains, repeated
names in payloads, state that never expired, retried sinks, appended rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline.operators import append as AP
from ledgerline.operators import log_queries as L
from ledgerline.operators import metrics as MX
from ledgerline.operators import projection as P
from ledgerline.operators.quality import causation_roots
from ledgerline.sources import sinks
from ledgerline.streaming import stateful as ST
from ledgerline.streaming.runner import new_run_dir, run_to_parquet
from ledgerline.streaming.sources import read_event_stream

from .conftest import NOW
from .helpers import log_rows, ts


def test_repeated_event_ids_do_not_multiply(spark):
    rows = [("a", None), ("b", "a"), ("b", "a"), ("c", "b"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("lost", "none"), ("b", None)]
    got = {r.event_id: (r.root_id, r.depth, r.cycle) for r in causation_roots(spark.createDataFrame(rows, "event_id string, causation_id string")).collect()}
    assert got == {"a": ("a", 0, False), "b": ("a", 1, False), "c": ("a", 2, False), "d": ("a", 3, False), "x": (None, None, True),
                   "y": (None, None, True), "lost": ("lost", 0, False)}
    assert causation_roots(spark.createDataFrame(rows, "event_id string, causation_id string")).count() == 7


def test_erasure_reads_the_name_that_the_decoder_reads(spark):
    log = log_rows(spark, [{"id": 1, "payload": '{"k":1,"k":2}'}, {"id": 2, "payload": '{"k":1}'}, {"id": 3, "payload": '{"k":"2"}'}, {"id": 4, "payload": "{{"},
                           {"id": 5, "payload": '{"a":{"k":2}}'}, {"id": 6, "payload": '{"k":22}'}])
    kept, erased = L.erase_subjects(log, spark.createDataFrame([(2,)], "id long"), "$.k")
    assert {r.id for r in erased.collect()} == {1, 3} and {r.id for r in kept.collect()} == {2, 4, 5, 6}
    assert {r.id for r in L.erase_subjects(log, spark.createDataFrame([(2,)], "id long"), "$.a.k")[1].collect()} == {5}
    with pytest.raises(ValueError):
        L.subject_of(F.col("payload"), "$.a[0]")


def test_traces_number_every_correlation_id(spark):
    at = ts("2024-01-01 00:00:00")
    log = log_rows(spark, [{"id": k, "correlation_id": 7 if k % 2 else None if k % 4 else 8, "created_at": at - dt.timedelta(minutes=k)} for k in range(1, 41)])
    got = {(r.correlation_id, r.pos): r.id for r in L.traces(log).collect()}
    assert [got[7, k] for k in range(1, 21)] == list(range(39, 0, -2)) and sum(k[0] == 8 for k in got) == 10 and len(got) == 30


def test_appended_rows_are_log_rows(spark):
    at = ts("2024-01-02 00:00:00")
    events = spark.createDataFrame([("order-1", "ORDER", "OrderCreated", "{}", "e2", at, "corr-9"), ("order-2", "ORDER", "OrderCreated", "{}", "e1", at, "12"),
                                    ("order-3", "ORDER", "OrderCreated", "{}", None, at - dt.timedelta(days=1), None)],
                                   "aggregate_id string, aggregate_type string, event_type string, payload string, event_id string, created_at timestamp_ntz, correlation_id string")
    rows = AP.log_rows(AP.append_rows(events, NOW), 100)
    assert [(f.name, f.dataType) for f in rows.schema.fields] == [(f.name, f.dataType) for f in S.EVENT_LOG.fields]
    got = {r.aggregate_id: r for r in rows.collect()}
    assert (got["order-3"].id, got["order-2"].id, got["order-1"].id) == (101, 102, 103)
    assert got["order-2"].correlation_id == 12 and got["order-1"].correlation_id is None and '"traceId":"corr-9"' in got["order-1"].metadata
    assert {r.id for r in L.poll_batch(rows, NOW).collect()} == {101, 102, 103}


def test_dead_letters_written_again_replace_their_batch(spark, tmp_path):
    at = ts("2024-01-02 00:00:00")
    rows = spark.createDataFrame([("p1", "e", at), ("p2", None, at)], "payload string, error string, failed_at timestamp_ntz")
    for batch in (1, 2, 1):
        sinks.write_dead_letters(rows.where(f"payload = 'p{batch}'"), str(tmp_path / "dead"), batch)
    assert sorted(r.payload for r in sinks.read_dead_letters(spark, str(tmp_path / "dead")).collect()) == ["p1", "p2"]


def test_failures_by_reason_and_confirmations(spark):
    pay = spark.createDataFrame([(1, 5.0, True, None), (2, 7.5, False, "card"), (3, 1.0, False, None), (4, 2.0, None, "card")], "id int, amount double, ok boolean, failure_reason string")
    assert {r.reason: (r.n, r.amount) for r in MX.failures_by_reason(pay).collect()} == {"card": (2, 9.5), "unknown": (1, 1.0)}
    day = [ts(f"2024-01-0{k} 00:00:00") for k in range(1, 8)]
    base = spark.createDataFrame([(1, 1, "a", "OrderCreated", day[0]), (1, 2, "b", "OrderConfirmed", day[1]), (1, 3, "c", "OrderConfirmed", day[2]),
                                  (2, 1, "d", "OrderCreated", day[0]), (2, 2, "e", "OrderConfirmed", day[3]), (2, 3, "f", "OrderCreated", day[4]), (3, 1, "g", "OrderConfirmed", day[1])],
                                 "order_id long, seq int, event_id string, event_type string, occurred_at timestamp_ntz")
    none = {"customer_id": "bigint", "total_amount": "double", "currency": "string", "item_count": "int", "shipping_address": "string", "new_status": "string",
            "reason": "string", "correlation_id": "string"}
    ev = base.withColumns({n: F.lit(None).cast(t) for n, t in none.items()})
    got = {r.order_id: (r.last_order_status, r.confirmed_at) for r in P.project_confirmed(ev, NOW, {"OrderConfirmed": "CONFIRMED"}).collect()}
    assert got == {1: ("CONFIRMED", day[2]), 2: (None, None)}


def test_state_of_an_order_expires_and_later_rows_win(spark):
    """An order is forgotten after its time; a Created that comes again much later begins anew and is the newest."""
    t0 = dt.datetime(2024, 1, 1)
    cols = "order_id long, seq int, event_type string, customer_id long, total_amount double, currency string, item_count int, shipping_address string, " \
           "new_status string, reason string, occurred_at timestamp_ntz, correlation_id string, arrival_ts timestamp"

    def ev(order, seq, kind, status, day):
        at = t0 + dt.timedelta(days=day)
        return (order, seq, kind, 1, 1.0, "USD", 1, "x", status, None, at, None, at)

    run = new_run_dir(spark, "expiry")
    batches = [[ev(1, 1, "OrderCreated", "NEW", 0), ev(1, 2, "OrderStatusChanged", "S1", 0.1), ev(1, 3, "OrderStatusChanged", "S2", 0.2), ev(2, 1, "OrderCreated", "NEW", 0)],
               [ev(9, 1, "OrderCreated", "NEW", 20)], [ev(9, 2, "OrderStatusChanged", "S", 21)],
               [ev(1, 1, "OrderCreated", "AGAIN", 22)], [ev(9, 3, "OrderStatusChanged", "T", 23)]]
    schema = spark.createDataFrame([], cols).schema
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{run}/in/r={k}")
        run_to_parquet(ST.project_stream(read_event_stream(spark, f"{run}/in/*", schema, max_files=0), retain_us=5 * ST.DAY_US), f"{run}/out", f"{run}/ckpt", state_partitions=2)
    out = spark.read.parquet(f"{run}/out").where("kind = 'row'")
    assert {r.version for r in out.where("order_id = 1 AND last_order_status = 'AGAIN'").collect()} == {1}
    got = {r.order_id: r.last_order_status for r in ST.latest_rows(spark.read.parquet(f"{run}/out")).collect()}
    assert got == {1: "AGAIN", 2: "NEW", 9: "T"}
