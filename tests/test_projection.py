import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import projection as P
from ledgerline.operators import read_model as RM

from .conftest import NOW

COLS = ("order_id long, seq int, event_id string, event_type string, customer_id long, total_amount double, "
        "currency string, item_count int, shipping_address string, new_status string, reason string, "
        "occurred_at timestamp_ntz, correlation_id string")
T0 = dt.datetime(2024, 1, 10)


def ev(spark, rows):
    full = []
    for r in rows:
        d = dict(order_id=1, seq=1, event_id=None, event_type="OrderCreated", customer_id=7, total_amount=200.0,
                 currency="USD", item_count=3, shipping_address="10 Test Lane", new_status="CREATED",
                 reason=None, occurred_at=T0, correlation_id=None)
        d.update(r)
        d["event_id"] = d["event_id"] or f"{d['order_id']}-{d['seq']}"
        full.append(tuple(d.values()))
    return spark.createDataFrame(full, COLS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_created_projects_row(spark):
    r = one(P.project(ev(spark, [{}]), NOW))
    assert (r.last_order_status, float(r.total_amount), r.currency, r.item_count) == ("CREATED", 200.0, "USD", 3)


def test_status_change_with_correlation(spark):
    e = ev(spark, [{}, {"seq": 2, "event_type": "OrderStatusChanged", "new_status": "SHIPPED",
                        "correlation_id": "corr-abc", "customer_id": None}])
    r = one(P.project(e, NOW))
    assert r.last_order_status == "SHIPPED" and r.last_correlation_id == "corr-abc"


def test_cancel_sets_reason(spark):
    e = ev(spark, [{}, {"seq": 2, "event_type": "OrderCancelled", "new_status": "CANCELLED",
                        "reason": "Changed mind"}])
    r = one(P.project(e, NOW))
    assert r.last_order_status == "CANCELLED" and r.cancellation_reason == "Changed mind"


def test_twice_is_one_row(spark):
    assert P.project(ev(spark, [{}, {"seq": 2, "event_id": "1-1"}]), NOW).count() == 1


def test_early_status_has_no_row_and_is_skipped(spark):
    e = ev(spark, [{"seq": 1, "event_type": "OrderStatusChanged", "new_status": "SHIPPED"}])
    assert P.project(e, NOW).count() == 0
    assert P.skipped_events(e).count() == 1


def test_modes_differ_on_redelivered_created(spark):
    e = ev(spark, [{}, {"seq": 2, "event_type": "OrderCancelled", "new_status": "CANCELLED", "reason": "x"},
                   {"seq": 3, "event_id": "1-1"}])
    assert one(P.project(e, NOW, "dedup")).last_order_status == "CANCELLED"
    r = one(P.project(e, NOW, "as_delivered"))
    assert r.last_order_status == "CREATED" and r.cancellation_reason is None


def test_spend_per_customer(spark):
    e = ev(spark, [{"order_id": 1, "total_amount": 100.0}, {"order_id": 2, "total_amount": 50.0}])
    r = one(RM.spend_per_customer(P.project(e, NOW)))
    assert r.total_spend == 150.0


def test_upsert_equals_full_projection(spark):
    e = ev(spark, [{}, {"seq": 2, "event_type": "OrderStatusChanged", "new_status": "SHIPPED",
                        "correlation_id": "c"},
                   {"seq": 3, "event_type": "OrderCancelled", "new_status": "CANCELLED", "reason": "r"},
                   {"order_id": 2}, {"order_id": 3, "seq": 1, "event_type": "OrderStatusChanged",
                                     "new_status": "SHIPPED"}])
    full = P.project(e, NOW, "as_delivered")
    snap = P.project(e.where(F.col("seq") <= 1), NOW, "as_delivered")
    up = P.upsert(snap, e.where(F.col("seq") > 1), NOW)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, up.collect()))


def test_status_history_matches_lag(spark):
    e = ev(spark, [{}, {"seq": 2, "event_type": "OrderStatusChanged", "new_status": "SHIPPED",
                        "occurred_at": T0 + dt.timedelta(hours=5)}])
    rows = sorted(P.status_history(e).collect(), key=lambda r: r.seq)
    assert rows[0].old_status is None and rows[1].old_status == "CREATED"
    assert rows[1].seconds_in_old_status == 5 * 3600
