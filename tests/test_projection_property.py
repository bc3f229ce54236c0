"""The single-aggregate projection equals a literal event-by-event fold of
the reference's handlers, on random histories (both delivery modes)."""

import datetime as dt
import random

from ledgerline.operators import projection as P

from .conftest import NOW

COLS = ("order_id long, seq int, event_id string, event_type string, customer_id long, total_amount double, "
        "currency string, item_count int, shipping_address string, new_status string, reason string, "
        "occurred_at timestamp_ntz, correlation_id string")
T0 = dt.datetime(2024, 1, 1)


def _history(rnd, order_id):
    events, seq = [], 0
    for _ in range(rnd.randrange(1, 9)):
        seq += 1
        kind = rnd.choices(["c", "s", "x", "r"], [3, 4, 2, 2])[0]
        if kind == "r" and events:  # redelivery of an earlier event, same id
            e = dict(rnd.choice(events))
            e["seq"] = seq
            events.append(e)
            continue
        corr = rnd.choice([None, f"corr-{order_id}-{seq}"])
        if kind == "c" or kind == "r":
            e = dict(event_type="OrderCreated", customer_id=order_id % 7, total_amount=float(rnd.randrange(1, 900)),
                     currency=rnd.choice(["USD", "EUR"]), item_count=rnd.randrange(1, 5),
                     shipping_address=f"{order_id} Lane", new_status="CREATED", reason=None)
        elif kind == "s":
            e = dict(event_type="OrderStatusChanged", customer_id=None, total_amount=None, currency=None,
                     item_count=None, shipping_address=None, new_status=rnd.choice(["SHIPPED", "PENDING"]),
                     reason=None)
        else:
            e = dict(event_type="OrderCancelled", customer_id=None, total_amount=None, currency=None,
                     item_count=None, shipping_address=None, new_status="CANCELLED", reason=f"r{seq}")
        e.update(order_id=order_id, seq=seq, event_id=f"{order_id}-{seq}", correlation_id=corr,
                 occurred_at=T0 + dt.timedelta(hours=seq))
        events.append(e)
    return events


def _fold(events):
    """The handlers, applied in delivery order."""
    row = None
    for e in sorted(events, key=lambda e: e["seq"]):
        if e["event_type"] == "OrderCreated":
            row = dict(customer_id=e["customer_id"], total_amount=e["total_amount"], currency=e["currency"],
                       item_count=e["item_count"], shipping_address=e["shipping_address"],
                       last_order_status=e["new_status"], cancellation_reason=None, created_at=e["occurred_at"],
                       last_correlation_id=e["correlation_id"])
        elif row is None:
            continue  # out-of-order guard: no row yet
        else:
            row["last_order_status"] = "CANCELLED" if e["event_type"] == "OrderCancelled" else e["new_status"]
            if e["event_type"] == "OrderCancelled":
                row["cancellation_reason"] = e["reason"]
            if e["correlation_id"] is not None:
                row["last_correlation_id"] = e["correlation_id"]
    return row


def _dedup(events):
    seen, out = set(), []
    for e in sorted(events, key=lambda e: e["seq"]):
        if e["event_id"] not in seen:
            seen.add(e["event_id"])
            out.append(e)
    return out


def test_projection_matches_sequential_fold(spark):
    rnd = random.Random(11)
    events = [e for oid in range(300) for e in _history(rnd, oid)]
    keys = ["order_id", "seq", "event_id", "event_type", "customer_id", "total_amount", "currency", "item_count",
            "shipping_address", "new_status", "reason", "occurred_at", "correlation_id"]
    df = spark.createDataFrame([tuple(e[k] for k in keys) for e in events], COLS)
    fields = ["customer_id", "total_amount", "currency", "item_count", "shipping_address", "last_order_status",
              "cancellation_reason", "created_at", "last_correlation_id"]
    for mode, prep in (("as_delivered", lambda x: x), ("dedup", _dedup)):
        got = {r.order_id: {f: (float(r[f]) if f == "total_amount" and r[f] is not None else r[f]) for f in fields}
               for r in P.project(df, NOW, mode).collect()}
        want = {}
        for oid in range(300):
            row = _fold(prep([e for e in events if e["order_id"] == oid]))
            if row is not None:
                want[oid] = row
        assert got == want, mode
