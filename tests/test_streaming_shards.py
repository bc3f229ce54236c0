"""Orders in shards: one state row for each shard, and what each order emits is what a state of its own would give."""

import datetime as dt
import random

from ledgerline.streaming import stateful as ST
from ledgerline.streaming.runner import new_run_dir, read_output, run_to_parquet
from ledgerline.streaming.sources import read_event_stream

T0 = dt.datetime(2024, 1, 1)
COLS = "order_id long, seq int, event_type string, customer_id long, total_amount double, currency string, item_count int, " \
       "shipping_address string, new_status string, reason string, occurred_at timestamp_ntz, correlation_id string, arrival_ts timestamp"
BIG = 2**53 + 1


def _drain(spark, batches, schema, build, name):
    """The batches of rows one after the other; emitted rows and the state rows of the last progress."""
    run = new_run_dir(spark, name)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{run}/in/r={k}")
    stream = read_event_stream(spark, f"{run}/in/*", spark.createDataFrame([], schema).schema, max_files=1)
    q = run_to_parquet(build(stream), f"{run}/out", f"{run}/ckpt", state_partitions=2)
    return read_output(spark, f"{run}/out"), max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])


def _events(rng, days):
    rows = []
    for order in range(40):
        at = rng.random() * days
        for seq in rng.sample([1, 2, 3, 4, 5], rng.randrange(1, 6)):
            kind = rng.choice(["OrderCreated", "OrderStatusChanged", "OrderStatusChanged", "OrderCancelled"])
            when = T0 + dt.timedelta(days=at)
            at += rng.choice([0, 0.01, 0.6, 3])
            rows.append((order, seq, kind, rng.choice([None, BIG + 2 * seq]), rng.choice([None, 0.1 * seq]), rng.choice([None, "USD"]), rng.choice([None, seq]),
                         rng.choice([None, "x"]), rng.choice([None, f"S{seq}"]), rng.choice([None, f"R{seq}"]), when, rng.choice([None, f"c{seq}"]), when))
    return sorted(rows, key=lambda r: r[-1])


def _model(batches, wait, retain):
    """Every order with a state of its own."""
    states, out, mark = {}, [], None
    for batch in [*batches, []]:
        now = mark
        for order in sorted({r[0] for r in batch}):
            st = states.setdefault(order, {"row": None, "version": 0, "buffer": [], "at": T0})
            for r in sorted((r for r in batch if r[0] == order), key=lambda r: (r[-1], r[1])):
                st["at"] = max(st["at"], r[-1])
                if r[2] != "OrderCreated" and st["row"] is None:
                    st["buffer"].append(r)
                    continue
                waited = sorted(st["buffer"], key=lambda b: b[1]) if r[2] == "OrderCreated" else []
                for e in [r, *waited]:
                    if e[2] == "OrderCreated":
                        st["row"], st["buffer"] = [*e[3:8], e[8], None, e[10], e[11]], []
                    else:
                        cancelled = e[2] == "OrderCancelled"
                        st["row"][5] = "CANCELLED" if cancelled else e[8]
                        st["row"][6] = e[9] if cancelled else st["row"][6]
                        st["row"][8] = e[11] or st["row"][8]
            if st["row"]:
                st["version"] += 1
                out.append(("row", order, st["version"], None, None, *st["row"]))
            st["until"] = max(st["at"] + (wait if st["buffer"] else retain), now or T0)
        for order in [o for o, st in states.items() if now and st["until"] < now and o not in {r[0] for r in batch}]:
            out += [("skipped", order, 0, b[1], b[2], *[None] * 9) for b in states.pop(order)["buffer"]]
        mark = max([r[-1] - dt.timedelta(days=1) for r in batch] + ([mark] if mark else []), default=None)
    return out


def test_every_order_emits_what_its_own_state_would(spark):
    rows = _events(random.Random(3), 20)
    batches = [rows[i:i + 25] for i in range(0, len(rows), 25)]
    batches.append([(99, 1, "OrderCreated", *[None] * 7, dt.datetime(2030, 1, 1), None, dt.datetime(2030, 1, 1))])
    wait, retain = dt.timedelta(days=1), dt.timedelta(days=5)
    emitted, held = _drain(spark, batches, COLS, lambda s: ST.project_stream(s, retain_us=5 * ST.DAY_US, shards=3), "shards")
    got = [(r.kind, r.order_id, r.version, r.seq, r.event_type, r.customer_id, r.total_amount, r.currency, r.item_count, r.shipping_address, r.last_order_status,
            r.cancellation_reason, r.created_us and T0 + dt.timedelta(microseconds=r.created_us - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**6),
            r.last_correlation_id) for r in emitted.collect()]
    want = _model(batches, wait, retain)
    assert {r[0] for r in want} == {"row", "skipped"} and sum(r[2] > 1 for r in want) > 5
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert held <= 3


def test_sagas_share_the_state_rows_of_their_shards(spark):
    """Before: one state row, and one Python call in each batch, for every order."""
    rows = [(k, e, T0 + dt.timedelta(hours=h)) for k in range(200) for h, e in enumerate(["OrderCreated", "InventoryReserved", "PaymentFailed"][:1 + k % 3])]
    end = [[(-1, "Sentinel", dt.datetime(2100, 1, 1))]]
    for build, failed in ((ST.saga_stream, "FAILED"), (ST.saga_machine_stream, "COMPENSATING")):
        emitted, held = _drain(spark, [rows, *end], "order_id long, event_type string, ts timestamp_ntz", lambda s: build(s, shards=4), "saga")
        latest = ST.latest_saga(emitted) if build is ST.saga_stream else ST.latest_machine(emitted)
        got = {r.order_id: (r.state, r.reached, r.timed_out) for r in latest.where("order_id >= 0").collect()}
        assert got == {k: [("STARTED", 0, True), ("INVENTORY_RESERVED", 1, True), (failed, 1, failed != "FAILED")][k % 3] for k in range(200)}
        assert held <= 4
