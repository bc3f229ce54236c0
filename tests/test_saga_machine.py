"""The saga automaton: batch = walk event by event = stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerline.operators import saga_machine as M
from ledgerline.operators.saga import saga_state
from ledgerline.streaming import stateful as ST
from ledgerline.streaming.runner import new_run_dir, run_to_parquet
from ledgerline.streaming.sources import read_event_stream, stage_in_order

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "order_id long, event_type string, ts timestamp_ntz"
COLS = ["order_id", "state", "reached", "compensation", "compensated", "illegal", "last_ts"]


def walk(rows):
    out = []
    for key in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == key and r[1] in M.EVENTS), key=lambda r: (r[2], M.EVENTS.index(r[1])))
        node, illegal = None, 0
        for _, event, _ in mine:
            after = M.next_node(node, event)
            illegal += after is None
            node = node if after is None else after
        if mine:
            comp = None if node is None or node[0] in M.STEPS else ",".join(M.COMPENSATIONS[node[1]])
            out.append((key, node and node[0], node and node[1], comp, node and node[2], illegal, max(r[2] for r in mine)))
    return out


def sagas(seed, n):
    rng = random.Random(seed)
    rows = []
    for key in range(n):
        t = T0 + dt.timedelta(minutes=rng.randrange(600))
        for _ in range(rng.randrange(1, 9)):
            rows.append((key, rng.choice([*M.EVENTS, "OrderCreated", "InventoryReserved", "Other"]), t))
            t += dt.timedelta(minutes=rng.randrange(1, 30))
    return rows


def test_random_sagas_with_a_hot_key(spark):
    rows = sagas(5, 150) + [(999, random.Random(k).choice(M.EVENTS), T0 + dt.timedelta(seconds=k)) for k in range(700)]
    got = [tuple(r) for r in M.saga_machine(spark.createDataFrame(rows, SCHEMA).repartition(5)).select(COLS).orderBy("order_id").collect()]
    assert got == walk(rows) and {r[1] for r in got} >= {"STARTED", "COMPENSATING", "FAILED", "COMPLETED", "INVENTORY_RESERVED", "PAYMENT_PROCESSED"} - {"COMPLETED"}
    assert M.saga_machine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_full_compensation_and_failure_as_first_event(spark):
    def at(k):
        return T0 + dt.timedelta(hours=k)
    rows = [(1, e, at(k)) for k, e in enumerate(["OrderCreated", "InventoryReserved", "PaymentProcessed", "PaymentFailed", "PaymentRefunded", "InventoryReleased", "OrderCancelled"])]
    rows += [(2, "InventoryReservationFailed", at(0)), (3, "PaymentFailed", at(0)), (3, "OrderCancelled", at(1))]
    rows += [(4, "OrderConfirmed", at(0)), (5, "OrderCreated", at(0)), (5, "PaymentProcessed", at(1)), (5, "InventoryReserved", at(2))]
    got = {r.order_id: tuple(r)[1:6] for r in M.saga_machine(spark.createDataFrame(rows, SCHEMA)).select(COLS).collect()}
    assert got[1] == ("FAILED", 2, "refund_payment,release_inventory,cancel_order", 3, 0)
    assert got[2] == ("COMPENSATING", 0, "cancel_order", 0, 0) and got[3] == ("FAILED", 0, "cancel_order", 1, 0)
    assert got[4] == (None, None, None, None, 1) and got[5] == ("INVENTORY_RESERVED", 1, None, 0, 1)
    old = {r.order_id: (r.state, r.reached, r.compensation) for r in saga_state(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert old[2] == ("FAILED", 0, "cancel_order")


def test_maps_compose(spark):
    one, two = F.struct(F.lit(M.TABLE[0]).alias("to"), F.lit(M.MISFIT[0]).alias("bad")), F.struct(F.lit(M.TABLE[4]).alias("to"), F.lit(M.MISFIT[4]).alias("bad"))
    got = spark.range(1).select(M._then(one, two).alias("m")).first().m
    assert list(got.to) == [M.TABLE[4][s] for s in M.TABLE[0]]
    assert list(got.bad) == [M.MISFIT[0][s] + M.MISFIT[4][M.TABLE[0][s]] for s in range(M.N)]


def test_stream_equals_batch_and_times_out(spark):
    rows = sagas(8, 60)
    run = new_run_dir(spark, "machine")
    df = spark.createDataFrame(rows, SCHEMA)
    cap = stage_in_order(df, f"{run}/in", "ts", 3, files_per_slice=2,
                         tail=spark.createDataFrame([(-1, "Sentinel", dt.datetime(2100, 1, 1))], SCHEMA))
    stream = read_event_stream(spark, f"{run}/in/*", df.schema, max_files=cap)
    run_to_parquet(ST.saga_machine_stream(stream, timeout_hours=24), f"{run}/out", f"{run}/ckpt", state_partitions=4)
    emitted = spark.read.parquet(f"{run}/out").where("order_id >= 0")
    got = ST.latest_machine(emitted).orderBy("order_id").collect()
    assert [tuple(r)[:7] for r in got] == walk(rows)
    assert {r.order_id for r in got if r.timed_out} == {r[0] for r in walk(rows) if r[1] not in ("COMPLETED", "FAILED")}
