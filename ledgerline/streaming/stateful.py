"""Stateful streaming with ``applyInPandasWithState``.

R03 projects order events into the read model while they arrive.  A status
or cancel event for an order without a row is buffered in the order's state
(the reference skipped it, expecting a redelivery that a later checkpoint
then skipped, B5); when the Created arrives the buffer is applied in sequence
order.  An event-time time-out emits buffered events whose Created never came
as ``skipped``.  State per order is one row plus the buffer of events that
arrived before its Created, bounded by the time-out.

R07 keeps the saga's furthest step, failure flag and last step time per order;
an event-time time-out marks sagas with no next step in time (R08).

Orders are dealt to shards by a hash, and a shard is the key of Spark's state:
one call per order costs milliseconds of Python however little it does, so a
call folds all orders of a shard at once in numpy.  A shard's state is one row per
live order (and the buffered events), each row with its own deadline; the shard's
time-out is the earliest of them, and a call lets go the orders whose deadline the
watermark has passed, as a time-out of each order would.  ``shards`` is fixed by
a query's checkpoint; a shard's live orders should fit a task many times over.

Each emitted row carries a per-order ``version``; the current read model is the
highest version per order (a partial ``max_by`` aggregate over the sink).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import schemas as S
from ..functions.time import as_instant, ntz_micros, ts
from ..operators import saga_machine as machine
from ..operators.saga import COMPENSATION_BY_STEP, STATE_BY_STEP
from ..sources.derive import SAGA_FAILURES, SAGA_STEPS

PROJECTION_OUT = ("kind string, order_id long, version int, seq int, event_type string, customer_id long, "
                  "total_amount double, currency string, item_count int, shipping_address string, "
                  "last_order_status string, cancellation_reason string, created_us long, "
                  "last_correlation_id string, arrival_us long")
PROJECTION_ROWS = ["order_id", "has_row", "version", "customer_id", "total_amount", "currency", "item_count",
                   "shipping_address", "status", "reason", "created_us", "corr", "max_us", "deadline"]
BUFFER_ROWS = ["order_id", "seq", "event_type", "new_status", "reason", "occurred_us", "correlation_id"]
_FIELDS = ["customer_id", "total_amount", "currency", "item_count", "shipping_address"]
DAY_US = 86_400_000_000

#: Shards of a stream by default, some dozens for each state partition of a small cluster.
SHARDS = 256
#: Stands for null in integer columns, which pandas would turn into floats.
NONE = -2**63
#: A shard's state: its tables as Arrow streams, the orders first.
SHARD_STATE = "orders binary, buffer binary"


def _integer(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NONE))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _pack(rows: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(blob)).read_all().to_pandas()


def _with_new(rows: pd.DataFrame, ids: np.ndarray, **values) -> pd.DataFrame:
    """State rows by order, with a row of ``values`` for each order of ``ids`` that has none."""
    fresh = pd.DataFrame({"order_id": np.setdiff1d(ids, rows["order_id"])}).assign(**values)
    both = fresh if rows.empty else rows if fresh.empty else pd.concat([rows, fresh], ignore_index=True)
    return both.sort_values("order_id", ignore_index=True)


def _sharded(events: DataFrame, cols: list[str], fold, expire, out: str, shards: int) -> DataFrame:
    """The output of ``fold`` and ``expire`` for each shard of the orders of ``events``.

    ``fold`` takes (orders, buffer, events of the shard, watermark in ms) and gives (orders, buffer,
    output); ``orders`` has ``order_id`` and ``deadline``, in ms and after the watermark for each order
    with events.  ``expire`` gives the output for orders whose deadline has passed, from (orders, buffer)."""
    names = _names(out)

    def fn(key, pdfs, state):
        now = state.getCurrentWatermarkMs()
        orders, buffer = [_unpack(b) for b in state.get] if state.exists else (pd.DataFrame({"order_id": []}), pd.DataFrame({"order_id": []}))
        emitted = []
        if not state.hasTimedOut:
            orders, buffer, rows = fold(orders, buffer, pd.concat(list(pdfs), ignore_index=True), now)
            emitted.append(rows)
        due = orders["deadline"].to_numpy() < now
        if due.any():
            gone, waited = orders[due], buffer["order_id"].isin(orders["order_id"][due])
            emitted.append(expire(gone, buffer[waited]))
            orders, buffer = orders[~due], buffer[~waited]
        if len(orders):
            state.update((_pack(orders), _pack(buffer)))
            state.setTimeoutTimestamp(max(int(orders["deadline"].min()), now + 1))
        elif state.exists:
            state.remove()
        for rows in emitted:
            if len(rows):
                yield rows.reindex(columns=names)

    dealt = events.select(F.pmod(F.xxhash64("order_id"), F.lit(shards)).alias("shard"), *[c for c in cols if c != "order_id"],
                          _integer(F.col("order_id")).alias("order_id"))
    done = dealt.groupBy("shard").applyInPandasWithState(fn, out, SHARD_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(*[F.when(F.col(c) != NONE, F.col(c)).alias(c) if t == "bigint" else F.col(c) for c, t in done.dtypes])


def _deadline(rows: pd.DataFrame, touched: np.ndarray, wait_ms, last: str, now: int) -> None:
    """Set the deadline of the touched orders: some time after their last event, and after the watermark."""
    at = np.maximum(rows[last].to_numpy() // 1000 + wait_ms, now + 1)
    old = rows["deadline"].to_numpy()
    rows["deadline"] = np.where(touched, at, old)


def _project_fold(timeout_us: int, retain_us: int):
    def fold(rows, buffer, ev, now):
        rows = _with_new(rows, ev["order_id"], has_row=False, version=0, customer_id=NONE, total_amount=np.nan, currency=None,
                         item_count=NONE, shipping_address=None, status=None, reason=None, created_us=NONE, corr=None, max_us=0, deadline=0)
        ids, n = rows["order_id"].to_numpy(), len(rows)
        late = np.where(ev["seq"] == NONE, 2**63 - 1, ev["seq"])
        ev = ev.iloc[np.lexsort((late, ev["arrival_us"]))]
        touched, max_us = np.zeros(n, bool), rows["max_us"].to_numpy(copy=True)
        at = np.searchsorted(ids, ev["order_id"])
        touched[at] = True
        np.maximum.at(max_us, at, ev["arrival_us"].to_numpy())
        rows["max_us"] = max_us
        # What has waited for these orders comes first, as it arrived; other orders' events go on waiting.
        mine = buffer["order_id"].isin(ids[touched]).to_numpy(bool)
        blank = dict(customer_id=NONE, total_amount=np.nan, currency=None, item_count=NONE, shipping_address=None)
        x = pd.concat([buffer[mine].assign(**blank), ev], ignore_index=True) if mine.any() else ev.reset_index(drop=True)
        o, pos = np.searchsorted(ids, x["order_id"]), np.arange(len(x))
        created = (x["event_type"] == S.ORDER_CREATED).to_numpy(bool)
        had = rows["has_row"].to_numpy(bool)
        first = np.full(n, len(x))
        np.minimum.at(first, o[created], pos[created])
        has = had | (first < len(x))
        # Of an order without a row: its first Created, then in sequence order what came before, then the rest.
        phase = np.where(had[o] | (pos > first[o]), 2, np.where(pos == first[o], 0, 1))
        late = np.where(x["seq"] == NONE, 2**63 - 1, x["seq"])
        order = np.lexsort((pos, np.where(phase == 1, late, 0), phase, o))
        order = order[has[o[order]]]
        y, o, place = x.iloc[order], o[order], np.arange(len(order))
        created, cancelled = created[order], (y["event_type"] == S.ORDER_CANCELLED).to_numpy(bool)

        def newest(which):
            out = np.full(n, -1)
            np.maximum.at(out, o[which], place[which])
            return out

        base, tail = newest(created), newest(np.ones(len(order), bool))
        since = place >= base[o]
        cancel, corr = newest(cancelled & since), newest(y["correlation_id"].notna().to_numpy(bool) & since)

        def put(name, at, values):
            old = rows[name].to_numpy(copy=True)
            if old.dtype.kind not in "ifb":
                old = old.astype(object)
            old[at >= 0] = values[at[at >= 0]] if values is not None else None
            rows[name] = old

        for f in _FIELDS:
            put(f, base, y[f].to_numpy())
        put("created_us", base, y["occurred_us"].to_numpy())
        put("status", tail, np.where(cancelled, "CANCELLED", y["new_status"].to_numpy(object)))
        put("reason", base, None)
        put("reason", cancel, y["reason"].to_numpy(object))
        put("corr", base, None)
        put("corr", corr, y["correlation_id"].to_numpy(object))
        rows["has_row"], rows["version"] = has, rows["version"].to_numpy() + (tail >= 0)
        rest = x[~has[np.searchsorted(ids, x["order_id"])]][BUFFER_ROWS]
        buffer = pd.concat([buffer[~mine], rest], ignore_index=True) if (~mine).any() else rest
        # A buffer waits for its Created; an order with a row is forgotten when nothing more is expected.
        _deadline(rows, touched, np.where(has, retain_us, timeout_us) // 1000, "max_us", now)
        out = rows[tail >= 0].rename(columns={"status": "last_order_status", "reason": "cancellation_reason",
                                              "corr": "last_correlation_id", "max_us": "arrival_us"})
        return rows[PROJECTION_ROWS], buffer, _typed(out.assign(kind="row", seq=NONE))
    return fold


def _typed(out: pd.DataFrame) -> pd.DataFrame:
    """Int columns with nulls for ``NONE``; long ones keep it (Spark takes it out)."""
    for c in ("seq", "item_count"):
        if c in out.columns:
            out[c] = out[c].astype("Int64").mask(out[c] == NONE)
    return out


def _project_expire(rows, buffer):
    version = rows["version"].to_numpy()[np.searchsorted(rows["order_id"].to_numpy(), buffer["order_id"])]
    skipped = buffer[["order_id", "seq", "event_type"]].assign(kind="skipped", version=version, customer_id=NONE, created_us=NONE, arrival_us=NONE)
    return _typed(skipped)


def project_stream(events: DataFrame, watermark: str = "1 day", timeout_us: int = DAY_US, retain_us: int = 30 * DAY_US,
                   shards: int = SHARDS) -> DataFrame:
    """Streaming read-model projection with the out-of-order buffer.

    An order's state is dropped ``retain_us`` after its newest arrival; what comes
    later is for a batch (M11) to apply.

    ``events`` has the order-event columns plus ``arrival_ts`` (timestamp):
    the delivery time used for the watermark and the time-out.
    """
    prepared = (events.withWatermark("arrival_ts", watermark)
                .withColumn("occurred_us", _integer(ntz_micros(F.col("occurred_at"))))
                .withColumn("arrival_us", _integer(F.unix_micros("arrival_ts")))
                .withColumn("correlation_id", F.col("correlation_id").cast("string"))
                .withColumns({c: _integer(F.col(c)) for c in ("seq", "customer_id", "item_count")}))
    cols = ["order_id", "seq", "event_type", "customer_id", "total_amount", "currency", "item_count",
            "shipping_address", "new_status", "reason", "occurred_us", "arrival_us", "correlation_id",
            "arrival_ts"]
    return _sharded(prepared, cols, _project_fold(timeout_us, retain_us), _project_expire, PROJECTION_OUT, shards)


def latest_rows(emitted: DataFrame) -> DataFrame:
    """The current read model from the emitted rows: the newest arrival, then the highest version per order."""
    rows = emitted.where(F.col("kind") == "row")
    cols = [c for c in rows.columns if c not in ("order_id", "version", "kind", "seq", "event_type", "arrival_us")]
    g = rows.groupBy("order_id").agg(F.max_by(F.struct(*cols), F.struct("arrival_us", "version")).alias("_r"))
    return g.select("order_id", *[F.col("_r")[c].alias(c) for c in cols]).withColumn(
        "created_at", F.timestamp_add("MICROSECOND", F.col("created_us"), ts("1970-01-01 00:00:00"))
    ).drop("created_us")


SAGA_OUT = ("order_id long, version int, state string, reached int, compensation string, "
            "last_us long, timed_out boolean")


def _saga_rows(rows: pd.DataFrame, timed_out: bool) -> pd.DataFrame:
    failed, reached = rows["failed"].to_numpy(bool), rows["reached"]
    return rows[["order_id", "version", "reached", "last_us"]].assign(
        state=np.where(failed, "FAILED", reached.map(STATE_BY_STEP).to_numpy(object)),
        compensation=np.where(failed, reached.map(COMPENSATION_BY_STEP).to_numpy(object), None), timed_out=timed_out)


def _saga_fold(timeout_us: int):
    def fold(rows, buffer, ev, now):
        rows = _with_new(rows, ev["order_id"], reached=0, failed=False, last_us=NONE, version=0, deadline=0)
        at = np.searchsorted(rows["order_id"], ev["order_id"])
        touched, failed = np.zeros(len(rows), bool), rows["failed"].to_numpy(bool).copy()
        reached, last = rows["reached"].to_numpy(copy=True), rows["last_us"].to_numpy(copy=True)
        touched[at] = True
        np.maximum.at(reached, at, ev["event_type"].map(SAGA_STEPS).fillna(0).to_numpy("int64"))
        failed[at[ev["event_type"].isin(SAGA_FAILURES).to_numpy(bool)]] = True
        np.maximum.at(last, at, ev["ts_us"].to_numpy())
        # An ended saga is kept for as long: what comes after its end must not begin a new one.
        rows = rows.assign(reached=reached, failed=failed, last_us=last, version=rows["version"] + touched)
        _deadline(rows, touched, timeout_us // 1000, "last_us", now)
        return rows, buffer, _saga_rows(rows[touched], False)
    return fold


def _saga_expire(rows, buffer):
    open_ = rows[~(rows["failed"] | (rows["reached"] == 3))]
    return _saga_rows(open_.assign(version=open_["version"] + 1), True)


def saga_stream(events: DataFrame, watermark: str = "1 hour", timeout_hours: int = 2, shards: int = SHARDS) -> DataFrame:
    """Saga state per order as events stream in; an order with no
    next step within ``timeout_hours`` of event time is emitted ``timed_out``."""
    prepared = (events.withColumn("event_ts", as_instant(F.col("ts")))
                .withWatermark("event_ts", watermark)
                .withColumn("ts_us", _integer(F.unix_micros("event_ts"))))
    return _sharded(prepared, ["order_id", "event_type", "ts_us", "event_ts"], _saga_fold(timeout_hours * 3_600_000_000),
                    _saga_expire, SAGA_OUT, shards)


MACHINE_OUT = "order_id long, version int, node int, illegal long, last_us long, timed_out boolean"


def _machine_fold(timeout_us: int):
    codes = {e: k for k, e in enumerate(machine.EVENTS)}
    table, misfit = np.array(machine.TABLE), np.array(machine.MISFIT)

    def fold(rows, buffer, ev, now):
        rows = _with_new(rows, ev["order_id"], node=machine.START, illegal=0, last_us=NONE, version=0, deadline=0)
        at, code = np.searchsorted(rows["order_id"], ev["order_id"]), ev["event_type"].map(codes).fillna(-1).to_numpy("int64")
        touched = np.zeros(len(rows), bool)
        touched[at] = True
        node, bad, last = (rows[c].to_numpy(copy=True) for c in ("node", "illegal", "last_us"))
        us = ev["ts_us"].to_numpy()
        known = np.lexsort((code, np.where(us == NONE, 2**63 - 1, us), at))
        known = known[code[known] >= 0]
        at, code, us = at[known], code[known], us[known]
        np.maximum.at(last, at, us)
        # The first event of every order, then the second ones, and so on.
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, "int64")
        nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        by_turn = np.argsort(nth, kind="stable")
        ends = np.cumsum(np.bincount(nth)) if len(at) else []
        for lo, hi in zip(np.r_[0, ends[:-1]] if len(at) else [], ends):
            turn = by_turn[int(lo):int(hi)]
            o, c = at[turn], code[turn]
            bad[o] += misfit[c, node[o]]
            node[o] = table[c, node[o]]
        rows = rows.assign(node=node, illegal=bad, last_us=last, version=rows["version"] + touched)
        _deadline(rows, touched, timeout_us // 1000, "last_us", now)
        return rows, buffer, rows[touched].assign(timed_out=False)
    return fold


def _machine_expire(rows, buffer):
    ended = [k for k, n in enumerate(machine.NODES) if n is not None and n[0] in ("COMPLETED", "FAILED")]
    open_ = rows[~rows["node"].isin(ended)]
    return open_.assign(version=open_["version"] + 1, timed_out=True)


def saga_machine_stream(events: DataFrame, watermark: str = "1 hour", timeout_hours: int = 2, shards: int = SHARDS) -> DataFrame:
    """The automaton of ``operators.saga_machine`` per order as events stream in.
    A saga that has not ended ``timeout_hours`` after its last event is emitted
    ``timed_out``; an ended one is forgotten then.  Events of one micro-batch are
    applied in time order; a micro-batch must not be older than the one before."""
    prepared = (events.withColumn("event_ts", as_instant(F.col("ts")))
                .withWatermark("event_ts", watermark)
                .withColumn("ts_us", _integer(F.unix_micros("event_ts"))))
    return _sharded(prepared, ["order_id", "event_type", "ts_us", "event_ts"], _machine_fold(timeout_hours * 3_600_000_000),
                    _machine_expire, MACHINE_OUT, shards)


def latest_machine(emitted: DataFrame) -> DataFrame:
    """(order_id, state, reached, compensation, compensated, illegal, last_ts, timed_out): the newest row per order."""
    g = emitted.groupBy("order_id").agg(F.max_by(F.struct("node", "illegal", "last_us", "timed_out"), "version").alias("_r"))
    return g.select("order_id", *machine.describe(F.col("_r.node")), F.col("_r.illegal").alias("illegal"),
                    F.timestamp_add("MICROSECOND", F.col("_r.last_us"), ts("1970-01-01 00:00:00")).alias("last_ts"),
                    F.col("_r.timed_out").alias("timed_out"))


def latest_saga(emitted: DataFrame) -> DataFrame:
    cols = ["state", "reached", "compensation", "last_us", "timed_out"]
    g = emitted.groupBy("order_id").agg(F.max_by(F.struct(*cols), F.col("version")).alias("_r"))
    return g.select("order_id", *[F.col("_r")[c].alias(c) for c in cols])
