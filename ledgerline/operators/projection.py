"""Read-model projection of order events.

The projection is one grouped aggregate per order: every field of the read
model is "the value from the latest event (by ``seq``) that sets it", and an
``OrderCreated`` sets every field.  That makes the fold expressible with
``max_by`` over a filtered ordering, which Spark aggregates partially on the
map side, so an order that holds a third of all events is combined per task
before the shuffle instead of landing whole in one task (which a window over
``partitionBy(order_id)`` would do).

Event columns used: order_id, seq, event_id, event_type, customer_id,
total_amount, currency, item_count, shipping_address, new_status, reason,
occurred_at, correlation_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.time import ts

MODES = ("dedup", "as_delivered")

READ_MODEL_COLS = ["order_id", "customer_id", "total_amount", "currency", "item_count",
                   "shipping_address", "last_order_status", "cancellation_reason", "created_at",
                   "projected_at", "last_correlation_id"]


def dedup_events(events: DataFrame, key: str = "event_id", order: str = "seq") -> DataFrame:
    """Keep the first delivery of every event id.

    The least struct of (order, row) is a partial aggregate that holds one row per
    key: duplicates are collapsed in each task before the shuffle on ``key``.
    """
    cols = [c for c in events.columns if c != key]
    row = F.struct(*cols)
    picked = events.groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), row.alias("r"))).alias("_m"))  # equal order: the least row
    return picked.select(key, *[F.col("_m.r")[c].alias(c) for c in cols]).select(*events.columns)


def _status_value(event_type, new_status):
    return F.when(event_type == S.ORDER_CANCELLED, F.lit("CANCELLED")).otherwise(new_status)


def project(events: DataFrame, now, mode: str = "dedup",
            status_map: dict | None = None) -> DataFrame:
    """Fold order events into the read model, one row per order with a Created.

    ``mode='dedup'`` first drops redelivered event ids (W02); ``as_delivered``
    replays every delivery, so a redelivered Created overwrites later state.
    ``status_map`` maps extra event types to the status they set (W14).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    ev = dedup_events(events) if mode == "dedup" else events
    return _fold(ev.withColumns({"_state": F.lit(False), "projected_at": F.lit(None).cast("timestamp_ntz")}), now, status_map)


def _fold(ev: DataFrame, now, status_map: dict | None = None) -> DataFrame:
    """The single-aggregate fold.  ``_state`` rows are snapshot rows: they set
    every field, including reason and correlation, exactly as stored."""
    et, seq = F.col("event_type"), F.col("seq")
    state = F.col("_state")
    created = (et == S.ORDER_CREATED) | state
    cancelled = et == S.ORDER_CANCELLED
    status = _status_value(et, F.col("new_status"))
    for etype, st in (status_map or {}).items():
        status = F.when(et == etype, F.lit(st)).otherwise(status)
    g = ev.groupBy("order_id").agg(
        F.max(F.when(created, seq)).alias("_created_seq"),
        F.count_if(~state).alias("_n_new"), F.max(F.when(state, F.col("projected_at"))).alias("_before"),
        F.max_by(F.struct("customer_id", "total_amount", "currency", "item_count",
                          "shipping_address", "occurred_at"),
                 F.when(created, seq)).alias("_c"),
        F.max_by(status, seq).alias("last_order_status"),
        F.max_by(F.struct(F.when(cancelled | state, F.col("reason")).alias("v")),
                 F.when(created | cancelled, seq)).alias("_reason"),
        F.max_by(F.struct(F.col("correlation_id").cast("string").alias("v")),
                 F.when(created | F.col("correlation_id").isNotNull(), seq)).alias("_corr"),
    )
    return g.where(F.col("_created_seq").isNotNull()).select(
        "order_id",
        F.col("_c.customer_id").alias("customer_id"),
        F.col("_c.total_amount").cast("decimal(19,2)").alias("total_amount"),
        F.col("_c.currency").alias("currency"),
        F.col("_c.item_count").cast("int").alias("item_count"),
        F.col("_c.shipping_address").alias("shipping_address"),
        "last_order_status",
        F.col("_reason.v").alias("cancellation_reason"),
        F.col("_c.occurred_at").alias("created_at"),
        F.when((F.col("_n_new") == 0) & F.col("_before").isNotNull(), F.col("_before")).otherwise(ts(now)).alias("projected_at"),
        F.col("_corr.v").alias("last_correlation_id"),
    )


def project_confirmed(events: DataFrame, now, status_map: dict, confirmed: str = "OrderConfirmed", mode: str = "dedup") -> DataFrame:
    """The extended projection with ``confirmed_at``, the time of the newest
    confirmation (null if there is none since the newest Created)."""
    ev = dedup_events(events) if mode == "dedup" else events
    created, is_it = F.col("event_type") == S.ORDER_CREATED, F.col("event_type") == confirmed
    # One more value from the same grouping: both aggregates share its exchange.
    at = ev.groupBy("order_id").agg(F.max_by(F.struct(F.when(is_it, F.col("occurred_at")).alias("v")), F.when(created | is_it, F.col("seq"))).alias("_a")) \
        .select(F.col("order_id").alias("_order"), F.col("_a.v").alias("confirmed_at"))
    model = project(ev, now, "as_delivered", status_map)
    return model.join(at, F.col("order_id") == F.col("_order"), "left").drop("_order")


def payment_status_events(payments: DataFrame) -> DataFrame:
    """Payments (order_id, seq, event_id, paid, occurred_at) as status changes that W01 folds."""
    none = F.lit(None)
    return payments.select(
        "order_id", "seq", "event_id", F.lit(S.ORDER_STATUS_CHANGED).alias("event_type"), none.cast("bigint").alias("customer_id"),
        none.cast("double").alias("total_amount"), none.cast("string").alias("currency"), none.cast("int").alias("item_count"),
        none.cast("string").alias("shipping_address"), F.when(F.col("paid"), "PAID").otherwise("PAYMENT_FAILED").alias("new_status"),
        none.cast("string").alias("reason"), "occurred_at", none.cast("string").alias("correlation_id"))


def skipped_events(events: DataFrame) -> DataFrame:
    """Non-Created events delivered before their order's first Created
    (or for an order that never had one): the out-of-order guard skips them."""
    first = (events.groupBy("order_id")
             .agg(F.min(F.when(F.col("event_type") == S.ORDER_CREATED, F.col("seq"))).alias("_first")))
    return (events.where(F.col("event_type") != S.ORDER_CREATED)
            .join(first, "order_id", "left")
            .where(F.col("_first").isNull() | (F.col("seq") < F.col("_first")))
            .drop("_first"))


EVENT_COLS = ["order_id", "seq", "event_id", "event_type", "customer_id", "total_amount",
              "currency", "item_count", "shipping_address", "new_status", "reason", "occurred_at",
              "correlation_id"]


def snapshot_as_events(model: DataFrame, seq: int = 0) -> DataFrame:
    """A read-model row as a state event (lowest ``seq``) that sets every field."""
    return model.select(
        "order_id", F.lit(seq).alias("seq"),
        F.concat(F.lit("snapshot-"), F.col("order_id").cast("string")).alias("event_id"),
        F.lit(S.ORDER_CREATED).alias("event_type"), "customer_id",
        F.col("total_amount").cast("decimal(19,2)").alias("total_amount"),
        "currency", "item_count", "shipping_address",
        F.col("last_order_status").alias("new_status"),
        F.col("cancellation_reason").alias("reason"),
        F.col("created_at").alias("occurred_at"),
        F.col("last_correlation_id").alias("correlation_id"),
        F.lit(True).alias("_state"), F.col("projected_at").cast("timestamp_ntz").alias("projected_at"))


def upsert(model: DataFrame, delta: DataFrame, now, seen_ids: DataFrame | None = None) -> DataFrame:
    """Apply new events to a read-model snapshot and return the next snapshot.

    Parquet has no MERGE, so the snapshot rows become state events with the
    lowest sequence and the delta is folded over them in the same single
    aggregate as ``project`` (one shuffle on order_id, partial aggregation).
    Rows that the delta does not touch keep their ``projected_at``, and stored
    amounts stay decimals.
    ``seen_ids`` (event ids already applied) drops redeliveries (inbox, J02).
    """
    if seen_ids is not None:
        delta = delta.join(seen_ids.select("event_id").distinct(), "event_id", "left_anti")
    d = (delta.select(*EVENT_COLS).withColumn("total_amount", F.col("total_amount").cast("decimal(19,2)"))
         .withColumns({"_state": F.lit(False), "projected_at": F.lit(None).cast("timestamp_ntz")}))
    return _fold(snapshot_as_events(model).unionByName(d), now)


def state_as_of(events: DataFrame, now, max_seq: int | None = None, at=None,
                mode: str = "dedup") -> DataFrame:
    """The read model as of a sequence number or an event time."""
    ev = events
    if max_seq is not None:
        ev = ev.where(F.col("seq") <= max_seq)
    if at is not None:
        ev = ev.where(F.col("occurred_at") <= ts(at))
    return project(ev, now, mode)


def states_as_of(events: DataFrame, requests: DataFrame, now, by: str = "version", mode: str = "dedup") -> DataFrame:
    """W06 for a table of requests: (request_id, order_id, as_of) -> the read model of each
    request's order as of that version (``by='version'``: ``seq <= as_of``) or event time
    (``by='time'``: ``occurred_at <= as_of``), with ``found`` false where the order had
    no Created by then.

    Every field of the fold is the value of the highest ``seq`` that sets it, so it is a
    running maximum of (seq, value).  Events and requests are merged in one range sort by
    (order, position), and a request reads the maxima that stand at its place; what an
    order has in earlier range partitions is carried over (``running_max``).  An order with
    many requests or events is read once, not once per request."""
    from .ordering import running_max
    if by not in ("version", "time"):
        raise ValueError("by must be version or time")
    ev = dedup_events(events) if mode == "dedup" else events
    et, seq = F.col("event_type"), F.col("seq").cast("bigint")
    created, cancelled = et == S.ORDER_CREATED, et == S.ORDER_CANCELLED
    corr = F.col("correlation_id").cast("string")
    model = F.struct("customer_id", F.col("total_amount").cast("decimal(19,2)").alias("total_amount"), "currency",
                     F.col("item_count").cast("int").alias("item_count"), "shipping_address", "occurred_at")
    at = "seq" if by == "version" else "occurred_at"
    kind = "bigint" if by == "version" else "timestamp_ntz"
    setters = {"_c": F.when(created, F.struct(seq.alias("seq"), model.alias("v"))),
               "_s": F.struct(seq.alias("seq"), _status_value(et, F.col("new_status")).alias("v")),
               "_x": F.when(created | cancelled, F.struct(seq.alias("seq"), F.when(cancelled, F.col("reason")).alias("v"))),
               "_o": F.when(created | corr.isNotNull(), F.struct(seq.alias("seq"), corr.alias("v")))}
    rows = ev.select("order_id", F.col(at).cast(kind).alias("_at"), F.lit(0).alias("_kind"), *[c.alias(n) for n, c in setters.items()])
    if by == "time":
        rows = rows.where(F.col("_at").isNotNull())
    asked = requests.select("order_id", F.col("as_of").cast(kind).alias("_at"), F.lit(1).alias("_kind"), "request_id")
    merged = rows.unionByName(asked, allowMissingColumns=True)
    done = running_max(merged, ["order_id"], ["_at", "_kind", "request_id", "_s"], list(setters)).where(F.col("_kind") == 1)
    found = F.col("max__c").isNotNull()
    return done.select(
        "request_id", "order_id", F.col("_at").alias("as_of"), found.alias("found"),
        *[F.col(f"max__c.v.{c}").alias(c) for c in ("customer_id", "total_amount", "currency", "item_count", "shipping_address")],
        F.when(found, F.col("max__s.v")).alias("last_order_status"), F.when(found, F.col("max__x.v")).alias("cancellation_reason"),
        F.col("max__c.v.occurred_at").alias("created_at"), F.when(found, ts(now)).alias("projected_at"),
        F.when(found, F.col("max__o.v")).alias("last_correlation_id"))


def events_since(events: DataFrame, requests: DataFrame) -> DataFrame:
    """The events after a version, for each request (request_id, order_id, since); in the order of ``seq``."""
    asked = requests.select("request_id", F.col("order_id").alias("_order"), F.col("since").cast("bigint").alias("since"))
    return events.join(asked, F.col("order_id") == F.col("_order")).where(F.col("seq") > F.col("since")).drop("_order", "since")


def status_history(events: DataFrame) -> DataFrame:
    """Per order, each status change with the previous status and the
    whole seconds spent in the previous status (``lag`` over (order_id, seq)
    computed by the skew-proof neighbour join)."""
    from .ordering import with_neighbour
    ev = events.select("order_id", "seq", F.col("occurred_at").alias("changed_at"),
                       _status_value(F.col("event_type"), F.col("new_status")).alias("new_status"))
    h = with_neighbour(ev, ["order_id"], ["seq"], ["new_status", "changed_at"])
    return h.select("order_id", "seq", F.col("prev_new_status").alias("old_status"), "new_status",
                    "changed_at",
                    F.timestamp_diff("SECOND", F.col("prev_changed_at"), F.col("changed_at"))
                    .alias("seconds_in_old_status"))
