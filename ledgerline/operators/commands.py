"""Order commands applied to the write model.

A batch of commands is left-joined to the orders on the order id (a shuffle
join on a key that is unique on the orders side); each command is accepted or
rejected with a reason, accepted ones produce the next orders snapshot and
the event rows the reference never emitted (B16).  Commands for one order are
applied in turn: each is judged against the status that the one before left,
and an order is one row of the next snapshot however many commands it got.
Their order is that of ``order_cols`` (default: ``seq`` if there is such a
column, else all columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.time import ts
from .ordering import rank_within, with_neighbour

# Statuses from which a cancel is allowed.
CANCELLABLE = ("CREATED", "PENDING")


def _join(orders: DataFrame, commands: DataFrame) -> DataFrame:
    o = orders.select(F.col("id").alias("order_id"), F.col("status").alias("old_status"), F.lit(True).alias("_found"))
    return commands.join(o, "order_id", "left").withColumn("_found", F.coalesce("_found", F.lit(False)))


def _in_turn(joined: DataFrame, order_cols: list | None) -> tuple[DataFrame, list]:
    """Commands with ``_nth``, their place among the commands for their order."""
    cols = [c for c in joined.columns if not c.startswith("_") and c not in ("order_id", "old_status")]
    order = order_cols or (["seq"] if "seq" in cols else cols)
    return rank_within(joined, ["order_id"], order, "_nth"), order


def apply_status_commands(orders: DataFrame, commands: DataFrame, now, order_cols: list | None = None) -> dict:
    """``commands`` (order_id, new_status, user_id).  Returns
    ``outcomes`` (order_id, outcome, old_status, new_status), ``orders`` (next
    snapshot) and ``events`` (OrderStatusChanged rows for accepted commands).
    The old status of a later command is the new one of the command before."""
    turns, order = _in_turn(_join(orders, commands), order_cols)
    j = with_neighbour(turns, ["order_id"], ["_nth"], ["new_status"], prefix="_prev_")
    outcome = F.when(~F.col("_found"), F.lit("ORDER_NOT_FOUND")).otherwise(F.lit("ACCEPTED"))
    old = F.when(F.col("_found") & (F.col("_nth") > 1), F.col("_prev_new_status")).otherwise(F.col("old_status"))
    outcomes = j.select("order_id", outcome.alias("outcome"), old.alias("old_status"), "new_status", "user_id", "_nth")
    return _results(orders, outcomes, now, S.ORDER_STATUS_CHANGED)


def apply_cancel_commands(orders: DataFrame, commands: DataFrame, now, order_cols: list | None = None) -> dict:
    """``commands`` (order_id, reason, user_id); a cancel is allowed only
    from CREATED or PENDING.  Three outcomes: ACCEPTED, NOT_CANCELLABLE,
    ORDER_NOT_FOUND.  Once an order's first cancel is accepted, the others find
    it CANCELLED."""
    j, _ = _in_turn(_join(orders, commands), order_cols)
    open_ = F.coalesce(F.col("old_status").isin(list(CANCELLABLE)), F.lit(False))
    outcome = (F.when(~F.col("_found"), F.lit("ORDER_NOT_FOUND"))
               .when(open_ & (F.col("_nth") == 1), F.lit("ACCEPTED")).otherwise(F.lit("NOT_CANCELLABLE")))
    old = F.when(open_ & (F.col("_nth") > 1), F.lit("CANCELLED")).otherwise(F.col("old_status"))
    outcomes = j.select("order_id", outcome.alias("outcome"), old.alias("old_status"),
                        F.lit("CANCELLED").alias("new_status"), "reason", "user_id", "_nth")
    return _results(orders, outcomes, now, S.ORDER_CANCELLED)


def _results(orders: DataFrame, outcomes: DataFrame, now, event_type: str) -> dict:
    accepted = outcomes.where(F.col("outcome") == "ACCEPTED")
    has_reason = "reason" in outcomes.columns
    reason = F.col("reason") if has_reason else F.lit(None).cast("string")
    last = F.max_by(F.struct(F.col("new_status").alias("s"), reason.alias("r")), F.col("_nth"))
    changes = (accepted.groupBy(F.col("order_id").alias("id")).agg(last.alias("_l"))
               .select("id", F.col("_l.s").alias("_new"), F.col("_l.r").alias("_reason")))
    nxt = (orders.join(changes, "id", "left")
           .withColumn("status", F.coalesce("_new", "status"))
           .withColumn("cancellation_reason", F.when(F.col("_new").isNotNull() & F.lit(has_reason), F.col("_reason"))
                       .otherwise(F.col("cancellation_reason")))
           .withColumn("updated_at", F.when(F.col("_new").isNotNull(), ts(now)).otherwise(F.col("updated_at")))
           .drop("_new", "_reason"))
    events = accepted.select(
        F.concat(F.lit("order-"), F.col("order_id").cast("string")).alias("aggregate_id"),
        F.lit("ORDER").alias("aggregate_type"), F.lit(event_type).alias("event_type"),
        F.to_json(F.struct(F.col("order_id").cast("string").alias("orderId"),
                           F.col("old_status").alias("oldStatus"), F.col("new_status").alias("newStatus"),
                           F.col("user_id").alias("triggeredBy"), *([F.col("reason")] if has_reason else [])))
        .alias("payload"),
        ts(now).alias("created_at"))
    return {"outcomes": outcomes.drop("_nth"), "orders": nxt, "events": events}
