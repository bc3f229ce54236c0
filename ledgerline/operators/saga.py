"""Saga state per order (R07) and step time-outs (R08), batch form.

The fold is one grouped partial aggregate per order (furthest step reached,
any failure, last step time), so it needs no ordering window.  The streaming
form (``streaming.stateful``) keeps the same three values as keyed state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import cutoff
from ..sources.derive import SAGA_FAILURES, SAGA_STEPS

# Saga states by furthest step, and compensations by the last
# step actually reached (repairs the switch on COMPENSATING, B17).
STATE_BY_STEP = {0: "STARTED", 1: "INVENTORY_RESERVED", 2: "PAYMENT_PROCESSED", 3: "COMPLETED"}
COMPENSATION_BY_STEP = {2: "refund_payment,release_inventory,cancel_order",
                        1: "release_inventory,cancel_order",
                        0: "cancel_order"}
TERMINAL = ("COMPLETED", "FAILED")


def _step_rank(event_type):
    out = None
    for name, r in SAGA_STEPS.items():
        out = F.when(event_type == name, F.lit(r)) if out is None else out.when(event_type == name, F.lit(r))
    return out


def _by_step(step, mapping):
    out = None
    for r, v in mapping.items():
        out = F.when(step == r, F.lit(v)) if out is None else out.when(step == r, F.lit(v))
    return out


def saga_state(events: DataFrame) -> DataFrame:
    """Per order, state (STARTED ... COMPLETED, or FAILED after
    compensation), furthest step reached, compensation list, last step time."""
    g = events.groupBy("order_id").agg(
        F.coalesce(F.max(_step_rank(F.col("event_type"))), F.lit(0)).alias("reached"),  # a failure may come first
        F.bool_or(F.col("event_type").isin(list(SAGA_FAILURES))).alias("failed"),
        F.max("ts").alias("last_ts"))
    state = F.when(F.col("failed"), F.lit("FAILED")).otherwise(_by_step(F.col("reached"), STATE_BY_STEP))
    comp = F.when(F.col("failed"), _by_step(F.col("reached"), COMPENSATION_BY_STEP))
    return g.select("order_id", state.alias("state"), F.col("reached").cast("int").alias("reached"),
                    comp.alias("compensation"), "last_ts")


def saga_timeouts(events: DataFrame, now, limit_hours: int = 2) -> DataFrame:
    """Non-terminal sagas whose last step is older than ``limit_hours``
    before ``now`` (no next step arrived in time)."""
    s = saga_state(events)
    return s.where(~F.col("state").isin(list(TERMINAL)) & (F.col("last_ts") < cutoff(now, hours=limit_hours)))
