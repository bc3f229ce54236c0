"""R07 as an automaton: six states, compensation steps, illegal transitions (batch form).

STARTED -> INVENTORY_RESERVED -> PAYMENT_PROCESSED -> COMPLETED; a failed step puts the
saga into COMPENSATING, where refund, release and cancel follow from the last step that
was reached, in this order, and the last of them makes it FAILED.  An event that does
not fit its state is illegal: the state stays, and the event is counted.

Order matters, so the fold is not a maximum.  But an event is a map from states to
states, and maps compose associatively: rows are ranged by (key, time, tie-break), each
key's rows inside one range partition become one map (with the number of illegal events
from each start), and the maps of a key, one for each range partition it touches, are
applied one after the other.  A key that holds most rows is folded by as many tasks
as its rows fill.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.derive import SAGA_FAILURES
from .ordering import _numbered

# Compensation steps by the step that was reached, in their order.
COMPENSATIONS = {2: ("refund_payment", "release_inventory", "cancel_order"), 1: ("release_inventory", "cancel_order"), 0: ("cancel_order",)}
COMPENSATION_EVENTS = {"PaymentRefunded": "refund_payment", "InventoryReleased": "release_inventory", "OrderCancelled": "cancel_order"}
STEPS = ("STARTED", "INVENTORY_RESERVED", "PAYMENT_PROCESSED", "COMPLETED")
STEP_EVENTS = ("OrderCreated", "InventoryReserved", "PaymentProcessed", "OrderConfirmed")
STATES = (*STEPS, "COMPENSATING", "FAILED")

#: What the automaton knows: (state, step reached, compensation steps done); None before the first event.
NODES = [None, *[(s, k, 0) for k, s in enumerate(STEPS)],
         *[("COMPENSATING", r, d) for r, steps in COMPENSATIONS.items() for d in range(len(steps))],
         *[("FAILED", r, len(steps)) for r, steps in COMPENSATIONS.items()]]
START = 0


def next_node(node: tuple | None, event: str) -> tuple | None:
    """The node after ``event``, or None if the event does not fit."""
    if event in SAGA_FAILURES:
        # A failure as the first event: nothing but the order itself is to undo.
        reached = 0 if node is None else node[1]
        return ("COMPENSATING", reached, 0) if node is None or node[0] in STEPS[:3] else None
    if event in STEP_EVENTS:
        k = STEP_EVENTS.index(event)
        fits = node is None if k == 0 else node is not None and node[0] == STEPS[k - 1]
        return (STEPS[k], k, 0) if fits else None
    if event in COMPENSATION_EVENTS and node is not None and node[0] == "COMPENSATING":
        _, reached, done = node
        steps = COMPENSATIONS[reached]
        if steps[done] == COMPENSATION_EVENTS[event]:
            return ("COMPENSATING", reached, done + 1) if done + 1 < len(steps) else ("FAILED", reached, done + 1)
    return None


EVENTS = [*STEP_EVENTS, *SAGA_FAILURES, *COMPENSATION_EVENTS]
#: For each event, where it leads from each node; an event that does not fit leads nowhere else.
TABLE = [[NODES.index(n) if (n := next_node(node, e)) is not None else k for k, node in enumerate(NODES)] for e in EVENTS]
MISFIT = [[int(next_node(node, e) is None) for node in NODES] for e in EVENTS]
N = len(NODES)


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def _code(event_type: Column) -> Column:
    return reduce(lambda out, k: F.when(event_type == EVENTS[k], F.lit(k)).otherwise(out), range(len(EVENTS)), F.lit(None).cast("int"))


def _identity() -> Column:
    return F.struct(F.array(*[F.lit(k) for k in range(N)]).alias("to"), F.array(*[F.lit(0).cast("bigint") for _ in range(N)]).alias("bad"))


def _then(one: Column, two: Column) -> Column:
    """The map of ``one`` followed by ``two``."""
    to = F.transform(one["to"], lambda s: F.element_at(two["to"], s + 1))
    bad = F.transform(F.arrays_zip(one["to"], one["bad"]), lambda x: x["bad"] + F.element_at(two["bad"], x["to"] + 1))
    return F.struct(to.alias("to"), bad.alias("bad"))


def _event_map(code: Column) -> Column:
    """The map of one event, looked up in the table."""
    to = F.array(*[F.array(*[F.lit(x) for x in row]) for row in TABLE])
    bad = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in row]) for row in MISFIT])
    return F.struct(F.element_at(to, code + 1).alias("to"), F.element_at(bad, code + 1).alias("bad"))


def saga_machine(events: DataFrame, key: str = "order_id", ts_col: str = "ts", type_col: str = "event_type", tie_cols: list | None = None) -> DataFrame:
    """(key, state, reached, compensation, compensated, illegal, last_ts) per saga.

    ``compensation`` lists all steps that its failure asks for, ``compensated`` is how
    many are done.  Events of other types are left out.  Events of one time are in the
    order of ``tie_cols`` (by default the order of the steps, then failures, then
    compensations).  A saga of misfits only has a null state."""
    known = events.withColumn("_code", _code(F.col(type_col))).where(F.col("_code").isNotNull())
    order = [key, ts_col, *(tie_cols or []), "_code"]
    mid = _numbered(known.select(*dict.fromkeys(order)).repartitionByRange(*order).sortWithinPartitions(*order))
    # One map for each key and range partition, from at most a range partition of rows.
    inside = mid.groupBy(key, "_pid").agg(F.array_sort(F.collect_list(F.struct("_pos", "_code"))).alias("_rows"), F.max(ts_col).alias("_last"))
    maps = inside.select(key, "_pid", "_last", F.aggregate("_rows", _identity(), lambda m, r: _then(m, _event_map(r["_code"]))).alias("_map"))
    # One row for each range partition that a key touches.
    whole = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pid", "_map"))).alias("_maps"), F.max("_last").alias("last_ts"))
    start = F.struct(F.lit(START).alias("at"), F.lit(0).cast("bigint").alias("bad"))
    end = F.aggregate("_maps", start, lambda s, m: F.struct(
        F.element_at(m["_map"]["to"], s["at"] + 1).alias("at"), (s["bad"] + F.element_at(m["_map"]["bad"], s["at"] + 1)).alias("bad")))
    return whole.withColumn("_end", end).select(key, *describe(F.col("_end.at")), F.col("_end.bad").alias("illegal"), "last_ts")


def describe(at: Column) -> list[Column]:
    """State, step reached, compensation list and number of compensation steps done of a node."""
    lists = [None if n is None or n[0] in STEPS else ",".join(COMPENSATIONS[n[1]]) for n in NODES]
    return [_pick([n and n[0] for n in NODES], at).alias("state"), _pick([n and n[1] for n in NODES], at).cast("int").alias("reached"),
            _pick(lists, at).alias("compensation"), _pick([n and n[2] for n in NODES], at).cast("int").alias("compensated")]
