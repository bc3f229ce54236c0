"""Registered saga, stock, payment-status, matching, back-off schedule and
archive queries (R07, R08, R11, R12, J11 batch twin, X02, S13, S14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codec import decode
from ..functions.time import capped_backoff_ms
from ..operators import saga as SG
from ..operators.joins import interval_left_join
from ..operators.saga_machine import saga_machine
from ..sources import derive, sinks
from .catalog import Ctx, register
from .oracle import NOW_SQL, OUTBOX, SAGA_EVENTS, SAGA_FULL, SAGA_WALK, TYPED_SRC, with_

SAGA_NOW = "1998-01-01 00:00:00"

SAGA_FOLD = """, sf AS (SELECT order_id,
  max(CASE event_type WHEN 'OrderCreated' THEN 0 WHEN 'InventoryReserved' THEN 1
      WHEN 'PaymentProcessed' THEN 2 WHEN 'OrderConfirmed' THEN 3 END) AS reached,
  bool_or(event_type IN ('InventoryReservationFailed', 'PaymentFailed')) AS failed, max(ts) AS last_ts
  FROM saga_events GROUP BY order_id),
st AS (SELECT order_id, CASE WHEN failed THEN 'FAILED' ELSE CASE reached WHEN 0 THEN 'STARTED'
    WHEN 1 THEN 'INVENTORY_RESERVED' WHEN 2 THEN 'PAYMENT_PROCESSED' WHEN 3 THEN 'COMPLETED' END END AS state,
  CAST(reached AS INT) AS reached,
  CASE WHEN failed THEN CASE reached WHEN 2 THEN 'refund_payment,release_inventory,cancel_order'
    WHEN 1 THEN 'release_inventory,cancel_order' WHEN 0 THEN 'cancel_order' END END AS compensation,
  last_ts FROM sf)"""


@register("r07_saga_state", with_(SAGA_EVENTS).rstrip() + SAGA_FOLD + " SELECT * FROM st")
def r07(spark, sf_dir):
    """Saga state per order with compensations from the last reached step."""
    return SG.saga_state(derive.saga_events(Ctx(spark, sf_dir).t("orders")))


@register("r07_saga_machine", with_(SAGA_FULL).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + SAGA_WALK + "SELECT * FROM saga_end")
def r07m(spark, sf_dir):
    """The saga automaton with COMPENSATING, compensation progress and illegal events."""
    return saga_machine(derive.saga_events_with_compensation(Ctx(spark, sf_dir).t("orders")))


@register("r08_saga_timeouts", with_(SAGA_EVENTS).rstrip() + SAGA_FOLD + f"""
SELECT * FROM st WHERE state NOT IN ('COMPLETED', 'FAILED')
  AND last_ts < TIMESTAMP '{SAGA_NOW}' - INTERVAL 2 HOUR""")
def r08(spark, sf_dir):
    """Sagas stuck in a non-terminal step for over 2 hours (as of 1998-01-01)."""
    return SG.saga_timeouts(derive.saga_events(Ctx(spark, sf_dir).t("orders")), SAGA_NOW)


def _decoded(c: Ctx):
    return decode(derive.typed_events(c.t("events")))


@register("r11_stock_levels", with_(TYPED_SRC) + """
SELECT product_id, warehouse_id, CAST(arg_max(500 - k, ts) AS INT) AS quantity,
  CAST(arg_max(500 - k, ts) AS INT) < 420 AS low_stock FROM (
  SELECT 'prod-' || k AS product_id, 'wh-' || (user_id % 4) AS warehouse_id, k, ts, id FROM typed_src
  WHERE event_type = 'InventoryUpdated' AND NOT broken) GROUP BY 1, 2""")
def r11(spark, sf_dir):
    """Latest stock per (product, warehouse) and a low-stock flag (< 420)."""
    d = _decoded(Ctx(spark, sf_dir)).where(F.col("inventory_updated").isNotNull() & F.col("decoded_ok"))
    iu = F.col("inventory_updated")
    g = (d.groupBy(iu["productId"].alias("product_id"), iu["warehouseId"].alias("warehouse_id"))
         .agg(F.max_by(iu["newQuantity"], F.struct("ts", "id")).alias("quantity")))
    return g.withColumn("low_stock", F.col("quantity") < 420)


@register("r12_payment_order_status", with_(TYPED_SRC) + """
SELECT 'order-' || k AS order_id, arg_max(CASE WHEN value > 100 THEN 'PAYMENT_FAILED' ELSE 'PAID' END,
  (ts, id)) AS last_status, CAST(count(*) AS BIGINT) AS payments FROM typed_src
WHERE event_type = 'PaymentProcessed' AND NOT broken GROUP BY 1""")
def r12(spark, sf_dir):
    """Payment events turned into order status changes; latest per order."""
    d = _decoded(Ctx(spark, sf_dir)).where(F.col("payment_processed").isNotNull() & F.col("decoded_ok"))
    p = F.col("payment_processed")
    status = F.when(p["paymentStatus"] == "SUCCESS", "PAID").otherwise("PAYMENT_FAILED")
    return (d.groupBy(p["orderId"].alias("order_id"))
            .agg(F.max_by(status, F.struct("ts", "id")).alias("last_status"),
                 F.count(F.lit(1)).alias("payments")))


@register("j11_order_payment_match_batch", """
SELECT p.event_id AS id, c.event_id AS r_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
  ON p.user_id = c.user_id AND c.ts >= p.ts AND c.ts <= p.ts + INTERVAL 1 HOUR""")
def j11(spark, sf_dir):
    """J11 (batch twin): each purchase with the clicks of the same user within
    one hour after it (bucketed range join)."""
    e = Ctx(spark, sf_dir).t("events")
    p = e.where(F.col("event_type") == "purchase").select(F.col("event_id").alias("id"), "user_id", "ts")
    c = e.where(F.col("event_type") == "click").select(F.col("event_id").alias("id"), "user_id", "ts")
    return interval_left_join(p, c, "user_id", "ts", "ts", 0, 3600).select("id", "r_id")


@register("x02_backoff_schedules", with_(OUTBOX) + """
SELECT id, policy, attempt, delay_ms,
  CAST(sum(delay_ms) OVER (PARTITION BY id, policy ORDER BY attempt) AS BIGINT) AS cumulative_ms FROM (
  SELECT id, 'exponential' AS policy, a AS attempt, CAST(least(1000 * power(2, a), 30000) AS BIGINT) AS delay_ms
  FROM outbox, range(5) t(a) WHERE status = 'FAILED'
  UNION ALL SELECT id, 'fixed', a, CAST(5000 AS BIGINT) FROM outbox, range(3) t(a) WHERE status = 'FAILED'
  UNION ALL SELECT id, 'configured', a, CAST(least(1000 * power(2, a), 30000) AS BIGINT)
  FROM outbox, range(3) t(a) WHERE status = 'FAILED')""")
def x02(spark, sf_dir):
    """Retry schedules per failed row — exponential 1000 ms x 2^n (5 tries,
    cap 30 s), fixed 5000 ms (3 tries), configured (3 tries, cap 30 s)."""
    log = Ctx(spark, sf_dir).outbox.where(F.col("status") == "FAILED").select("id")
    policies = [("exponential", 5, capped_backoff_ms), ("fixed", 3, lambda a: F.lit(5000).cast("bigint")),
                ("configured", 3, capped_backoff_ms)]
    out = None
    for name, tries, fn in policies:
        sched = log.select("id", F.lit(name).alias("policy"),
                           F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tries - 1).cast("bigint"))).alias("attempt"))
        a = F.col("attempt")
        # cumulative delay in closed form over the bounded attempt list
        cum = F.aggregate(F.transform(F.sequence(F.lit(0), a.cast("int")), lambda i: fn(i)),
                          F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        sched = sched.select("id", "policy", "attempt", fn(a).alias("delay_ms"), cum.alias("cumulative_ms"))
        out = sched if out is None else out.unionByName(sched)
    return out


@register("s13_archive", with_(OUTBOX) + f"""
SELECT CAST(published_at AS DATE) AS dt, CAST(count(*) AS BIGINT) AS n FROM outbox
WHERE status = 'PUBLISHED' AND published_at < {NOW_SQL} - INTERVAL 7 DAY GROUP BY 1""")
def s13(spark, sf_dir):
    """Rows archived per day before retention deletes them."""
    c = Ctx(spark, sf_dir)
    return sinks.archive_rows(c.outbox, c.now).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


@register("s14_month_partitions", with_(OUTBOX) + """
SELECT strftime(created_at, '%Y-%m') AS ym, CAST(count(*) AS BIGINT) AS n FROM outbox
WHERE strftime(created_at, '%Y-%m') >= '2024-01' GROUP BY 1""")
def s14(spark, sf_dir):
    """Rows per month partition after dropping months before 2024-01."""
    c = Ctx(spark, sf_dir)
    kept = sinks.retain_months(sinks.with_month(c.outbox), "2024-01")
    return kept.groupBy("ym").agg(F.count(F.lit(1)).alias("n"))
