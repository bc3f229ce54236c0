"""Registered queries that write with the library's sinks and read back with its readers
(S01-S03, S05, S07, S09, S11, S13, S14), and whole-table forms of F03, F07, X05, A10, A15,
A18, R12, W14 and X12."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import codec as X
from ..operators import append as AP
from ..operators import delivery as D
from ..operators import lifecycle as M
from ..operators import log_queries as L
from ..operators import metrics as MX
from ..operators import projection as P
from ..session import scratch_path
from ..sources import derive, log_store, sinks, tables
from .catalog import Ctx, register
from .oracle import NOW_SQL, ORDER_EVENTS, ORDERS_MODEL, OUTBOX, RICH_ORDER_EVENTS, TYPED_SRC, with_
from .q_log import LOG_COLS
from .q_projection import DEDUP_EV, RM_DEDUP, RM_SELECT, _fold_sql, _rm_out, read_model

OB, TS_ = with_(OUTBOX), with_(TYPED_SRC)


def _folder(c: Ctx, name: str) -> str:
    return scratch_path(c.spark, f"tables/{name}-{uuid.uuid4().hex[:12]}")


@register("s01_event_log_read", OB + f"SELECT {LOG_COLS} FROM outbox")
def s01_read(spark, sf_dir):
    """The event log written and read with its fixed schema."""
    c = Ctx(spark, sf_dir)
    path = _folder(c, "log")
    c.outbox.write.parquet(path)
    return tables.read_event_log(spark, path)


@register("s02_orders_read", with_(ORDERS_MODEL) + """
SELECT id, customer_id, CAST(total_amount AS DOUBLE) AS total_amount, currency, item_count,
  shipping_address, status, cancellation_reason, created_at, updated_at FROM orders_model""")
def s02_read(spark, sf_dir):
    """The orders write model written and read with its fixed schema."""
    c = Ctx(spark, sf_dir)
    path = _folder(c, "orders")
    c.orders_model.write.parquet(path)
    return tables.read_orders(spark, path).withColumn("total_amount", F.col("total_amount").cast("double"))


@register("s03_read_model_read", RM_DEDUP + RM_SELECT)
def s03_read(spark, sf_dir):
    """The read model written and read with its fixed schema."""
    c = Ctx(spark, sf_dir)
    path = _folder(c, "model")
    read_model(c).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.READ_MODEL.fields]).write.parquet(path)
    return _rm_out(tables.read_order_view(spark, path))


@register("s05_publish_files", OB + """
SELECT coalesce(partition_key, aggregate_id) AS delivery_key, id,
  row_number() OVER (PARTITION BY coalesce(partition_key, aggregate_id) ORDER BY created_at, id) AS pos
FROM outbox WHERE status='PENDING'""")
def s05_files(spark, sf_dir):
    """PENDING rows published to ordered files; the position of each row in its key, from
    where it lies in the files (file by file, row by row)."""
    c = Ctx(spark, sf_dir)
    rows = c.outbox.where(F.col("status") == "PENDING").select(D.delivery_key(c.outbox).alias("delivery_key"), "id", "created_at")
    path = _folder(c, "published")
    sinks.publish_files(rows, path, "delivery_key", 4)
    from ..operators.ordering import rank_within
    lying = spark.read.schema(rows.schema).parquet(path).select("delivery_key", "id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    return rank_within(lying, ["delivery_key"], ["file", "at"]).select("delivery_key", "id", "pos")


APPENDED = """,
app AS (SELECT event_id, order_id, event_type, occurred_at, customer_id, total_amount, seq FROM order_events)"""


@register("s07_append_all", with_(ORDER_EVENTS).rstrip() + APPENDED + """
SELECT event_id, 'order-' || order_id AS aggregate_id, event_type, 'PENDING' AS status, occurred_at AS created_at, order_id, customer_id,
  total_amount, 'order-service' AS source, true AS new_id FROM app""")
def s07_all(spark, sf_dir):
    """All order events appended to a stored log and read back as log rows; the
    payload is decoded again, ids go on after those of the log."""
    c = Ctx(spark, sf_dir)
    base, last = _append_orders(c)
    body = F.from_json("payload", "order_id BIGINT, customer_id BIGINT, total_amount DOUBLE, event_id STRING")
    meta = F.from_json("metadata", "source STRING, traceId STRING")
    rows = log_store.read_active(spark, base).where(F.col("aggregate_type") == "ORDER").withColumns({"b": body, "m": meta})
    return rows.select("b.event_id", "aggregate_id", "event_type", "status", "created_at", "b.order_id", "b.customer_id", "b.total_amount", "m.source",
                       ((F.col("id") > last) & F.isnull("published_at") & F.isnull("next_retry_at")).alias("new_id"))


@register("s07_append_then_poll", with_(ORDER_EVENTS).rstrip() + APPENDED + """
SELECT aggregate_id, event_type, created_at FROM (SELECT 'order-' || order_id AS aggregate_id, event_type, occurred_at AS created_at FROM app
ORDER BY occurred_at, event_id LIMIT 100)""")
def s07_poll(spark, sf_dir):
    """S07 then T01: what was appended is what the next poll takes (orders are older than the log)."""
    c = Ctx(spark, sf_dir)
    base, _ = _append_orders(c)
    return L.poll_batch(log_store.read_active(spark, base), c.now).select("aggregate_id", "event_type", "created_at")


def _append_orders(c: Ctx):
    """A stored log with all order events appended in two batches of different shapes; its last id before."""
    base = _folder(c, "append")
    log_store.create(c.outbox, base)
    last = c.outbox.agg(F.max("id")).first()[0] or 0
    ev = c.order_events
    own = ev.select(F.concat(F.lit("order-"), F.col("order_id").cast("string")).alias("aggregate_id"), F.lit("ORDER").alias("aggregate_type"), "event_type",
                    F.to_json(F.struct("order_id", "customer_id", "total_amount", "event_id")).alias("payload"), "event_id", F.col("occurred_at").alias("created_at"))
    kinds = [own.where(F.col("event_type") == S.ORDER_CREATED), own.where(F.col("event_type") != S.ORDER_CREATED).withColumn("correlation_id", F.col("event_id"))]
    log_store.append(AP.log_rows(AP.append_mixed(kinds, c.now), last), base)
    return base, last


@register("s09_dead_letter_round_trip", OB + f"""
SELECT payload, error_message AS error, coalesce(updated_at, {NOW_SQL}) AS failed_at FROM outbox WHERE status='DEAD_LETTER'""")
def s09_trip(spark, sf_dir):
    """Dead letters written in two batches, one of them twice (a retry), and read back."""
    c = Ctx(spark, sf_dir)
    path = _folder(c, "dead")
    rows = M.dead_letter_rows(c.outbox, c.now)
    for batch, part in ((0, "id % 2 = 0"), (1, "id % 2 <> 0"), (0, "id % 2 = 0")):
        sinks.write_dead_letters(rows.where(part), path, batch)
    return sinks.read_dead_letters(spark, path)


@register("s11_topic_round_trip", TS_ + """
SELECT id, event_type, CASE event_type WHEN 'OrderCreated' THEN 'orders-topic' WHEN 'PaymentProcessed' THEN 'payments-topic'
  WHEN 'InventoryUpdated' THEN 'inventory-topic' WHEN 'UserRegistered' THEN 'users-topic' ELSE 'none' END AS topic FROM typed_src""")
def s11_trip(spark, sf_dir):
    """Events written by topic and read back from the topic folders."""
    c = Ctx(spark, sf_dir)
    path = _folder(c, "topics")
    rows = derive.typed_events(c.t("events")).select("id", "event_type")
    sinks.write_topics(rows, path)
    return spark.read.schema("id bigint, event_type string, topic string").parquet(path).select("id", "event_type", "topic")


@register("s13_archive_round_trip", OB + f"""
SELECT id, CAST(published_at AS DATE) AS dt, payload FROM outbox WHERE status = 'PUBLISHED' AND published_at < {NOW_SQL} - INTERVAL 7 DAY""")
def s13_trip(spark, sf_dir):
    """Rows archived by day (twice, as after a failure) and read back."""
    c = Ctx(spark, sf_dir)
    path = _folder(c, "archive")
    sinks.archive(c.outbox, path, c.now)
    sinks.archive(c.outbox, path, c.now)
    return spark.read.parquet(path).select("id", "dt", "payload")


@register("s14_drop_months", OB + """
SELECT id, strftime(created_at, '%Y-%m') AS ym FROM outbox WHERE strftime(created_at, '%Y-%m') >= '2024-01'""")
def s14_trip(spark, sf_dir):
    """A table by month, with older months dropped, read back."""
    c = Ctx(spark, sf_dir)
    path = _folder(c, "months")
    sinks.write_partitioned(sinks.with_month(c.outbox), path, "ym")
    out = sinks.drop_month_partitions(spark, path, _folder(c, "months-kept"), 1, "2024-01")
    return spark.read.parquet(out).select("id", "ym")


@register("f03_traces", OB + """
SELECT correlation_id, id, row_number() OVER (PARTITION BY correlation_id ORDER BY created_at, id) AS pos FROM outbox WHERE correlation_id IS NOT NULL""")
def f03_all(spark, sf_dir):
    """the trace of every correlation id."""
    return L.traces(Ctx(spark, sf_dir).outbox).select("correlation_id", "id", "pos")


@register("a10_hot_delivery_keys", OB + """,
n AS (SELECT coalesce(partition_key, aggregate_id) AS key, count(*) AS n FROM outbox GROUP BY 1)
SELECT key, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER () AS BIGINT) AS total, round(n / sum(n) OVER (), 6) AS share,
  round(n / sum(n) OVER (), 6) >= 0.002 AS is_hot FROM n""")
def a10_keys(spark, sf_dir):
    """A10: share of rows per delivery key, hot at 0.2 %."""
    log = Ctx(spark, sf_dir).outbox
    return MX.key_shares(log, D.delivery_key(log), threshold=0.002)


@register("a15_duplicate_event_ids", with_(ORDER_EVENTS) + """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT event_id) AS BIGINT) AS distinct_keys,
  CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS duplicates, round((count(*) - count(DISTINCT event_id)) / count(*), 6) AS duplicate_rate FROM order_events""")
def a15_ids(spark, sf_dir):
    """Redelivered event ids."""
    return L.duplicate_rate(Ctx(spark, sf_dir).order_events, "event_id")


@register("a18_failures_by_reason", """
SELECT coalesce(reason, 'unknown') AS reason, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(19,2))) AS DOUBLE) AS amount FROM (
  SELECT value, CASE WHEN event_id % 10 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 'insufficient_funds' WHEN 1 THEN 'card_expired' ELSE 'fraud_suspected' END END AS reason
  FROM events WHERE event_type = 'click' AND value > 100) GROUP BY 1""")
def a18_reasons(spark, sf_dir):
    """Failed payments by reason."""
    return MX.failures_by_reason(derive.payment_results(Ctx(spark, sf_dir).t("events")))


PAY_EV = """,
pay AS (SELECT k AS order_id, 1000 + id AS seq, 'pay-' || id AS event_id, value <= 100 AS paid, ts AS occurred_at FROM typed_src
  WHERE event_type = 'PaymentProcessed' AND NOT broken),
ev0 AS (SELECT order_id, CAST(seq AS BIGINT) AS seq, event_id, event_type, customer_id, total_amount, new_status, reason, occurred_at, item_count, currency,
    shipping_address, correlation_id FROM rich_events
  UNION ALL SELECT order_id, seq, event_id, 'OrderStatusChanged', NULL, NULL, CASE WHEN paid THEN 'PAID' ELSE 'PAYMENT_FAILED' END, NULL, occurred_at, NULL, NULL, NULL, NULL FROM pay)"""


@register("r12_payments_projected", with_(RICH_ORDER_EVENTS).rstrip() + "," + TYPED_SRC.strip() + PAY_EV
          + _fold_sql(DEDUP_EV.replace("FROM rich_events", "FROM ev0")) + RM_SELECT)
def r12_projected(spark, sf_dir):
    """R12 into W01: decoded payments become status changes of their orders' read model."""
    c = Ctx(spark, sf_dir)
    d = X.decode(derive.typed_events(c.t("events"))).where(F.col("payment_processed").isNotNull() & F.col("decoded_ok"))
    p = F.col("payment_processed")
    pay = d.select(F.regexp_extract(p["orderId"], r"(\d+)$", 1).cast("bigint").alias("order_id"), (F.col("id") + 1000).alias("seq"), p["paymentId"].alias("event_id"),
                   (p["paymentStatus"] == "SUCCESS").alias("paid"), F.col("ts").alias("occurred_at"))
    ev = c.rich_events.select(*P.EVENT_COLS).withColumn("seq", F.col("seq").cast("bigint"))
    return _rm_out(P.project(ev.unionByName(P.payment_status_events(pay)), c.now))


CONFIRMED = """, ev1 AS (SELECT * REPLACE (CASE WHEN event_type = 'OrderStatusChanged' AND order_id % 2 = 0 THEN 'OrderConfirmed' ELSE event_type END AS event_type,
  CASE WHEN event_type = 'OrderStatusChanged' AND order_id % 2 = 0 THEN 'CONFIRMED' ELSE new_status END AS new_status) FROM rich_events)"""


@register("w14_confirmed", with_(RICH_ORDER_EVENTS).rstrip() + CONFIRMED + _fold_sql(DEDUP_EV.replace("FROM rich_events", "FROM ev1")) + """
SELECT m.order_id, m.last_order_status, c.confirmed_at FROM read_model m
LEFT JOIN (SELECT order_id, max(occurred_at) AS confirmed_at FROM ev WHERE event_type = 'OrderConfirmed' GROUP BY 1) c ON c.order_id = m.order_id""")
def w14_confirmed(spark, sf_dir):
    """Read model with confirmed orders and the time of their confirmation."""
    c = Ctx(spark, sf_dir)
    is_it = (F.col("event_type") == S.ORDER_STATUS_CHANGED) & (F.col("order_id") % 2 == 0)
    ev = c.rich_events.withColumn("event_type", F.when(is_it, F.lit("OrderConfirmed")).otherwise(F.col("event_type")))
    return P.project_confirmed(ev, c.now, {"OrderConfirmed": "CONFIRMED"}).select("order_id", "last_order_status", "confirmed_at")


COMMON = """'eventId', 'evt-' || id, 'eventType', event_type, 'occurredAt', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'version', version,
  'correlationId', CAST(floor(id/7) AS BIGINT)::VARCHAR"""


@register("x05_serialise_all_types", TS_ + f"""
SELECT id, CASE event_type
 WHEN 'OrderCreated' THEN json_object({COMMON}, 'orderId', 'order-' || k, 'customerId', 'user-' || user_id, 'totalAmount', value, 'currency', currency,
   'itemCount', CAST(k % 5 + 1 AS INT), 'shippingAddress', user_id || ' Test Lane', 'orderStatus', 'CREATED')
 WHEN 'PaymentProcessed' THEN json_object({COMMON}, 'paymentId', 'pay-' || id, 'orderId', 'order-' || k, 'customerId', 'user-' || user_id, 'amount', value,
   'currency', currency, 'paymentMethod', CASE id%3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'PAYPAL' ELSE 'BANK' END, 'transactionId', 'tx-' || id,
   'paymentStatus', CASE WHEN value > 100 THEN 'FAILED' ELSE 'SUCCESS' END)
 WHEN 'InventoryUpdated' THEN json_object({COMMON}, 'productId', 'prod-' || k, 'sku', 'SKU-' || k, 'previousQuantity', 500, 'newQuantity', CAST(500 - k AS INT),
   'quantityChange', CAST(CASE WHEN id % 50 = 0 THEN 1 - k ELSE -k END AS INT), 'warehouseId', 'wh-' || (user_id % 4), 'updateReason', 'SALE')
 ELSE json_object({COMMON}, 'userId', 'user-' || user_id, 'email', 'user' || user_id || '@example.com', 'firstName', 'First' || user_id, 'lastName', 'Last' || user_id,
   'country', CASE user_id%4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'GB' ELSE 'FR' END,
   'registrationSource', CASE id%3 WHEN 0 THEN 'WEB' WHEN 1 THEN 'MOBILE' ELSE 'API' END, 'emailVerified', id % 2 = 0) END::VARCHAR AS payload
FROM typed_src WHERE event_type <> 'Mystery' AND NOT broken""")
def x05_all(spark, sf_dir):
    """Serialised payloads of all four event types."""
    t = derive.typed_events(Ctx(spark, sf_dir).t("events"))
    return t.where((F.col("event_type") != derive.UNKNOWN_EVENT_TYPE) & (F.col("id") % 101 != 0)).select("id", "payload")


@register("x12_salted_spread", """
SELECT c.c_nationkey AS tenant, CAST(count(*) AS BIGINT) AS n, true AS named, true AS spread, true AS stable
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1""")
def x12_spread(spark, sf_dir):
    """Per tenant, every salted key names the tenant and one of 16 buckets, no bucket
    holds over a quarter of 100 rows or more, and a key gives the same bucket each time."""
    c = Ctx(spark, sf_dir)
    cust = c.t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("tenant"))
    rows = c.t("orders").select("o_orderkey", "o_custkey").join(cust, "o_custkey")
    both = rows.select("tenant", *[X.salted_key(F.col("tenant"), F.col("o_orderkey")).alias(k) for k in ("key", "again")])
    per = both.groupBy("tenant", "key").agg(F.count(F.lit(1)).alias("c"), F.bool_and(F.col("key") == F.col("again")).alias("same"))
    bucket = F.split("key", "-")
    fits = (bucket[0] == F.col("tenant").cast("string")) & bucket[1].cast("int").between(0, 15) & (F.size(bucket) == 2)
    return per.groupBy("tenant").agg(F.sum("c").alias("n"), F.bool_and(fits).alias("named"),
                                     ((F.sum("c") < 100) | (F.max("c") <= F.sum("c") / 4)).alias("spread"), F.bool_and("same").alias("stable"))
