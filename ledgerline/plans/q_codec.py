"""Registered codec, routing and append queries (X03-X12, X15, X16, S07, S08,
S11, U02, J01, J02, A24)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import codec as X
from ..functions.upcast import Versions
from ..operators import append as AP
from ..sources import derive
from .catalog import Ctx, register
from .oracle import ORDER_EVENTS, OUTBOX, TYPED_SRC, with_

TS_ = with_(TYPED_SRC)


def typed(c: Ctx):
    return derive.typed_events(c.t("events"))


def decoded(c: Ctx):
    return X.decode(typed(c))


@register("x05_serialise_payload", TS_ + """
SELECT id, json_object('eventId', 'evt-' || id, 'eventType', event_type,
  'occurredAt', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'version', version,
  'correlationId', CAST(floor(id/7) AS BIGINT)::VARCHAR,
  'paymentId', 'pay-' || id, 'orderId', 'order-' || k, 'customerId', 'user-' || user_id,
  'amount', value, 'currency', currency,
  'paymentMethod', CASE id%3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'PAYPAL' ELSE 'BANK' END,
  'transactionId', 'tx-' || id,
  'paymentStatus', CASE WHEN value > 100 THEN 'FAILED' ELSE 'SUCCESS' END)::VARCHAR AS payload
FROM typed_src WHERE event_type='PaymentProcessed' AND NOT broken""")
def x05(spark, sf_dir):
    """Serialised PaymentProcessed payloads (JSON text)."""
    t = typed(Ctx(spark, sf_dir))
    return (t.where((F.col("event_type") == S.PAYMENT_PROCESSED) & (F.col("id") % 101 != 0))
            .select("id", "payload"))


@register("x06_typed_decode", TS_ + """
SELECT id, event_type,
  CASE WHEN event_type NOT IN ('OrderCreated','PaymentProcessed','InventoryUpdated','UserRegistered')
       THEN 'UNKNOWN_TYPE' WHEN broken THEN 'MALFORMED' END AS decode_error,
  CASE WHEN NOT broken AND event_type IN ('OrderCreated','PaymentProcessed') THEN 'order-' || k END AS order_id,
  CASE WHEN NOT broken AND event_type IN ('OrderCreated','PaymentProcessed') THEN 'user-' || user_id END AS customer_id,
  CASE WHEN NOT broken AND event_type IN ('OrderCreated','PaymentProcessed') THEN value END AS amount,
  CASE WHEN NOT broken AND event_type='OrderCreated' THEN CAST(k % 5 + 1 AS INT) END AS item_count,
  CASE WHEN NOT broken AND event_type='InventoryUpdated' THEN 'prod-' || k END AS product_id,
  CASE WHEN NOT broken AND event_type='InventoryUpdated' THEN CAST(500 - k AS INT) END AS new_quantity,
  CASE WHEN NOT broken AND event_type='UserRegistered' THEN 'user' || user_id || '@example.com' END AS email,
  CASE WHEN NOT broken AND event_type='UserRegistered' THEN id % 2 = 0 END AS email_verified
FROM typed_src""")
def x06(spark, sf_dir):
    """Typed decode of the four event kinds; unknown or malformed -> rejected."""
    d = decoded(Ctx(spark, sf_dir))
    oc, pp, iu, ur = (F.col(n) for n in ("order_created", "payment_processed",
                                          "inventory_updated", "user_registered"))
    return d.select(
        "id", "event_type", "decode_error",
        F.coalesce(oc["orderId"], pp["orderId"]).alias("order_id"),
        F.coalesce(oc["customerId"], pp["customerId"]).alias("customer_id"),
        F.coalesce(oc["totalAmount"], pp["amount"]).alias("amount"),
        oc["itemCount"].alias("item_count"),
        iu["productId"].alias("product_id"), iu["newQuantity"].alias("new_quantity"),
        ur["email"].alias("email"), ur["emailVerified"].alias("email_verified"))


@register("x07_schema_version", TS_ + """
SELECT id, CASE WHEN broken OR event_type='Mystery' THEN NULL ELSE version END AS version,
  CASE WHEN NOT broken AND event_type<>'Mystery' AND version NOT IN ('1','1.0','2','2.0')
       THEN 'UNSUPPORTED_VERSION' END AS version_error
FROM typed_src""")
def x07(spark, sf_dir):
    """Schema version check (missing = 1.0; unsupported -> reject)."""
    d = decoded(Ctx(spark, sf_dir))
    v = F.coalesce(*[F.col(f"{n}.version") for n in X.DECODED_FIELDS.values()])
    return d.select("id", v.alias("version"), X.schema_version_check(v).alias("version_error"))


@register("x09_property_defaults", TS_ + """
SELECT id, CASE WHEN has_props THEN event_type ELSE 'Unknown' END AS prop_event_type,
  CASE WHEN has_props THEN CAST(id % 4 AS INT) ELSE 0 END AS prop_retry_count FROM typed_src""")
def x09(spark, sf_dir):
    """Message properties with defaults (eventType -> Unknown, retryCount -> 0)."""
    t = typed(Ctx(spark, sf_dir))
    return t.select("id", X.property_or(F.col("properties"), "eventType", "Unknown").alias("prop_event_type"),
                    X.int_property_or(F.col("properties"), "retryCount", 0).alias("prop_retry_count"))


ROUTE_SQL = """CASE {t} WHEN 'OrderCreated' THEN 'order' WHEN 'PaymentProcessed' THEN 'payment'
  WHEN 'InventoryUpdated' THEN 'inventory' WHEN 'UserRegistered' THEN 'user' ELSE 'unknown' END"""


@register("x10_route", TS_ + "SELECT id, " + ROUTE_SQL.format(t="""CASE WHEN has_props THEN event_type
  WHEN broken OR event_type='Mystery' THEN NULL ELSE event_type END""") + " AS route FROM typed_src")
def x10(spark, sf_dir):
    """Route on the eventType property when present, else on the
    payload's eventType; anything else takes the acknowledged default branch."""
    t = typed(Ctx(spark, sf_dir))
    body_type = F.from_json(F.col("payload"), "eventType STRING")["eventType"]
    return t.select("id", X.route(F.coalesce(F.col("properties")["eventType"], body_type)).alias("route"))


@register("s11_topic_routing", TS_ + """
SELECT CASE event_type WHEN 'OrderCreated' THEN 'orders-topic' WHEN 'PaymentProcessed' THEN 'payments-topic'
  WHEN 'InventoryUpdated' THEN 'inventory-topic' WHEN 'UserRegistered' THEN 'users-topic' END AS topic,
  CAST(count(*) AS BIGINT) AS n FROM typed_src GROUP BY 1""")
def s11(spark, sf_dir):
    """Events per destination topic (null = no route)."""
    t = typed(Ctx(spark, sf_dir))
    return t.groupBy(X.topic(F.col("event_type")).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


UUID5_SQL = """(SELECT substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' ||
  substr('89ab89ab89ab89ab', position(substr(h,17,1) IN '0123456789abcdef'), 1) || substr(h,18,3) || '-' ||
  substr(h,21,12) FROM (SELECT sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name})) AS h))"""


@register("x08_deterministic_id", "SELECT o_orderkey AS order_id, " + UUID5_SQL.format(
    name="'order-' || o_orderkey || ':1'") + " AS event_id FROM orders")
def x08(spark, sf_dir):
    """Name-based UUID v5 event id per (aggregate, version)."""
    o = Ctx(spark, sf_dir).t("orders")
    agg = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("order_id"), X.event_id_for(agg, F.lit(1)).alias("event_id"))


@register("x03_enrichment", with_(ORDER_EVENTS) + """
SELECT order_id, seq, coalesce(CASE WHEN seq=3 THEN NULL ELSE event_id END, """ + UUID5_SQL.format(
    name="'order-' || order_id || ':' || seq") + """) AS event_id,
  occurred_at, coalesce(CASE WHEN seq=2 THEN 'corr-' || order_id END,
    coalesce(CASE WHEN seq=3 THEN NULL ELSE event_id END, """ + UUID5_SQL.format(
    name="'order-' || order_id || ':' || seq") + """)) AS correlation_id,
  '1.0' AS schema_version,
  json_object('source', 'order-service', 'triggeredBy', 'system',
    'traceId', coalesce(CASE WHEN seq=2 THEN 'corr-' || order_id END,
      coalesce(CASE WHEN seq=3 THEN NULL ELSE event_id END, """ + UUID5_SQL.format(
    name="'order-' || order_id || ':' || seq") + """)),
    'timestamp', strftime(occurred_at, '%Y-%m-%dT%H:%M:%S'))::VARCHAR AS metadata
FROM order_events""")
def x03(spark, sf_dir):
    """X03 + X04: fill event id (name-based), correlation and version; add metadata JSON."""
    ev = Ctx(spark, sf_dir).order_events
    ev = ev.select(
        "order_id", "seq", F.when(F.col("seq") != 3, F.col("event_id")).alias("event_id"),
        "occurred_at",
        F.when(F.col("seq") == 2, F.concat(F.lit("corr-"), F.col("order_id").cast("string")))
        .alias("correlation_id"),
        F.lit(None).cast("string").alias("schema_version"),
        F.lit("system").alias("triggered_by"),
        F.concat(F.lit("order-"), F.col("order_id").cast("string")).alias("aggregate_id"),
        F.col("seq").alias("version"))
    out = X.enrich(ev, Ctx.now)
    return out.select("order_id", "seq", "event_id", "occurred_at", "correlation_id",
                      "schema_version", "metadata")


@register("x11_content_route", """
SELECT CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'sync'
  WHEN CAST(floor(o_totalprice / 100) AS BIGINT) > 1000 THEN 'batch' ELSE 'async' END AS strategy,
  CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def x11(spark, sf_dir):
    """X11: processing strategy per message (HIGH -> sync, large -> batch, else async);
    priority HIGH = urgent or high orders, size = total price / 100 (bytes)."""
    o = Ctx(spark, sf_dir).t("orders")
    prio = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH").otherwise("NORMAL")
    size = F.floor(F.col("o_totalprice") / 100).cast("bigint")
    return o.groupBy(X.content_route(prio, size).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


@register("x12_salted_key")
def x12(spark, sf_dir):
    """Salted composite key tenant-bucket (tenant = customer nation).
    xxhash64 has no DuckDB twin; checked by property tests."""
    c = Ctx(spark, sf_dir)
    o = c.t("orders").select("o_orderkey", "o_custkey")
    cust = c.t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return (o.join(cust, "o_custkey")
            .select("o_orderkey", F.col("c_nationkey").alias("tenant"),
                    X.salted_key(F.col("c_nationkey"), F.col("o_orderkey")).alias("salted_key")))


@register("x15_inventory_delta_check", TS_ + """
SELECT id, id % 50 <> 0 AS delta_ok FROM typed_src WHERE event_type='InventoryUpdated' AND NOT broken""")
def x15(spark, sf_dir):
    """Inventory delta consistency new - previous = change."""
    d = decoded(Ctx(spark, sf_dir)).where(F.col("inventory_updated").isNotNull() & F.col("decoded_ok"))
    iu = F.col("inventory_updated")
    return d.select("id", X.inventory_delta_ok(iu["previousQuantity"], iu["newQuantity"],
                                               iu["quantityChange"]).alias("delta_ok"))


@register("x16_event_factory", """
SELECT event_id, event_type, user_id, value FROM events""")
def x16(spark, sf_dir):
    """Typed columns read back from a string map (event factory)."""
    e = Ctx(spark, sf_dir).t("events")
    m = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"),
                     F.lit("value"), F.col("value").cast("string"))
    return e.select("event_id", *X.typed_from_map(m, {"event_type": "string", "user_id": "bigint",
                                                      "value": "double"}))


@register("a24_registrations", TS_ + """
SELECT CASE user_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'GB' ELSE 'FR' END AS country,
  CASE id % 3 WHEN 0 THEN 'WEB' WHEN 1 THEN 'MOBILE' ELSE 'API' END AS source,
  CAST(count(*) AS BIGINT) AS registrations,
  round(avg(CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS verified_share
FROM typed_src WHERE event_type='UserRegistered' AND NOT broken GROUP BY 1, 2""")
def a24(spark, sf_dir):
    """Registrations by country and source with verified share (decoded payloads)."""
    d = decoded(Ctx(spark, sf_dir)).where(F.col("user_registered").isNotNull() & F.col("decoded_ok"))
    u = F.col("user_registered")
    return (d.groupBy(u["country"].alias("country"), u["registrationSource"].alias("source"))
            .agg(F.count(F.lit(1)).alias("registrations"),
                 F.round(F.avg(u["emailVerified"].cast("int").cast("double")), 6).alias("verified_share")))


@register("s07_append_events", with_(ORDER_EVENTS) + """
SELECT 'order-' || order_id AS aggregate_id, 'ORDER' AS aggregate_type, event_type, 'PENDING' AS status,
  0 AS retry_count, 'order-' || order_id AS partition_key, occurred_at AS created_at, event_id
FROM order_events WHERE seq = 1""")
def s07(spark, sf_dir):
    """Append OrderCreated events to the log as PENDING rows."""
    ev = Ctx(spark, sf_dir).order_events.where(F.col("seq") == 1)
    src = ev.select(F.concat(F.lit("order-"), F.col("order_id").cast("string")).alias("aggregate_id"),
                    F.lit("ORDER").alias("aggregate_type"), "event_type",
                    F.to_json(F.struct("order_id", "customer_id", "total_amount")).alias("payload"),
                    "event_id", F.col("occurred_at").alias("created_at"))
    return AP.append_rows(src, Ctx.now).select("aggregate_id", "aggregate_type", "event_type", "status",
                                               "retry_count", "partition_key", "created_at", "event_id")


@register("u02_append_mixed_batch", with_(ORDER_EVENTS) + """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(reason) AS BIGINT) AS with_reason
FROM order_events GROUP BY 1""")
def u02(spark, sf_dir):
    """Typed batches of different shapes appended as one (unionByName)."""
    ev = Ctx(spark, sf_dir).order_events
    base = lambda t: ev.where(F.col("event_type") == t).select(
        F.concat(F.lit("order-"), F.col("order_id").cast("string")).alias("aggregate_id"),
        F.lit("ORDER").alias("aggregate_type"), "event_type", "event_id",
        F.col("occurred_at").alias("created_at"))
    created = base(S.ORDER_CREATED).withColumn("payload", F.lit("{}"))
    changed = base(S.ORDER_STATUS_CHANGED).withColumn("payload", F.lit("{}"))
    cancelled = (ev.where(F.col("event_type") == S.ORDER_CANCELLED).select(
        F.concat(F.lit("order-"), F.col("order_id").cast("string")).alias("aggregate_id"),
        F.lit("ORDER").alias("aggregate_type"), "event_type", "event_id",
        F.col("occurred_at").alias("created_at"), "reason").withColumn("payload", F.lit("{}")))
    rows = AP.append_mixed([created, changed, cancelled], Ctx.now, keep=["reason"])
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                          F.count("reason").alias("with_reason"))


@register("j01_event_exists", with_(OUTBOX) + """
SELECT r.aggregate_id, r.event_type, EXISTS (SELECT 1 FROM outbox o WHERE o.aggregate_id=r.aggregate_id
  AND o.event_type=r.event_type AND o.status IN ('PENDING','PUBLISHED')) AS "exists"
FROM (SELECT DISTINCT aggregate_id, event_type FROM outbox) r""")
def j01(spark, sf_dir):
    """eventExists(aggregate, type) for every pair seen in the log."""
    log = Ctx(spark, sf_dir).outbox
    req = log.select("aggregate_id", "event_type").distinct()
    return AP.event_exists(log, req)


@register("j02_append_unseen", with_(ORDER_EVENTS) + """
SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM order_events
WHERE event_id NOT IN (SELECT event_id FROM order_events WHERE seq <= 2) GROUP BY 1""")
def j02(spark, sf_dir):
    """Inbox — only events not yet processed (processed = seq 1 and 2)."""
    ev = Ctx(spark, sf_dir).order_events
    new = AP.unseen(ev, ev.where(F.col("seq") <= 2).select("event_id"))
    return new.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


#: Two versions of a payment message: the second has a method, and says completed for paid.
PAYMENT_VERSIONS = (
    Versions()
    .add("1", T.StructType([T.StructField("paymentId", T.StringType(), False), T.StructField("orderId", T.StringType()), T.StructField("status", T.StringType())]),
         aliases=("1.0",))
    .add("2", T.StructType([T.StructField("paymentId", T.StringType(), False), T.StructField("orderId", T.StringType()), T.StructField("status", T.StringType()),
                            T.StructField("paymentMethod", T.StringType())]),
         step=lambda f: {**f, "status": F.when(f["status"] == "paid", "completed").otherwise(f["status"])}, aliases=("2.0",),
         defaults={"paymentMethod": "unknown"}))


@register("x07_upcast", with_(TYPED_SRC) + """
SELECT id, CASE WHEN version = '3' THEN 'UNSUPPORTED_VERSION' WHEN broken THEN 'MALFORMED' END AS decode_error,
  CASE WHEN ok THEN 'pay-' || id END AS payment_id, CASE WHEN ok THEN 'order-' || k END AS order_id,
  CASE WHEN ok THEN CASE WHEN value > 100 THEN 'failed' ELSE 'completed' END END AS status,
  CASE WHEN ok THEN CASE WHEN version = '2' AND id % 7 <> 0 THEN CASE id % 3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'PAYPAL' ELSE 'BANK' END ELSE 'unknown' END END AS method
FROM (SELECT *, version <> '3' AND NOT broken AS ok FROM typed_src WHERE event_type = 'PaymentProcessed')""")
def x07_upcast(spark, sf_dir):
    """Messages of mixed versions decoded to the newest one by composed steps."""
    rows = PAYMENT_VERSIONS.decode(derive.versioned_payments(Ctx(spark, sf_dir).t("events")))
    e = F.col("event")
    return rows.select("id", "decode_error", e["paymentId"].alias("payment_id"), e["orderId"].alias("order_id"), e["status"].alias("status"), e["paymentMethod"].alias("method"))
