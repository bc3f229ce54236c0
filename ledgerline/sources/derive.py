"""Deterministic derivations of the library's tables from the driver tables.

Every derivation is a narrow projection (no shuffle) unless it needs an
aggregate, so the derived tables scale with the inputs and partition exactly
like them.  The rules are stated once here and mirrored by the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.time import backoff_seconds, plus_seconds, ts

# The derivation rules for the test event log (driver events).
EVENT_TYPE_MAP = {"purchase": S.ORDER_CREATED, "click": S.PAYMENT_PROCESSED,
                  "view": S.INVENTORY_UPDATED, "signup": S.USER_REGISTERED}
UNKNOWN_EVENT_TYPE = "Mystery"
STUCK_TOUCH_TIME = "2024-01-30 23:58:00"
ERROR_TEXTS = ("timeout", "connection refused", "message too large")
CURRENCIES = ("USD", "EUR", "GBP")


def _case_map(col, mapping: dict, default) -> F.Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v)))
    return out.otherwise(F.lit(default))


def outbox_from_events(events: DataFrame) -> DataFrame:
    """The event log (``outbox``) derived from driver ``events``."""
    eid = F.col("event_id")
    m20 = eid % 20
    status = (F.when(m20 <= 1, S.PENDING).when(m20 == 2, S.PROCESSING)
              .when(m20 == 3, S.FAILED).when(m20 == 4, S.DEAD_LETTER)
              .otherwise(S.PUBLISHED))
    b = events.select(eid, "ts", "user_id", "props", F.col("event_type").alias("raw_type"),
                      status.alias("status"))
    retry = (F.when(F.col("status") == S.FAILED, F.floor(eid / 20).cast("bigint") % 5)
             .when(F.col("status") == S.DEAD_LETTER, 3).otherwise(0)).cast("int")
    c = b.withColumn("retry_count", retry)
    agg_id = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    published_at = F.when(F.col("status") == S.PUBLISHED,
                          plus_seconds(F.col("ts"), ((eid * 37) % 600).cast("int")))
    next_retry_at = F.when(F.col("status") == S.FAILED,
                           plus_seconds(F.col("ts"), backoff_seconds(F.col("retry_count"))))
    err = _case_map(eid % 3, {0: ERROR_TEXTS[0], 1: ERROR_TEXTS[1]}, ERROR_TEXTS[2])
    error_message = (F.when(F.col("status") == S.FAILED, err)
                     .when(F.col("status") == S.DEAD_LETTER,
                           F.concat(F.lit(S.MAX_RETRIES_PREFIX), err)))
    out = c.select(
        eid.alias("id"),
        agg_id.alias("aggregate_id"),
        F.lit("USER").alias("aggregate_type"),
        _case_map(F.col("raw_type"), EVENT_TYPE_MAP, UNKNOWN_EVENT_TYPE).alias("event_type"),
        F.col("props").alias("payload"),
        F.col("status"),
        F.col("retry_count"),
        error_message.alias("error_message"),
        F.when(eid % 97 != 0, agg_id).alias("partition_key"),
        F.floor(eid / 7).cast("bigint").alias("correlation_id"),
        F.lit(None).cast("string").alias("metadata"),
        F.col("ts").alias("created_at"),
        published_at.alias("published_at"),
        next_retry_at.alias("next_retry_at"),
        F.lit(0).cast("bigint").alias("version"),
    )
    updated_at = (F.when((F.col("status") == S.PROCESSING) & (F.col("id") % 3 == 0),
                         ts(STUCK_TOUCH_TIME))
                  .otherwise(F.coalesce("published_at", "created_at")))
    return out.withColumn("updated_at", updated_at).select(*S.EVENT_LOG.fieldNames())


def order_events_from_orders(orders: DataFrame) -> DataFrame:
    """Order lifecycle events (Created, StatusChanged, Cancelled, redelivered Created)."""
    key = F.col("o_orderkey")
    ev_id = lambda n: F.concat(key.cast("string"), F.lit(f"-{n}"))
    day = lambda n: plus_seconds(F.col("o_orderdate"), n * 86400)
    null_s = F.lit(None).cast("string")
    created = orders.where(key % 17 != 0).select(
        key.alias("order_id"), F.lit(1).alias("seq"), ev_id(1).alias("event_id"),
        F.lit(S.ORDER_CREATED).alias("event_type"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("total_amount"), F.lit("CREATED").alias("new_status"),
        null_s.alias("reason"), F.col("o_orderdate").alias("occurred_at"))
    shipped = orders.where(F.col("o_orderstatus").isin("F", "P")).select(
        key, F.lit(2), ev_id(2), F.lit(S.ORDER_STATUS_CHANGED), F.lit(None).cast("bigint"),
        F.lit(None).cast("double"), F.lit("SHIPPED"), null_s, day(1))
    cancelled = orders.where(key % 11 == 0).select(
        key, F.lit(3), ev_id(3), F.lit(S.ORDER_CANCELLED), F.lit(None).cast("bigint"),
        F.lit(None).cast("double"), F.lit("CANCELLED"), F.lit("changed mind"), day(2))
    redelivered = orders.where((key % 13 == 0) & (key % 17 != 0)).select(
        key, F.lit(4), ev_id(1), F.lit(S.ORDER_CREATED), F.col("o_custkey"),
        F.col("o_totalprice"), F.lit("CREATED"), null_s, F.col("o_orderdate"))
    return created.unionAll(shipped).unionAll(cancelled).unionAll(redelivered)


def currency_of(order_key) -> F.Column:
    """Deterministic currency per order key."""
    m = order_key % 3
    return F.when(m == 0, CURRENCIES[0]).when(m == 1, CURRENCIES[1]).otherwise(CURRENCIES[2])


def order_items(lineitem: DataFrame) -> DataFrame:
    """Item count and quantity per order (partial aggregation before the shuffle)."""
    return (lineitem.groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.count(F.lit(1)).cast("int").alias("item_count"),
                 F.sum("l_quantity").alias("quantity")))


def enrich_order_events(order_events: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Add currency, item count, address and a correlation id to order events.

    The item count comes from a per-order aggregate of ``lineitem`` (one row per
    order, so the join side is bounded by the number of orders and is
    shuffle-joined; AQE turns it into a broadcast when it is small).
    """
    items = order_items(lineitem).select("order_id", "item_count")
    created = F.col("event_type") == S.ORDER_CREATED
    return (order_events.join(items, "order_id", "left")
            .withColumn("currency", F.when(created, currency_of(F.col("order_id"))))
            .withColumn("item_count", F.when(created, F.coalesce("item_count", F.lit(0))))
            .withColumn("shipping_address",
                        F.when(created, F.concat(F.col("customer_id").cast("string"),
                                                 F.lit(" Test Lane"))))
            .withColumn("correlation_id",
                        F.when(F.col("seq") == 2,
                               F.concat(F.lit("corr-"), F.col("order_id").cast("string")))))


ORDER_STATUS_MAP = {"F": "SHIPPED", "O": "CREATED", "P": "PENDING"}


def orders_write_model(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The orders write model (A.2) from driver ``orders`` and ``lineitem``."""
    items = order_items(lineitem).select(F.col("order_id").alias("o_orderkey"), "item_count")
    key = F.col("o_orderkey")
    return (orders.join(items, "o_orderkey", "left").select(
        key.alias("id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("decimal(19,2)").alias("total_amount"),
        currency_of(key).alias("currency"),
        F.coalesce("item_count", F.lit(0)).cast("int").alias("item_count"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(" Test Lane")).alias("shipping_address"),
        _case_map(F.col("o_orderstatus"), ORDER_STATUS_MAP, "CREATED").alias("status"),
        F.when(key % 11 == 0, F.lit("changed mind")).alias("cancellation_reason"),
        F.col("o_orderdate").alias("created_at"),
        plus_seconds(F.col("o_orderdate"), 86400).alias("updated_at")))


def call_log(events: DataFrame) -> DataFrame:
    """Calls to downstream targets (W10-W12): one call per driver event."""
    return events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("target"), F.col("ts"),
        (F.col("value") > 100).alias("failed"),
        F.floor(F.col("value") * 20).cast("bigint").alias("dur_ms"))


def publish_outcomes(outbox: DataFrame) -> DataFrame:
    """Outcomes of one publish attempt per event row: ``(id, ok, error)``."""
    ok = F.col("id") % 10 != 0
    return outbox.select("id", ok.alias("ok"), F.when(~ok, F.lit("timeout")).alias("error"))


# Enumerations used when typed payloads are derived from events.
PAYMENT_METHODS = ("CARD", "PAYPAL", "BANK")
COUNTRIES = ("US", "DE", "GB", "FR")
REGISTRATION_SOURCES = ("WEB", "MOBILE", "API")


def _pick(col, values):
    m = F.pmod(col, F.lit(len(values)))
    out = F.when(m == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        out = out.when(m == i, F.lit(v))
    return out


def typed_events(events: DataFrame) -> DataFrame:
    """Typed JSON payloads (X05) for driver events, with message properties.

    ``payload`` is the serialised typed event; every 101st event carries a
    broken body, every 50th an unsupported schema version ``3`` and every 5th
    version ``2``.  Even ids carry message properties (``eventType``,
    ``retryCount``); odd ids carry none, as the publisher sends a bare body.
    """
    from ..functions.codec import serialise
    eid = F.col("event_id")
    k = F.from_json(F.col("props"), "k BIGINT")["k"]
    et = _case_map(F.col("event_type"), EVENT_TYPE_MAP, UNKNOWN_EVENT_TYPE)
    version = F.when(eid % 50 == 0, F.lit("3")).when(eid % 5 == 0, F.lit("2")).otherwise(F.lit("1.0"))
    user = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    common = [F.concat(F.lit("evt-"), eid.cast("string")).alias("eventId"), et.alias("eventType"),
              F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("occurredAt"), version.alias("version"),
              F.floor(eid / 7).cast("string").alias("correlationId")]
    currency = _pick(eid, CURRENCIES)
    order = serialise(*common, F.concat(F.lit("order-"), k.cast("string")).alias("orderId"),
                      user.alias("customerId"), F.col("value").alias("totalAmount"),
                      currency.alias("currency"), (F.pmod(k, F.lit(5)) + 1).cast("int").alias("itemCount"),
                      F.concat(F.col("user_id").cast("string"), F.lit(" Test Lane")).alias("shippingAddress"),
                      F.lit("CREATED").alias("orderStatus"))
    payment = serialise(*common, F.concat(F.lit("pay-"), eid.cast("string")).alias("paymentId"),
                        F.concat(F.lit("order-"), k.cast("string")).alias("orderId"), user.alias("customerId"),
                        F.col("value").alias("amount"), currency.alias("currency"),
                        _pick(eid, PAYMENT_METHODS).alias("paymentMethod"),
                        F.concat(F.lit("tx-"), eid.cast("string")).alias("transactionId"),
                        F.when(F.col("value") > 100, "FAILED").otherwise("SUCCESS").alias("paymentStatus"))
    change = F.when(eid % 50 == 0, -k + 1).otherwise(-k)
    inventory = serialise(*common, F.concat(F.lit("prod-"), k.cast("string")).alias("productId"),
                          F.concat(F.lit("SKU-"), k.cast("string")).alias("sku"),
                          F.lit(500).alias("previousQuantity"), (F.lit(500) - k).cast("int").alias("newQuantity"),
                          change.cast("int").alias("quantityChange"),
                          F.concat(F.lit("wh-"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")).alias("warehouseId"),
                          F.lit("SALE").alias("updateReason"))
    user_reg = serialise(*common, user.alias("userId"),
                         F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
                         F.concat(F.lit("First"), F.col("user_id").cast("string")).alias("firstName"),
                         F.concat(F.lit("Last"), F.col("user_id").cast("string")).alias("lastName"),
                         _pick(F.col("user_id"), COUNTRIES).alias("country"),
                         _pick(eid, REGISTRATION_SOURCES).alias("registrationSource"),
                         (eid % 2 == 0).alias("emailVerified"))
    payload = (F.when(eid % 101 == 0, F.concat(F.lit("{"), F.col("props")))
               .when(et == S.ORDER_CREATED, order).when(et == S.PAYMENT_PROCESSED, payment)
               .when(et == S.INVENTORY_UPDATED, inventory).when(et == S.USER_REGISTERED, user_reg)
               .otherwise(F.col("props")))
    props = F.when(eid % 2 == 0, F.create_map(F.lit("eventType"), et, F.lit("retryCount"),
                                              (eid % 4).cast("string")))
    return events.select(eid.alias("id"), F.col("ts"), et.alias("event_type"), payload.alias("payload"),
                         props.alias("properties"), F.col("user_id"))


# Saga step events.
SAGA_STEPS = {"OrderCreated": 0, "InventoryReserved": 1, "PaymentProcessed": 2, "OrderConfirmed": 3}
SAGA_FAILURES = ("InventoryReservationFailed", "PaymentFailed")


def saga_events(orders: DataFrame) -> DataFrame:
    """Choreographed saga steps per order: created; inventory reserved (fails
    every 7th order); payment processed one hour later (fails every 5th of
    the rest); confirmed for finished orders."""
    k, t0 = F.col("o_orderkey"), F.col("o_orderdate")
    at = lambda h: plus_seconds(t0, h * 3600)
    inv_ok, pay_ok = k % 7 != 0, k % 5 != 0
    created = orders.select(k.alias("order_id"), F.lit("OrderCreated").alias("event_type"), t0.alias("ts"))
    inventory = orders.select(k, F.when(inv_ok, F.lit("InventoryReserved"))
                              .otherwise(F.lit("InventoryReservationFailed")), at(1))
    payment = orders.where(inv_ok).select(k, F.when(pay_ok, F.lit("PaymentProcessed"))
                                          .otherwise(F.lit("PaymentFailed")), at(2))
    confirmed = orders.where(inv_ok & pay_ok & (F.col("o_orderstatus") == "F")).select(
        k, F.lit("OrderConfirmed"), at(3))
    return created.unionAll(inventory).unionAll(payment).unionAll(confirmed)


def saga_events_with_compensation(orders: DataFrame) -> DataFrame:
    """``saga_events`` plus the compensation steps of failed sagas, one hour apart: those of
    every third order are not complete, every 14th order fails as its first event
    (its Created is lost), and every 10th order's confirmation is delivered twice."""
    k, t0 = F.col("o_orderkey"), F.col("o_orderdate")
    at = lambda h: plus_seconds(t0, h * 3600)
    steps = saga_events(orders)
    lost = (F.col("order_id") % 14 == 0) & (F.col("event_type") == "OrderCreated")
    inv_failed, pay_failed, slow = k % 7 == 0, (k % 7 != 0) & (k % 5 == 0), k % 3 == 0
    release = orders.where(pay_failed).select(k, F.lit("InventoryReleased"), at(3))
    cancel = orders.where((inv_failed | pay_failed) & ~slow).select(k, F.lit("OrderCancelled"), at(4))
    twice = orders.where(~inv_failed & (k % 5 != 0) & (k % 10 == 1) & (F.col("o_orderstatus") == "F")).select(k, F.lit("OrderConfirmed"), at(5))
    return steps.where(~lost).unionAll(release).unionAll(cancel).unionAll(twice)


def versioned_payments(events: DataFrame) -> DataFrame:
    """Payment messages in several schema versions (id, version, payload): 1 has no payment
    method and says paid, 2 has one and says completed; every 50th is of a version that
    nobody knows, every 101st is broken, every 7th of version 2 leaves the method out."""
    eid = F.col("event_id")
    k = F.from_json(F.col("props"), "k BIGINT")["k"]
    version = F.when(eid % 50 == 0, "3").when(eid % 5 == 0, "2").otherwise("1.0")
    base = [F.concat(F.lit("pay-"), eid.cast("string")).alias("paymentId"), F.concat(F.lit("order-"), k.cast("string")).alias("orderId")]
    failed = F.col("value") > 100
    one = F.to_json(F.struct(*base, F.when(failed, "failed").otherwise("paid").alias("status")))
    two = F.to_json(F.struct(*base, F.when(failed, "failed").otherwise("completed").alias("status"),
                             F.when(eid % 7 != 0, _pick(eid, PAYMENT_METHODS)).alias("paymentMethod"), F.lit("x").alias("addedLater")))
    payload = F.when(eid % 101 == 0, F.concat(F.lit("{"), F.col("props"))).when(version == "1.0", one).otherwise(two)
    return events.where(F.col("event_type") == "click").select(eid.alias("id"), version.alias("version"), payload.alias("payload"))


FAILURE_REASONS = ("insufficient_funds", "card_expired", "fraud_suspected")


def payment_results(events: DataFrame) -> DataFrame:
    """Results of payments (id, amount, ok, failure_reason); every 10th failure has no reason."""
    eid, ok = F.col("event_id"), F.col("value") <= 100
    reason = F.when(~ok & (eid % 10 != 0), _pick(eid, FAILURE_REASONS))
    return events.where(F.col("event_type") == "click").select(eid.alias("id"), F.col("value").alias("amount"), ok.alias("ok"), reason.alias("failure_reason"))
