"""Declared schemas.  Nothing is inferred: every table the library writes or
reads back has a fixed ``StructType`` here."""

from __future__ import annotations

from pyspark.sql import types as T

# Delivery lifecycle states of an event row.
PENDING = "PENDING"
PROCESSING = "PROCESSING"
PUBLISHED = "PUBLISHED"
FAILED = "FAILED"
DEAD_LETTER = "DEAD_LETTER"
STATUSES = (PENDING, PROCESSING, PUBLISHED, FAILED, DEAD_LETTER)

# The four typed event kinds and the read-model event kinds.
ORDER_CREATED = "OrderCreated"
PAYMENT_PROCESSED = "PaymentProcessed"
INVENTORY_UPDATED = "InventoryUpdated"
USER_REGISTERED = "UserRegistered"
EVENT_TYPES = (ORDER_CREATED, PAYMENT_PROCESSED, INVENTORY_UPDATED, USER_REGISTERED)
ORDER_STATUS_CHANGED = "OrderStatusChanged"
ORDER_CANCELLED = "OrderCancelled"

# Delivery policy defaults.
MAX_RETRIES = 3
POLL_LIMIT = 100
STUCK_MINUTES = 5
RETENTION_DAYS = 7
MAX_BATCH_BYTES = 100 * 1024
STUCK_RECOVERED_MESSAGE = "Recovered from stuck PROCESSING state"
MAX_RETRIES_PREFIX = "Max retries exceeded: "

TS = T.TimestampNTZType()

EVENT_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("aggregate_id", T.StringType(), False),
    T.StructField("aggregate_type", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("payload", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("retry_count", T.IntegerType(), False),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("partition_key", T.StringType(), True),
    T.StructField("correlation_id", T.LongType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("created_at", TS, False),
    T.StructField("updated_at", TS, False),
    T.StructField("published_at", TS, True),
    T.StructField("next_retry_at", TS, True),
    T.StructField("version", T.LongType(), False),
])

ORDERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("total_amount", T.DecimalType(19, 2), False),
    T.StructField("currency", T.StringType(), False),
    T.StructField("item_count", T.IntegerType(), False),
    T.StructField("shipping_address", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("cancellation_reason", T.StringType(), True),
    T.StructField("created_at", TS, False),
    T.StructField("updated_at", TS, False),
])

ORDER_EVENTS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("event_id", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("total_amount", T.DoubleType(), True),
    T.StructField("new_status", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
    T.StructField("occurred_at", TS, True),
])

READ_MODEL = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("total_amount", T.DecimalType(19, 2), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("item_count", T.IntegerType(), True),
    T.StructField("shipping_address", T.StringType(), True),
    T.StructField("last_order_status", T.StringType(), True),
    T.StructField("cancellation_reason", T.StringType(), True),
    T.StructField("created_at", TS, True),
    T.StructField("projected_at", TS, True),
    T.StructField("last_correlation_id", T.StringType(), True),
])

DEAD_LETTERS = T.StructType([
    T.StructField("payload", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("failed_at", TS, True),
])

# Typed payload schemas (one per event kind).  Base fields first.
_BASE = [
    T.StructField("eventId", T.StringType()),
    T.StructField("eventType", T.StringType()),
    T.StructField("occurredAt", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("correlationId", T.StringType()),
    T.StructField("causationId", T.StringType()),
    T.StructField("triggeredBy", T.StringType()),
]

PAYLOADS = {
    ORDER_CREATED: T.StructType(_BASE + [
        T.StructField("orderId", T.StringType()),
        T.StructField("customerId", T.StringType()),
        T.StructField("totalAmount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("itemCount", T.IntegerType()),
        T.StructField("shippingAddress", T.StringType()),
        T.StructField("orderStatus", T.StringType()),
    ]),
    PAYMENT_PROCESSED: T.StructType(_BASE + [
        T.StructField("paymentId", T.StringType()),
        T.StructField("orderId", T.StringType()),
        T.StructField("customerId", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("paymentMethod", T.StringType()),
        T.StructField("transactionId", T.StringType()),
        T.StructField("paymentStatus", T.StringType()),
    ]),
    INVENTORY_UPDATED: T.StructType(_BASE + [
        T.StructField("productId", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("previousQuantity", T.IntegerType()),
        T.StructField("newQuantity", T.IntegerType()),
        T.StructField("quantityChange", T.IntegerType()),
        T.StructField("warehouseId", T.StringType()),
        T.StructField("updateReason", T.StringType()),
    ]),
    USER_REGISTERED: T.StructType(_BASE + [
        T.StructField("userId", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("firstName", T.StringType()),
        T.StructField("lastName", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("registrationSource", T.StringType()),
        T.StructField("emailVerified", T.BooleanType()),
    ]),
}

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")
