"""Event payload codec and scalar event functions.

Everything is a built-in Spark expression (JVM side, whole-stage codegen):
``to_json`` / ``from_json`` with declared schemas, ``sha1`` for name-based
ids, ``xxhash64`` for salting.  No Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from .time import ts

CORRUPT = "_corrupt"
DEFAULT_VERSION = "1.0"
SUPPORTED_VERSIONS = ("1", "1.0", "2", "2.0")

# RFC 4122 DNS namespace for name-based ids.
DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"

# Handler route per event type (X10) and topic per type.
ROUTES = {S.ORDER_CREATED: "order", S.PAYMENT_PROCESSED: "payment",
          S.INVENTORY_UPDATED: "inventory", S.USER_REGISTERED: "user"}
UNKNOWN_ROUTE = "unknown"
TOPICS = {S.ORDER_CREATED: "orders-topic", S.PAYMENT_PROCESSED: "payments-topic",
          S.INVENTORY_UPDATED: "inventory-topic", S.USER_REGISTERED: "users-topic"}

DECODED_FIELDS = {
    S.ORDER_CREATED: "order_created",
    S.PAYMENT_PROCESSED: "payment_processed",
    S.INVENTORY_UPDATED: "inventory_updated",
    S.USER_REGISTERED: "user_registered",
}


def uuid_v5(name: Column, namespace_hex: str = DNS_NAMESPACE_HEX) -> Column:
    """Deterministic (name-based, SHA-1) UUID version 5 as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
                            .bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def event_id_for(aggregate_id: Column, version: Column) -> Column:
    """Event id from aggregate and version (``<aggregate>:<version>``)."""
    return uuid_v5(F.concat_ws(":", aggregate_id, version.cast("string")))


def enrich(df: DataFrame, now, aggregate_col: str = "aggregate_id", version_col: str = "version",
           source: str = "order-service") -> DataFrame:
    """X03 + X04: fill a missing event id (deterministic, never ``uuid()`` which
    changes on a task retry), time, correlation id and schema version, and
    attach the metadata JSON."""
    eid = F.coalesce(F.col("event_id"), event_id_for(F.col(aggregate_col), F.col(version_col)))
    out = (df.withColumn("event_id", eid)
           .withColumn("occurred_at", F.coalesce(F.col("occurred_at"), ts(now)))
           .withColumn("correlation_id", F.coalesce(F.col("correlation_id"), F.col("event_id")))
           .withColumn("schema_version", F.coalesce(F.col("schema_version"), F.lit(DEFAULT_VERSION))))
    return out.withColumn("metadata", metadata_json(F.lit(source), F.col("triggered_by"),
                                                    F.col("correlation_id"), F.col("occurred_at")))


def metadata_json(source: Column, triggered_by: Column, trace_id: Column, at: Column) -> Column:
    """``{source, triggeredBy, traceId, timestamp}`` as JSON text."""
    return F.to_json(F.struct(source.alias("source"), triggered_by.alias("triggeredBy"),
                              trace_id.alias("traceId"),
                              F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")))


def serialise(*cols: Column) -> Column:
    """Payload serialisation (``to_json`` of a struct, nulls omitted)."""
    return F.to_json(F.struct(*cols))


def _schema_with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])


def decode(df: DataFrame, type_col: str = "event_type", payload_col: str = "payload") -> DataFrame:
    """Typed decode, one ``from_json`` per event type (PERMISSIVE, with a
    corrupt-record column), applied only to rows of that type.

    Adds one struct column per type (``order_created`` ...), ``decode_error``
    (``UNKNOWN_TYPE`` / ``MALFORMED`` / ``EMPTY`` or null) and ``decoded_ok``.
    A field with a wrong type sets the corrupt column too, so it is rejected.
    """
    et, body = F.col(type_col), F.col(payload_col)
    out = df
    corrupt = None
    for etype, name in DECODED_FIELDS.items():
        parsed = F.from_json(body, _schema_with_corrupt(S.PAYLOADS[etype]),
                             {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        out = out.withColumn(name, F.when(et == etype, parsed))
        c = F.col(f"{name}.{CORRUPT}")
        corrupt = c if corrupt is None else F.coalesce(corrupt, c)
    known = et.isin(list(DECODED_FIELDS))
    err = (F.when(body.isNull() | (F.trim(body) == ""), F.lit("EMPTY"))
           .when(~known | et.isNull(), F.lit("UNKNOWN_TYPE"))
           .when(corrupt.isNotNull(), F.lit("MALFORMED")))
    return out.withColumn("decode_error", err).withColumn("decoded_ok", err.isNull())


def schema_version_check(version: Column) -> Column:
    """Null when the payload version is supported (missing means 1.0),
    else ``UNSUPPORTED_VERSION``."""
    v = F.coalesce(version, F.lit(DEFAULT_VERSION))
    return F.when(~v.isin(list(SUPPORTED_VERSIONS)), F.lit("UNSUPPORTED_VERSION"))


def property_or(props: Column, key: str, default) -> Column:
    """Message property with a default (``eventType`` -> "Unknown")."""
    return F.coalesce(props.getItem(key), F.lit(default))


def int_property_or(props: Column, key: str, default: int = 0) -> Column:
    """Integer property with a default; unparsable text gives the default."""
    return F.coalesce(props.getItem(key).try_cast("int"), F.lit(default))


def route(event_type: Column) -> Column:
    """Handler route per type; anything else takes the acknowledged
    default branch."""
    out = None
    for etype, r in ROUTES.items():
        out = F.when(event_type == etype, F.lit(r)) if out is None else out.when(event_type == etype, F.lit(r))
    return out.otherwise(F.lit(UNKNOWN_ROUTE))


def topic(event_type: Column) -> Column:
    """Topic per event type (null when the type has no topic)."""
    out = None
    for etype, t in TOPICS.items():
        out = F.when(event_type == etype, F.lit(t)) if out is None else out.when(event_type == etype, F.lit(t))
    return out


def content_route(priority: Column, size: Column, size_limit: int = 1000) -> Column:
    """X11: HIGH priority -> sync; size above the limit -> batch; else async."""
    return (F.when(priority == "HIGH", F.lit("sync"))
            .when(size > size_limit, F.lit("batch")).otherwise(F.lit("async")))


def salted_key(tenant: Column, key: Column, buckets: int = 16) -> Column:
    """Composite key ``tenant-bucket`` spreading a hot tenant over buckets."""
    return F.concat_ws("-", tenant.cast("string"),
                       F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"))


def inventory_delta_ok(previous: Column, new: Column, change: Column) -> Column:
    """``new - previous == change`` (null when a field is missing)."""
    return (new - previous) == change


def typed_from_map(m: Column, fields: dict) -> list[Column]:
    """Event factory — typed columns read from a string map."""
    return [m.getItem(k).try_cast(t).alias(k) for k, t in fields.items()]
