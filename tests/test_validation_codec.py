import uuid

from pyspark.sql import functions as F

from ledgerline.functions import codec as X
from ledgerline.operators import append as AP
from ledgerline.operators import quality as Q

from .conftest import NOW
from .helpers import log_rows

REQ = "customer_id string, total_amount double, currency string, item_count int, shipping_address string, user_id string"


def _violations(spark, **over):
    base = dict(customer_id="cust-123", total_amount=99.99, currency="USD", item_count=3,
                shipping_address="123 Main St", user_id="user-456")
    base.update(over)
    df = spark.createDataFrame([tuple(base.values())], REQ)
    return Q.validate_create_orders(df).first()


def test_valid_request_accepted(spark):
    r = _violations(spark)
    assert r.accepted and r.violations == ""


def test_each_rule_rejects(spark):
    assert "Customer ID is required" in _violations(spark, customer_id=" ").violations
    assert "Amount must be greater than 0" in _violations(spark, total_amount=0.0).violations
    assert "Must have at least 1 item" in _violations(spark, item_count=-3).violations
    assert "Currency must be 3 characters" in _violations(spark, currency="USDX").violations
    assert not _violations(spark, currency="USDX").accepted


def test_uuid5_matches_python(spark):
    got = spark.range(1).select(X.uuid_v5(F.lit("order-1:1")).alias("u")).first().u
    assert got == str(uuid.uuid5(uuid.NAMESPACE_DNS, "order-1:1"))


def test_exists_before_and_after_append(spark):
    log = log_rows(spark, [{"id": 1, "aggregate_id": "a", "event_type": "OrderCreated", "status": "FAILED"}])
    req = spark.createDataFrame([("a", "OrderCreated")], "aggregate_id string, event_type string")
    assert AP.event_exists(log, req).first().exists is False
    log2 = log_rows(spark, [{"id": 2, "aggregate_id": "a", "event_type": "OrderCreated", "status": "PENDING"}])
    assert AP.event_exists(log.unionByName(log2), req).first().exists is True


def test_enrichment_fills_missing(spark):
    df = spark.createDataFrame([(None, None, None, None, "system", "order-1", 1)],
                               "event_id string, occurred_at timestamp_ntz, correlation_id string, "
                               "schema_version string, triggered_by string, aggregate_id string, version int")
    r = X.enrich(df, NOW).first()
    assert r.event_id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "order-1:1"))
    assert r.correlation_id == r.event_id and r.schema_version == "1.0" and r.occurred_at is not None
    assert '"source":"order-service"' in r.metadata


def test_decode_rejects_malformed_and_bad_types(spark):
    df = spark.createDataFrame(
        [(1, "OrderCreated", '{"orderId":"o1","totalAmount":5.5,"itemCount":2}'),
         (2, "OrderCreated", '{"orderId":"o1","itemCount":"many"}'),
         (3, "OrderCreated", '{{'), (4, "Other", '{}')], "id long, event_type string, payload string")
    r = {x.id: x for x in X.decode(df).collect()}
    assert r[1].decoded_ok and r[1].order_created.itemCount == 2
    assert r[2].decode_error == "MALFORMED" and r[3].decode_error == "MALFORMED"
    assert r[4].decode_error == "UNKNOWN_TYPE"


def test_salted_key_bounded_and_deterministic(spark):
    df = spark.range(1000).select(F.lit(7).alias("tenant"), F.col("id"))
    k1 = df.select(X.salted_key(F.col("tenant"), F.col("id"), 16).alias("k"))
    assert k1.select("k").distinct().count() <= 16
    assert sorted(r.k for r in k1.collect()) == sorted(r.k for r in k1.collect())


def test_sensitive_scan_counts_and_masks(spark):
    df = spark.createDataFrame([(1, "mail bob@example.com and 123-45-6789, card 4111 1111 1111 1111")],
                               "doc_id long, text string")
    r = Q.sensitive_scan(df).first()
    assert (r.n_emails, r.n_ssn, r.n_cards) == (1, 1, 1) and r.masked_email == "b***@example.com"
