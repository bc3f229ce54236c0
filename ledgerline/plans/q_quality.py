"""Registered validation and data-quality queries (F08-F16, W03, W04, W07,
W13, J08, J10, J12, U01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import append as AP
from ..operators import quality as Q
from ..sources import derive
from .catalog import Ctx, register
from .oracle import ORDER_EVENTS, ORDER_ITEMS, ORDERS_MODEL, ORDERS_MODEL_BODY, OUTBOX, TYPED_SRC, with_
from .q_projection import RM_DEDUP


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


REQ_SQL = """, req AS (SELECT o.o_orderkey AS id,
  CASE WHEN o.o_orderkey % 29 = 0 THEN '' ELSE 'cust-' || o.o_custkey END AS customer_id,
  CASE WHEN o.o_orderkey % 19 = 0 THEN -o.o_totalprice ELSE o.o_totalprice END AS total_amount,
  CASE WHEN o.o_orderkey % 23 = 0 THEN 'USDX'
       ELSE CASE o.o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END END AS currency,
  CAST(coalesce(i.item_count, 0) AS INT) AS item_count, o.o_custkey || ' Test Lane' AS shipping_address,
  'user-' || o.o_custkey AS user_id
FROM orders o LEFT JOIN order_items i ON o.o_orderkey = i.order_id)"""


def order_requests(c: Ctx):
    """Create-order requests derived from orders (bad amount every 19th, bad
    currency every 23rd, blank customer every 29th order)."""
    o = c.t("orders")
    items = derive.order_items(c.t("lineitem")).select(F.col("order_id").alias("o_orderkey"), "item_count")
    k = F.col("o_orderkey")
    return o.join(items, "o_orderkey", "left").select(
        k.alias("id"),
        F.when(k % 29 == 0, F.lit("")).otherwise(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")))
        .alias("customer_id"),
        F.when(k % 19 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("total_amount"),
        F.when(k % 23 == 0, F.lit("USDX")).otherwise(derive.currency_of(k)).alias("currency"),
        F.coalesce(F.col("item_count"), F.lit(0)).cast("int").alias("item_count"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(" Test Lane")).alias("shipping_address"),
        F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user_id"))


def _viol_sql(rules):
    parts = ", ".join(f"CASE WHEN {cond} THEN '{msg}' END" for msg, cond in rules)
    return f"concat_ws(', ', {parts})"


F08_RULES = [
    ("Customer ID is required", "customer_id IS NULL OR trim(customer_id) = ''"),
    ("Total amount is required", "total_amount IS NULL"),
    ("Amount must be greater than 0", "coalesce(total_amount < 0.01, false)"),
    ("Currency is required", "currency IS NULL OR trim(currency) = ''"),
    ("Currency must be 3 characters", "currency IS NOT NULL AND length(currency) <> 3"),
    ("Item count is required", "item_count IS NULL"),
    ("Must have at least 1 item", "coalesce(item_count < 1, false)"),
    ("Shipping address is required", "shipping_address IS NULL OR trim(shipping_address) = ''"),
    ("Address too long", "coalesce(length(shipping_address) > 500, false)"),
    ("User ID is required", "user_id IS NULL OR trim(user_id) = ''"),
]


@register("f08_validate_create_orders", with_(ORDER_ITEMS).rstrip() + REQ_SQL + f"""
SELECT id, {_viol_sql(F08_RULES)} AS violations, {_viol_sql(F08_RULES)} = '' AS accepted FROM req""")
def f08(spark, sf_dir):
    """create-order request validation (all violated rules, in order)."""
    return Q.validate_create_orders(order_requests(Ctx(spark, sf_dir))).select("id", "violations", "accepted")


F09_RULES = [("Customer ID too long", "coalesce(length(customer_id) > 255, false)"),
             ("Amount too large", "coalesce(total_amount > 999999.99, false)"),
             ("Currency must be 3 upper-case letters", "coalesce(NOT regexp_full_match(currency, '^[A-Z]{3}$'), true)")]


@register("f09_validate_strict", with_(ORDER_ITEMS).rstrip() + REQ_SQL + f"""
SELECT id, {_viol_sql(F09_RULES)} AS violations FROM req""")
def f09(spark, sf_dir):
    """strict validation variant."""
    return Q.validate_strict(order_requests(Ctx(spark, sf_dir))).select("id", "violations")


@register("f10_validate_status_requests", with_(ORDER_EVENTS) + """
SELECT order_id, seq, concat_ws(', ',
  CASE WHEN seq = 2 AND (new_status IS NULL OR trim(new_status) = '') THEN 'Status is required' END,
  CASE WHEN seq = 3 AND (reason IS NULL OR trim(reason) = '') THEN 'Reason is required' END,
  CASE WHEN seq = 3 AND coalesce(length(reason) > 500, false) THEN 'Reason too long' END,
  CASE WHEN order_id % 31 = 0 THEN 'User ID is required' END) AS violations
FROM order_events WHERE seq IN (2, 3)""")
def f10(spark, sf_dir):
    """status-change and cancel requests (user blank for every 31st order)."""
    ev = Ctx(spark, sf_dir).order_events.where(F.col("seq").isin(2, 3))
    req = ev.select("order_id", "seq", F.when(F.col("seq") == 3, "cancel").otherwise("status").alias("kind"),
                    F.col("new_status").alias("status"), "reason",
                    F.when(F.col("order_id") % 31 == 0, F.lit(""))
                    .otherwise(F.concat(F.lit("user-"), F.col("order_id").cast("string"))).alias("user_id"))
    return Q.validate_status_requests(req).select("order_id", "seq", "violations")


@register("f11_order_response", with_(ORDERS_MODEL) + """
SELECT CAST(id AS VARCHAR) AS orderId, CAST(customer_id AS VARCHAR) AS customerId,
  CAST(total_amount AS DOUBLE) AS totalAmount, currency, item_count AS itemCount, status,
  CASE WHEN second(created_at) = 0 AND microsecond(created_at) = 0
       THEN strftime(created_at, '%Y-%m-%dT%H:%M') ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S') END AS createdAt
FROM orders_model""")
def f11(spark, sf_dir):
    """order response projection."""
    return Q.order_response(Ctx(spark, sf_dir).orders_model)


@register("f12_validation_chain", with_(TYPED_SRC) + """
SELECT id, CASE WHEN broken THEN 'MALFORMED'
  WHEN event_type = 'PaymentProcessed' AND NOT has_props THEN 'AUTH_REQUIRED' ELSE 'PROCESSED' END AS outcome
FROM typed_src""")
def f12(spark, sf_dir):
    """ordered validation chain; first failing rule reported."""
    t = derive.typed_events(Ctx(spark, sf_dir).t("events"))
    return Q.validation_chain(t).select("id", "outcome")


TENANT_SQL = """SELECT o.o_orderkey AS order_id, c.c_nationkey AS expected_tenant,
  CASE WHEN o.o_orderkey % 37 = 0 THEN NULL WHEN o.o_orderkey % 41 = 0 THEN (c.c_nationkey + 1) % 25
       ELSE c.c_nationkey END AS tenant FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""


@register("f13_tenant_isolation", f"""
SELECT order_id, tenant, expected_tenant,
  CASE WHEN tenant IS NULL THEN 'MISSING_TENANT' ELSE 'TENANT_MISMATCH' END AS violation
FROM ({TENANT_SQL}) WHERE tenant IS NULL OR tenant <> expected_tenant""")
def f13(spark, sf_dir):
    """tenant present and equal to the customer's tenant (nation)."""
    c = Ctx(spark, sf_dir)
    o = c.t("orders").join(c.t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    rows = o.select(k.alias("order_id"), F.col("c_nationkey").alias("expected_tenant"),
                    F.when(k % 37 == 0, F.lit(None).cast("int"))
                    .when(k % 41 == 0, (F.col("c_nationkey") + 1) % 25)
                    .otherwise(F.col("c_nationkey")).alias("tenant"))
    return Q.tenant_violations(rows, "tenant", "expected_tenant")


@register("f14_sensitive_scan", f"""
SELECT doc_id, n_emails, n_cards, n_ssn, masked_email FROM (
  SELECT doc_id, len(regexp_extract_all(text, '{Q.EMAIL_RE}')) AS n_emails,
    len(regexp_extract_all(text, '{Q.CARD_RE}')) AS n_cards,
    len(regexp_extract_all(text, '{Q.SSN_RE}')) AS n_ssn,
    CASE WHEN len(regexp_extract_all(text, '{Q.EMAIL_RE}')) > 0 THEN
      substr(regexp_extract_all(text, '{Q.EMAIL_RE}')[1], 1, 1) || '***@' ||
      split_part(regexp_extract_all(text, '{Q.EMAIL_RE}')[1], '@', -1) END AS masked_email
  FROM documents) WHERE n_emails + n_cards + n_ssn > 0""")
def f14(spark, sf_dir):
    """e-mail / card / SSN scan over whole document texts, with masking."""
    s = Q.sensitive_scan(Ctx(spark, sf_dir).t("documents"))
    return s.where(F.col("n_emails") + F.col("n_cards") + F.col("n_ssn") > 0)


@register("f15_injection_scan", f"""
SELECT doc_id, regexp_matches(text, {_lit(Q.SQL_INJECTION_RE)}) AS sql_injection,
  regexp_matches(text, {_lit(Q.SCRIPT_RE)}) AS script_tag FROM documents
WHERE regexp_matches(text, {_lit(Q.SQL_INJECTION_RE)}) OR regexp_matches(text, {_lit(Q.SCRIPT_RE)})""")
def f15(spark, sf_dir):
    """SQL-injection / script-tag flags over whole document texts."""
    s = Q.injection_scan(Ctx(spark, sf_dir).t("documents"))
    return s.where(F.col("sql_injection") | F.col("script_tag"))


@register("f16_sampling", """
SELECT event_id AS id, event_type AS target, value > 100 AS failed FROM events
WHERE value > 100 OR event_id % 100 < 1""")
def f16(spark, sf_dir):
    """F16: keep every failed call and 1 % of successful ones (deterministic)."""
    calls = Ctx(spark, sf_dir).call_log
    return Q.sample_hits(calls, "failed", 1).select("id", "target", "failed")


@register("w03_out_of_order", with_(OUTBOX) + """
SELECT id, event_type, created_at, prev_created_at FROM (
  SELECT id, event_type, created_at,
    lag(created_at) OVER (PARTITION BY event_type ORDER BY published_at, id) AS prev_created_at
  FROM outbox WHERE status = 'PUBLISHED') WHERE created_at < prev_created_at""")
def w03(spark, sf_dir):
    """Published events that arrived after a newer event of the same type."""
    log = Ctx(spark, sf_dir).outbox.where(F.col("status") == "PUBLISHED")
    r = Q.out_of_order(log.select("id", "event_type", "created_at", "published_at"), "event_type",
                       ["published_at", "id"], "created_at")
    return r.select("id", "event_type", "created_at", "prev_created_at")


@register("w04_sequence_gaps", with_(ORDER_EVENTS) + """
SELECT order_id, seq, next_seq FROM (SELECT order_id, seq, lead(seq) OVER (PARTITION BY order_id ORDER BY seq)
  AS next_seq FROM order_events) WHERE next_seq - seq > 1""")
def w04(spark, sf_dir):
    """Gaps in an order's event sequence."""
    return Q.sequence_gaps(Ctx(spark, sf_dir).order_events, "order_id", "seq")


@register("w07_append_chain", with_(ORDER_EVENTS) + """,
app AS (SELECT order_id, seq - 1 AS expected FROM order_events WHERE seq >= 2
  UNION ALL SELECT order_id, 3 FROM order_events WHERE seq = 1 AND order_id % 4 = 0
  UNION ALL SELECT order_id, 4 FROM order_events WHERE seq = 1 AND order_id % 8 = 0
  UNION ALL SELECT order_id, 0 FROM order_events WHERE seq = 2 AND order_id % 9 = 0),
head AS (SELECT order_id, max(seq) AS v FROM order_events WHERE seq <= 1 GROUP BY 1),
d AS (SELECT DISTINCT a.order_id, a.expected, coalesce(h.v, 0) AS v FROM app a LEFT JOIN head h ON a.order_id = h.order_id),
r AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY expected) - 1 AS n FROM d WHERE expected >= v)
SELECT d.order_id, CAST(d.expected AS BIGINT) AS expected_version, CAST(d.v AS BIGINT) AS current_version,
  coalesce(r.expected = r.v + r.n, false) AS accepted, CAST(coalesce(r.expected = r.v + r.n, false) AS BIGINT) AS accepted_rows
FROM d LEFT JOIN r ON r.order_id = d.order_id AND r.expected = d.expected""".replace(",\napp", "\n, app", 1))
def w07_chain(spark, sf_dir):
    """Batches of appends per order against the stored head (seq 1): the gapless run
    from the head is accepted, a gap rejects what comes after it.  Per expected version:
    accepted at all, and how many appends were (never more than one)."""
    ev = Ctx(spark, sf_dir).order_events
    cur = ev.where(F.col("seq") <= 1).select(F.col("order_id").alias("aggregate_id"), F.col("seq").cast("bigint").alias("version"))
    first = ev.where("seq = 1")
    app = (ev.where("seq >= 2").selectExpr("order_id", "seq - 1 AS expected")
           .unionByName(first.where("order_id % 4 = 0").selectExpr("order_id", "3 AS expected"))
           .unionByName(first.where("order_id % 8 = 0").selectExpr("order_id", "4 AS expected"))
           .unionByName(ev.where("seq = 2 AND order_id % 9 = 0").selectExpr("order_id", "0 AS expected")))
    app = app.selectExpr("order_id AS aggregate_id", "cast(expected AS bigint) AS expected_version")
    r = AP.append_chain(cur, app)
    return r.groupBy(F.col("aggregate_id").alias("order_id"), "expected_version", "current_version").agg(
        F.bool_or("accepted").alias("accepted"), F.count_if("accepted").alias("accepted_rows"))


@register("w07_version_check", with_(ORDER_EVENTS) + """
SELECT a.order_id, a.seq, CAST(coalesce(h.v, 0) AS BIGINT) AS current_version,
  a.seq - 1 = coalesce(h.v, 0) AS accepted
FROM (SELECT * FROM order_events WHERE seq >= 3) a
LEFT JOIN (SELECT order_id, max(seq) AS v FROM order_events WHERE seq <= 2 GROUP BY 1) h ON a.order_id = h.order_id""")
def w07(spark, sf_dir):
    """Optimistic version check of appends (expected = seq - 1) against
    the stored head (events up to seq 2)."""
    ev = Ctx(spark, sf_dir).order_events
    cur = ev.where(F.col("seq") <= 2).select(F.col("order_id").alias("aggregate_id"),
                                            F.col("seq").cast("bigint").alias("version"))
    app = ev.where(F.col("seq") >= 3).select(F.col("order_id").alias("aggregate_id"), "seq",
                                            (F.col("seq") - 1).cast("bigint").alias("expected_version"))
    r = AP.version_conflicts(cur, app)
    return r.select(F.col("aggregate_id").alias("order_id"), "seq", "current_version", "accepted")


@register("w13_uniqueness_conflicts", with_(TYPED_SRC) + """
SELECT id, email FROM (SELECT id, 'user' || user_id || '@example.com' AS email,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS rn
  FROM typed_src WHERE event_type = 'UserRegistered' AND NOT broken) WHERE rn > 1""")
def w13(spark, sf_dir):
    """Second and later registrations of one e-mail (first wins)."""
    from ..functions.codec import decode
    d = decode(derive.typed_events(Ctx(spark, sf_dir).t("events")))
    regs = (d.where(F.col("user_registered").isNotNull() & F.col("decoded_ok"))
            .select("id", "ts", F.col("user_registered.email").alias("email")))
    return AP.uniqueness_conflicts(regs, "email", ["ts", "id"]).select("id", "email")


@register("j08_api_composition", RM_DEDUP.rstrip() + "," + TYPED_SRC.strip() + """,
pay AS (SELECT 'order-' || k AS oid, CAST(count(*) AS BIGINT) AS payments,
  CAST(sum(CAST(value AS DECIMAL(19,2))) AS DOUBLE) AS paid FROM typed_src
  WHERE event_type = 'PaymentProcessed' AND NOT broken GROUP BY 1)
SELECT r.order_id, r.last_order_status, r.item_count, coalesce(p.payments, 0) AS payments, p.paid
FROM read_model r LEFT JOIN pay p ON p.oid = 'order-' || r.order_id""")
def j08(spark, sf_dir):
    """API composition — order view + payment summary (+ items) per order."""
    from ..functions.codec import decode
    from .q_projection import read_model
    c = Ctx(spark, sf_dir)
    d = decode(derive.typed_events(c.t("events")))
    pay = (d.where(F.col("payment_processed").isNotNull() & F.col("decoded_ok"))
           .groupBy(F.col("payment_processed.orderId").alias("oid"))
           .agg(F.count(F.lit(1)).alias("payments"),
                F.sum(F.col("payment_processed.amount").cast("decimal(19,2)")).cast("double").alias("paid")))
    rm = read_model(c).withColumn("oid", F.concat(F.lit("order-"), F.col("order_id").cast("string")))
    return (rm.join(pay, "oid", "left")
            .select("order_id", "last_order_status", "item_count",
                    F.coalesce(F.col("payments"), F.lit(0)).alias("payments"), "paid"))


@register("j10_orphaned_events", with_(ORDER_EVENTS) + """
SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM order_events e
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = e.order_id AND o.o_orderkey % 19 <> 0)
GROUP BY 1""")
def j10(spark, sf_dir):
    """Events whose aggregate was deleted (every 19th order deleted)."""
    c = Ctx(spark, sf_dir)
    live = c.t("orders").where(F.col("o_orderkey") % 19 != 0).select(F.col("o_orderkey").alias("order_id"))
    orphans = c.order_events.join(live, "order_id", "left_anti")
    return orphans.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


CAUSE_SQL = """ce AS (SELECT event_id, CASE WHEN min(seq) > 1 THEN min(order_id) || '-' || (min(seq) - 1) END
  AS causation_id FROM order_events GROUP BY event_id)"""


@register("j12_causation_chain", with_(ORDER_EVENTS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
          + ", " + CAUSE_SQL + """,
walk AS (SELECT event_id, event_id AS root_id, causation_id AS parent, 0 AS depth FROM ce
  UNION ALL SELECT w.event_id, p.event_id, p.causation_id, w.depth + 1
  FROM walk w JOIN ce p ON p.event_id = w.parent)
SELECT event_id, arg_max(root_id, depth) AS root_id, CAST(max(depth) AS INT) AS depth, false AS cycle
FROM walk GROUP BY event_id""")
def j12(spark, sf_dir):
    """Causation chains (each event of an order caused by the one before;
    first deliveries) resolved to their root."""
    ev = Ctx(spark, sf_dir).order_events.groupBy("event_id").agg(F.min("seq").alias("seq"), F.min("order_id").alias("order_id"))
    before = F.concat(F.col("order_id").cast("string"), F.lit("-"), (F.col("seq") - 1).cast("string"))
    return Q.causation_roots(ev.select("event_id", F.when(F.col("seq") > 1, before).alias("causation_id")))


@register("u01_reconcile_write_vs_read", RM_DEDUP.rstrip() + "," + ORDERS_MODEL_BODY.strip() + """
SELECT id AS order_id, 'only_left' AS side FROM (SELECT id FROM orders_model EXCEPT ALL SELECT order_id FROM read_model)
UNION ALL SELECT order_id, 'only_right' FROM (SELECT order_id FROM read_model EXCEPT ALL SELECT id FROM orders_model)""")
def u01(spark, sf_dir):
    """Orders in the write model but not the read model, and the reverse."""
    from .q_projection import read_model
    c = Ctx(spark, sf_dir)
    left = c.orders_model.select(F.col("id").alias("order_id"))
    return Q.reconcile(left, read_model(c), "order_id")
