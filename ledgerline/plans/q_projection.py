"""Registered read-model queries (S02, S03, W01, W02, W05, W06, W14, J06, J07,
J09, M11, R09, F04, F05, F06, T04, A07, A08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.time import plus_seconds
from ..operators import projection as P
from ..operators import read_model as RM
from .catalog import Ctx, register
from .oracle import NOW_SQL, ORDERS_MODEL, ORDERS_MODEL_BODY, RICH_ORDER_EVENTS, with_

RE = with_(RICH_ORDER_EVENTS)

DEDUP_EV = """, ev AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY event_id ORDER BY seq) AS rn FROM rich_events) WHERE rn = 1)"""
ALL_EV = ", ev AS (SELECT * FROM rich_events)"


def _fold_sql(ev_cte: str, name: str = "read_model") -> str:
    """Oracle fold: keep events from the last Created on, then read each field."""
    return ev_cte + f""",
lc AS (SELECT order_id, max(seq) FILTER (WHERE event_type='OrderCreated') AS lcs FROM ev GROUP BY order_id),
tail AS (SELECT ev.* FROM ev JOIN lc ON ev.order_id=lc.order_id WHERE lc.lcs IS NOT NULL AND ev.seq >= lc.lcs),
fold AS (SELECT order_id,
  arg_max(CASE WHEN event_type='OrderCancelled' THEN 'CANCELLED' ELSE new_status END, seq) AS last_order_status,
  max(seq) FILTER (WHERE event_type='OrderCancelled') AS lcancel,
  max(seq) FILTER (WHERE event_type<>'OrderCreated' AND correlation_id IS NOT NULL) AS lcorr
  FROM tail GROUP BY order_id),
{name} AS (SELECT c.order_id, c.customer_id, CAST(c.total_amount AS DECIMAL(19,2)) AS total_amount,
  c.currency, CAST(c.item_count AS INT) AS item_count, c.shipping_address, f.last_order_status,
  r.reason AS cancellation_reason, c.occurred_at AS created_at, {NOW_SQL} AS projected_at,
  coalesce(k.correlation_id, c.correlation_id) AS last_correlation_id
FROM tail c JOIN lc ON c.order_id=lc.order_id AND c.seq=lc.lcs
JOIN fold f ON f.order_id=c.order_id
LEFT JOIN tail r ON r.order_id=c.order_id AND r.seq=f.lcancel
LEFT JOIN tail k ON k.order_id=c.order_id AND k.seq=f.lcorr)
"""


RM_DEDUP = RE.rstrip() + _fold_sql(DEDUP_EV)
RM_ALL = RE.rstrip() + _fold_sql(ALL_EV)

RM_SELECT = """SELECT order_id, customer_id, CAST(total_amount AS DOUBLE) AS total_amount, currency,
  item_count, shipping_address, last_order_status, cancellation_reason, created_at, projected_at,
  last_correlation_id FROM read_model"""


def _rm_out(df):
    return df.select(*[F.col(c).cast("double").alias(c) if c == "total_amount" else F.col(c)
                       for c in P.READ_MODEL_COLS])


def read_model(c: Ctx, mode: str = "dedup"):
    return P.project(c.rich_events, c.now, mode)


@register("w01_projection_dedup", RM_DEDUP + RM_SELECT)
def w01(spark, sf_dir):
    """Read-model projection, default mode (dedup by event id, then fold)."""
    return _rm_out(read_model(Ctx(spark, sf_dir)))


@register("w01_projection_as_delivered", RM_ALL + RM_SELECT)
def w01b(spark, sf_dir):
    """Projection replaying every delivery (redelivered Created overwrites)."""
    return _rm_out(read_model(Ctx(spark, sf_dir), "as_delivered"))


@register("s03_read_model_scan", RM_DEDUP + RM_SELECT)
def s03(spark, sf_dir):
    """The read model with its fixed schema."""
    df = read_model(Ctx(spark, sf_dir))
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.READ_MODEL.fields])
    return _rm_out(typed)


@register("s02_orders_scan", with_(ORDERS_MODEL) + """
SELECT id, customer_id, CAST(total_amount AS DOUBLE) AS total_amount, currency, item_count,
  shipping_address, status, cancellation_reason, created_at, updated_at FROM orders_model""")
def s02(spark, sf_dir):
    """The orders write model with its fixed schema."""
    df = Ctx(spark, sf_dir).orders_model
    return df.withColumn("total_amount", F.col("total_amount").cast("double"))


@register("w02_dedup_events", RE.rstrip() + DEDUP_EV + """
SELECT order_id, seq, event_id, event_type FROM ev""")
def w02(spark, sf_dir):
    """First delivery of every event id."""
    return P.dedup_events(Ctx(spark, sf_dir).order_events).select("order_id", "seq", "event_id", "event_type")


@register("j06_skipped_out_of_order", RE.rstrip() + """,
fc AS (SELECT order_id, min(seq) FILTER (WHERE event_type='OrderCreated') AS f FROM rich_events GROUP BY order_id)
SELECT e.order_id, e.seq, e.event_type FROM rich_events e JOIN fc ON e.order_id=fc.order_id
WHERE e.event_type<>'OrderCreated' AND (fc.f IS NULL OR e.seq < fc.f)""")
def j06(spark, sf_dir):
    """Status events with no row yet (skipped by the out-of-order guard)."""
    return P.skipped_events(Ctx(spark, sf_dir).order_events).select("order_id", "seq", "event_type")


@register("m11_upsert_snapshot", RM_DEDUP + RM_SELECT)
def m11(spark, sf_dir):
    """Snapshot of events up to seq 2, then the delta upserted with
    the already-applied ids as inbox; must equal the full projection."""
    c = Ctx(spark, sf_dir)
    ev = c.rich_events
    head = ev.where(F.col("seq") <= 2)
    snap = P.project(head, c.now, "dedup")
    delta = ev.where(F.col("seq") > 2)
    return _rm_out(P.upsert(snap, delta, c.now, seen_ids=head.select("event_id")))


@register("r09_rebuild_as_delivered", RM_ALL + RM_SELECT)
def r09(spark, sf_dir):
    """Snapshot (seq <= 1) + delta replay equals a full rebuild, as delivered."""
    c = Ctx(spark, sf_dir)
    ev = c.rich_events
    snap = P.project(ev.where(F.col("seq") <= 1), c.now, "as_delivered")
    return _rm_out(P.upsert(snap, ev.where(F.col("seq") > 1), c.now))


@register("w06_state_as_of_seq", RE.rstrip() + ", ev0 AS (SELECT * FROM rich_events WHERE seq <= 2)"
          + _fold_sql(DEDUP_EV.replace("FROM rich_events", "FROM ev0")) + RM_SELECT)
def w06(spark, sf_dir):
    """Read model as of sequence 2."""
    c = Ctx(spark, sf_dir)
    return _rm_out(P.state_as_of(c.rich_events, c.now, max_seq=2))


#: Requests: every third order as of a version, every fourth as of a time, some for an order that does not exist.
REQUESTS = """,
req AS (SELECT 'v' || o_orderkey AS request_id, o_orderkey + CASE WHEN o_orderkey % 99 = 0 THEN 100000000 ELSE 0 END AS order_id,
    1 + o_orderkey % 4 AS v, CAST(NULL AS TIMESTAMP) AS t FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 't' || o_orderkey, o_orderkey, NULL, o_orderdate + INTERVAL 1 HOUR * CAST(o_orderkey % 60 - 6 AS INT) FROM orders WHERE o_orderkey % 4 = 0)"""


def _requests(orders):
    k = F.col("o_orderkey")
    versions = orders.where(k % 3 == 0).select(
        F.concat(F.lit("v"), k).alias("request_id"), (k + F.when(k % 99 == 0, 100_000_000).otherwise(0)).alias("order_id"), (1 + k % 4).alias("as_of"))
    times = orders.where(k % 4 == 0).select(
        F.concat(F.lit("t"), k).alias("request_id"), k.alias("order_id"), plus_seconds(F.col("o_orderdate"), (k % 60 - 6).cast("int") * 3600).alias("as_of"))
    return versions, times


@register("w06_state_at_requests", RE.rstrip() + REQUESTS + """,
ev0 AS (SELECT e.* REPLACE (r.request_id AS order_id), e.order_id AS own FROM req r JOIN rich_events e
        ON e.order_id = r.order_id AND (e.seq <= r.v OR e.occurred_at <= r.t))"""
          + _fold_sql(DEDUP_EV.replace("FROM rich_events", "FROM ev0").replace("PARTITION BY event_id", "PARTITION BY order_id, event_id")) + """
SELECT q.request_id, q.order_id, m.order_id IS NOT NULL AS found, m.customer_id, CAST(m.total_amount AS DOUBLE) AS total_amount, m.currency,
  m.item_count, m.shipping_address, m.last_order_status, m.cancellation_reason, m.created_at, m.projected_at, m.last_correlation_id
FROM req q LEFT JOIN read_model m ON m.order_id = q.request_id""")
def w06_requests(spark, sf_dir):
    """The read model of each request's order as of a version or a time."""
    c = Ctx(spark, sf_dir)
    versions, times = _requests(c.t("orders"))
    ev = c.rich_events
    both = P.states_as_of(ev, versions, c.now, "version").drop("as_of").unionByName(P.states_as_of(ev, times, c.now, "time").drop("as_of"))
    return both.withColumn("total_amount", F.col("total_amount").cast("double"))


@register("w06_events_since", RE.rstrip() + REQUESTS + """
SELECT r.request_id, e.order_id, CAST(e.seq AS INT) AS seq, e.event_type FROM req r JOIN rich_events e ON e.order_id = r.order_id AND e.seq > r.v""")
def w06_since(spark, sf_dir):
    """Events since a version, per request."""
    c = Ctx(spark, sf_dir)
    versions, _ = _requests(c.t("orders"))
    found = P.events_since(c.order_events, versions.withColumnRenamed("as_of", "since"))
    return found.select("request_id", "order_id", F.col("seq").cast("int").alias("seq"), "event_type")


@register("w14_extended_projection", RE.rstrip() + ", ev1 AS (SELECT * REPLACE (CASE WHEN "
          "event_type='OrderStatusChanged' THEN 'OrderShipped' ELSE event_type END AS event_type, "
          "CASE WHEN event_type='OrderStatusChanged' THEN 'SHIPPED_CONFIRMED' ELSE new_status END AS new_status) "
          "FROM rich_events)" + _fold_sql(DEDUP_EV.replace("FROM rich_events", "FROM ev1")) + RM_SELECT)
def w14(spark, sf_dir):
    """Projection with an extra event kind (OrderShipped -> SHIPPED_CONFIRMED)."""
    c = Ctx(spark, sf_dir)
    ev = c.rich_events.withColumn(
        "event_type", F.when(F.col("event_type") == S.ORDER_STATUS_CHANGED, F.lit("OrderShipped"))
        .otherwise(F.col("event_type")))
    return _rm_out(P.project(ev, c.now, status_map={"OrderShipped": "SHIPPED_CONFIRMED"}))


@register("w05_status_history", RE.rstrip() + """
SELECT order_id, seq,
  lag(CASE WHEN event_type='OrderCancelled' THEN 'CANCELLED' ELSE new_status END)
    OVER (PARTITION BY order_id ORDER BY seq) AS old_status,
  CASE WHEN event_type='OrderCancelled' THEN 'CANCELLED' ELSE new_status END AS new_status,
  occurred_at AS changed_at,
  date_sub('second', lag(occurred_at) OVER (PARTITION BY order_id ORDER BY seq), occurred_at)
    AS seconds_in_old_status
FROM rich_events""")
def w05(spark, sf_dir):
    """Status history with previous status and time in it."""
    return P.status_history(Ctx(spark, sf_dir).order_events)


# -- queries over the read model ---------------------------------------------

@register("f05_find_orders_by_id", RM_DEDUP + """
SELECT o.o_orderkey AS order_id, r.order_id IS NOT NULL AS found, r.last_order_status
FROM orders o LEFT JOIN read_model r ON r.order_id = o.o_orderkey WHERE o.o_orderkey % 7 = 0""")
def f05(spark, sf_dir):
    """look up a batch of order ids (every 7th order key) with a found flag."""
    c = Ctx(spark, sf_dir)
    ids = c.t("orders").where(F.col("o_orderkey") % 7 == 0).select(F.col("o_orderkey").alias("order_id"))
    return RM.find_by_ids(read_model(c), ids)


@register("f06_by_last_status", RM_DEDUP + """
SELECT order_id, customer_id FROM read_model WHERE last_order_status='CANCELLED'""")
def f06(spark, sf_dir):
    """read-model rows with a given last status."""
    return RM.by_status(read_model(Ctx(spark, sf_dir)), "CANCELLED").select("order_id", "customer_id")


@register("t04_customer_orders_newest_first", RM_DEDUP + """
SELECT order_id, created_at FROM read_model
WHERE customer_id = (SELECT min(o_custkey) FROM orders) ORDER BY created_at DESC, order_id DESC""")
def t04(spark, sf_dir):
    """One customer's orders, newest first (the smallest customer key)."""
    c = Ctx(spark, sf_dir)
    cust = c.t("orders").agg(F.min("o_custkey").alias("customer_id"))
    rm = read_model(c).join(F.broadcast(cust), "customer_id", "left_semi")
    return RM.customer_orders(rm).select("order_id", "created_at")


@register("f04_orders_by_customer_and_status", with_(ORDERS_MODEL) + """
SELECT id, customer_id, status FROM orders_model
WHERE status = 'PENDING' OR customer_id = (SELECT min(o_custkey) FROM orders)""")
def f04(spark, sf_dir):
    """findByStatus and findByCustomerId on the write model."""
    c = Ctx(spark, sf_dir)
    om = c.orders_model
    cust = c.t("orders").agg(F.min("o_custkey").alias("_cust"))
    return (om.join(F.broadcast(cust), om["customer_id"] == cust["_cust"], "left")
            .where((F.col("status") == "PENDING") | F.col("_cust").isNotNull())
            .select("id", "customer_id", "status"))


@register("a07_count_by_status", RM_DEDUP + """
SELECT last_order_status, CAST(count(*) AS BIGINT) AS n FROM read_model GROUP BY 1""")
def a07(spark, sf_dir):
    """Read-model rows per status."""
    return RM.count_by_status(read_model(Ctx(spark, sf_dir)))


@register("a08_spend_per_customer", RM_DEDUP + """
SELECT customer_id, CAST(sum(total_amount) AS DOUBLE) AS total_spend FROM read_model GROUP BY 1""")
def a08(spark, sf_dir):
    """Total spend per customer (as coded: all currencies, all statuses)."""
    return RM.spend_per_customer(read_model(Ctx(spark, sf_dir)))


@register("a08_spend_by_currency_open", RM_DEDUP + """
SELECT customer_id, currency, CAST(sum(total_amount) AS DOUBLE) AS total_spend FROM read_model
WHERE last_order_status <> 'CANCELLED' GROUP BY 1, 2""")
def a08b(spark, sf_dir):
    """A08 options (B15): per currency, cancelled orders excluded."""
    return RM.spend_per_customer(read_model(Ctx(spark, sf_dir)), by_currency=True,
                                 exclude_status=["CANCELLED"])


@register("j07_drift_read_vs_write", RM_DEDUP.rstrip() + "," + ORDERS_MODEL_BODY.strip() + """
SELECT cls, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN r.order_id IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'extra'
    WHEN r.last_order_status IS DISTINCT FROM w.status OR r.total_amount IS DISTINCT FROM w.total_amount
      OR r.customer_id IS DISTINCT FROM w.customer_id THEN 'different' ELSE 'same' END AS cls
  FROM read_model r FULL OUTER JOIN orders_model w ON r.order_id = w.id) GROUP BY cls""")
def j07(spark, sf_dir):
    """Drift between read model and write model, by class."""
    c = Ctx(spark, sf_dir)
    return RM.drift(read_model(c), c.orders_model)


@register("j09_projection_lag", RM_DEDUP + """
SELECT round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95,
  round(quantile_cont(s, 0.99), 6) AS p99, CAST(count(*) AS BIGINT) AS n
FROM (SELECT date_sub('second', e.occurred_at, r.projected_at) AS s FROM rich_events e
      JOIN read_model r ON e.order_id = r.order_id WHERE e.event_type='OrderCreated')""")
def j09(spark, sf_dir):
    """End-to-end lag from event time to projection time (percentiles)."""
    c = Ctx(spark, sf_dir)
    return RM.projection_lag(c.rich_events, read_model(c))
