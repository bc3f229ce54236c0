"""Independent SQL (DuckDB dialect) for the derived tables.

Each oracle query is ``WITH <derived tables> SELECT ...`` over the driver
views.  These strings restate the derivation rules of ``sources.derive`` in
SQL; they are the second implementation the correctness gate compares with.
"""

from __future__ import annotations

NOW = "2024-01-31 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"

OUTBOX = """
ob_b AS (SELECT event_id, ts, user_id, value, props, event_type AS raw_type,
  CASE WHEN event_id%20<=1 THEN 'PENDING' WHEN event_id%20=2 THEN 'PROCESSING'
       WHEN event_id%20=3 THEN 'FAILED' WHEN event_id%20=4 THEN 'DEAD_LETTER'
       ELSE 'PUBLISHED' END AS status FROM events),
ob_c AS (SELECT ob_b.*, CASE status WHEN 'FAILED' THEN CAST(floor(event_id/20) AS BIGINT)%5
                              WHEN 'DEAD_LETTER' THEN 3 ELSE 0 END AS retry_count FROM ob_b),
ob_d AS (SELECT event_id AS id, concat('user-', CAST(user_id AS VARCHAR)) AS aggregate_id,
  'USER' AS aggregate_type,
  CASE raw_type WHEN 'purchase' THEN 'OrderCreated' WHEN 'click' THEN 'PaymentProcessed'
                WHEN 'view' THEN 'InventoryUpdated' WHEN 'signup' THEN 'UserRegistered'
                ELSE 'Mystery' END AS event_type,
  props AS payload, status, CAST(retry_count AS INT) AS retry_count,
  CASE status WHEN 'FAILED' THEN
         CASE event_id%3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connection refused' ELSE 'message too large' END
       WHEN 'DEAD_LETTER' THEN concat('Max retries exceeded: ',
         CASE event_id%3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connection refused' ELSE 'message too large' END)
  END AS error_message,
  CASE WHEN event_id%97=0 THEN NULL
       ELSE concat('user-', CAST(user_id AS VARCHAR)) END AS partition_key,
  CAST(floor(event_id/7) AS BIGINT) AS correlation_id,
  CAST(NULL AS VARCHAR) AS metadata,
  ts AS created_at,
  CASE WHEN status='PUBLISHED'
       THEN ts + INTERVAL 1 SECOND * CAST((event_id*37)%600 AS INT) END AS published_at,
  CASE WHEN status='FAILED'
       THEN ts + INTERVAL 1 SECOND * CAST(power(2,retry_count) AS INT) END AS next_retry_at,
  CAST(0 AS BIGINT) AS version
FROM ob_c),
outbox AS (SELECT id, aggregate_id, aggregate_type, event_type, payload, status, retry_count,
  error_message, partition_key, correlation_id, metadata, created_at,
  CASE WHEN status='PROCESSING' AND id%3=0 THEN TIMESTAMP '2024-01-30 23:58:00'
       ELSE coalesce(published_at, created_at) END AS updated_at,
  published_at, next_retry_at, version FROM ob_d)
"""

ORDER_EVENTS = """
order_events AS (
SELECT o_orderkey AS order_id, 1 AS seq, concat(CAST(o_orderkey AS VARCHAR),'-1') AS event_id,
  'OrderCreated' AS event_type, o_custkey AS customer_id, o_totalprice AS total_amount,
  'CREATED' AS new_status, CAST(NULL AS VARCHAR) AS reason, o_orderdate AS occurred_at
FROM orders WHERE o_orderkey%17<>0
UNION ALL SELECT o_orderkey, 2, concat(CAST(o_orderkey AS VARCHAR),'-2'), 'OrderStatusChanged',
  NULL, NULL, 'SHIPPED', NULL, o_orderdate + INTERVAL 1 DAY FROM orders WHERE o_orderstatus IN ('F','P')
UNION ALL SELECT o_orderkey, 3, concat(CAST(o_orderkey AS VARCHAR),'-3'), 'OrderCancelled',
  NULL, NULL, 'CANCELLED', 'changed mind', o_orderdate + INTERVAL 2 DAY FROM orders WHERE o_orderkey%11=0
UNION ALL SELECT o_orderkey, 4, concat(CAST(o_orderkey AS VARCHAR),'-1'), 'OrderCreated',
  o_custkey, o_totalprice, 'CREATED', NULL, o_orderdate FROM orders
  WHERE o_orderkey%13=0 AND o_orderkey%17<>0)
"""

ORDER_ITEMS = """
order_items AS (SELECT l_orderkey AS order_id, CAST(count(*) AS INT) AS item_count,
  sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey)
"""

RICH_ORDER_EVENTS = ORDER_EVENTS + "," + ORDER_ITEMS + """,
rich_events AS (SELECT e.order_id, e.seq, e.event_id, e.event_type, e.customer_id, e.total_amount,
  e.new_status, e.reason, e.occurred_at,
  CASE WHEN e.event_type='OrderCreated' THEN coalesce(i.item_count, 0) END AS item_count,
  CASE WHEN e.event_type='OrderCreated' THEN
    CASE e.order_id%3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END END AS currency,
  CASE WHEN e.event_type='OrderCreated' THEN concat(CAST(e.customer_id AS VARCHAR), ' Test Lane') END
    AS shipping_address,
  CASE WHEN e.seq=2 THEN concat('corr-', CAST(e.order_id AS VARCHAR)) END AS correlation_id
FROM order_events e LEFT JOIN order_items i ON e.order_id=i.order_id)
"""

ORDERS_MODEL_BODY = """
orders_model AS (SELECT o.o_orderkey AS id, o.o_custkey AS customer_id,
  CAST(o.o_totalprice AS DECIMAL(19,2)) AS total_amount,
  CASE o.o_orderkey%3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
  CAST(coalesce(i.item_count, 0) AS INT) AS item_count,
  concat(CAST(o.o_custkey AS VARCHAR), ' Test Lane') AS shipping_address,
  CASE o.o_orderstatus WHEN 'F' THEN 'SHIPPED' WHEN 'O' THEN 'CREATED' WHEN 'P' THEN 'PENDING'
       ELSE 'CREATED' END AS status,
  CASE WHEN o.o_orderkey%11=0 THEN 'changed mind' END AS cancellation_reason,
  o.o_orderdate AS created_at, o.o_orderdate + INTERVAL 1 DAY AS updated_at
FROM orders o LEFT JOIN order_items i ON o.o_orderkey=i.order_id)
"""
ORDERS_MODEL = ORDER_ITEMS + "," + ORDERS_MODEL_BODY

CALL_LOG = """
call_log AS (SELECT event_id AS id, event_type AS target, ts, value > 100 AS failed,
  CAST(floor(value*20) AS BIGINT) AS dur_ms FROM events)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"

# Source fields of the typed payloads (the oracle reads them directly, not
# through JSON, so decode is checked against the values that were encoded).
TYPED_SRC = """
typed_src AS (SELECT event_id AS id, ts, user_id, value,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CASE event_type WHEN 'purchase' THEN 'OrderCreated' WHEN 'click' THEN 'PaymentProcessed'
                  WHEN 'view' THEN 'InventoryUpdated' WHEN 'signup' THEN 'UserRegistered'
                  ELSE 'Mystery' END AS event_type,
  CASE WHEN event_id%50=0 THEN '3' WHEN event_id%5=0 THEN '2' ELSE '1.0' END AS version,
  event_id%101=0 AS broken,
  event_id%2=0 AS has_props,
  CASE event_id%3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency
FROM events)
"""

SAGA_EVENTS = """
saga_events AS (
SELECT o_orderkey AS order_id, 'OrderCreated' AS event_type, o_orderdate AS ts FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'InventoryReserved'
  ELSE 'InventoryReservationFailed' END, o_orderdate + INTERVAL 1 HOUR FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'PaymentProcessed' ELSE 'PaymentFailed' END,
  o_orderdate + INTERVAL 2 HOUR FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, 'OrderConfirmed', o_orderdate + INTERVAL 3 HOUR FROM orders
  WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderstatus = 'F')
"""

SAGA_FULL = SAGA_EVENTS.rstrip() + """,
saga_full AS (
SELECT * FROM saga_events WHERE NOT (order_id % 14 = 0 AND event_type = 'OrderCreated')
UNION ALL SELECT o_orderkey, 'InventoryReleased', o_orderdate + INTERVAL 3 HOUR FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'OrderCancelled', o_orderdate + INTERVAL 4 HOUR FROM orders
  WHERE (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0) AND o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 'OrderConfirmed', o_orderdate + INTERVAL 5 HOUR FROM orders
  WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 10 = 1 AND o_orderstatus = 'F')
"""

#: The automaton one event at a time: (order_id, n events, node as 'state:reached:done', illegal).
SAGA_WALK = """,
saga_rows AS (SELECT order_id, event_type, ts, row_number() OVER (PARTITION BY order_id ORDER BY ts) AS rn FROM saga_full),
saga_walk AS (
SELECT order_id, CAST(0 AS BIGINT) AS rn, 'NONE' AS state, 0 AS reached, 0 AS done, CAST(0 AS BIGINT) AS illegal
FROM (SELECT DISTINCT order_id FROM saga_rows)
UNION ALL
SELECT order_id, rn, coalesce(new_state, state), CASE WHEN new_state IS NULL THEN reached
    WHEN new_state = 'INVENTORY_RESERVED' THEN 1 WHEN new_state = 'PAYMENT_PROCESSED' THEN 2 WHEN new_state = 'COMPLETED' THEN 3 ELSE reached END,
  CASE WHEN e IN ('PaymentRefunded', 'InventoryReleased', 'OrderCancelled') AND new_state IS NOT NULL THEN done + 1 ELSE done END,
  illegal + CASE WHEN new_state IS NULL THEN 1 ELSE 0 END
FROM (SELECT w.order_id, r.rn, w.state, w.reached, w.done, w.illegal, r.event_type AS e,
  CASE WHEN r.event_type IN ('InventoryReservationFailed', 'PaymentFailed')
         THEN CASE WHEN w.state IN ('NONE', 'STARTED', 'INVENTORY_RESERVED', 'PAYMENT_PROCESSED') THEN 'COMPENSATING' END
       WHEN r.event_type = 'OrderCreated' THEN CASE WHEN w.state = 'NONE' THEN 'STARTED' END
       WHEN r.event_type = 'InventoryReserved' THEN CASE WHEN w.state = 'STARTED' THEN 'INVENTORY_RESERVED' END
       WHEN r.event_type = 'PaymentProcessed' THEN CASE WHEN w.state = 'INVENTORY_RESERVED' THEN 'PAYMENT_PROCESSED' END
       WHEN r.event_type = 'OrderConfirmed' THEN CASE WHEN w.state = 'PAYMENT_PROCESSED' THEN 'COMPLETED' END
       WHEN w.state = 'COMPENSATING' AND r.event_type = 'PaymentRefunded' AND w.reached = 2 AND w.done = 0 THEN 'COMPENSATING'
       WHEN w.state = 'COMPENSATING' AND r.event_type = 'InventoryReleased' AND w.done = w.reached - 1 THEN 'COMPENSATING'
       WHEN w.state = 'COMPENSATING' AND r.event_type = 'OrderCancelled' AND w.done = w.reached THEN 'FAILED' END AS new_state
  FROM saga_walk w JOIN saga_rows r ON r.order_id = w.order_id AND r.rn = w.rn + 1)),
saga_end AS (SELECT w.order_id, w.state, CAST(w.reached AS INT) AS reached,
  CASE WHEN w.state IN ('COMPENSATING', 'FAILED') THEN CASE w.reached WHEN 2 THEN 'refund_payment,release_inventory,cancel_order'
    WHEN 1 THEN 'release_inventory,cancel_order' ELSE 'cancel_order' END END AS compensation,
  CAST(w.done AS INT) AS compensated, w.illegal, l.last_ts
  FROM saga_walk w JOIN (SELECT order_id, max(rn) AS n, max(ts) AS last_ts FROM saga_rows GROUP BY 1) l ON l.order_id = w.order_id AND l.n = w.rn)
"""
