"""Registered command queries (J04, J05) and their snapshots / event rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands as CMD
from .catalog import Ctx, register
from .oracle import ORDERS_MODEL, with_

OM = with_(ORDERS_MODEL)

STATUS_CMDS_SQL = """, cmds AS (
  SELECT o_orderkey AS order_id, 'SHIPPED' AS new_status, 'user-' || o_custkey AS user_id FROM orders
  WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey + 1000000000, 'SHIPPED', 'user-' || o_custkey FROM orders WHERE o_orderkey % 101 = 0)"""
CANCEL_CMDS_SQL = """, cmds AS (
  SELECT o_orderkey AS order_id, 'customer request' AS reason, 'user-' || o_custkey AS user_id FROM orders
  WHERE o_orderkey % 9 = 0
  UNION ALL SELECT o_orderkey + 1000000000, 'customer request', 'user-' || o_custkey FROM orders
  WHERE o_orderkey % 103 = 0)"""


def _status_cmds(c: Ctx):
    o = c.t("orders")
    user = F.concat(F.lit("user-"), F.col("o_custkey").cast("string"))
    known = o.where(F.col("o_orderkey") % 7 == 0).select(F.col("o_orderkey").alias("order_id"),
                                                         F.lit("SHIPPED").alias("new_status"), user.alias("user_id"))
    unknown = o.where(F.col("o_orderkey") % 101 == 0).select((F.col("o_orderkey") + 1_000_000_000).alias("order_id"),
                                                             F.lit("SHIPPED"), user)
    return known.unionAll(unknown)


def _cancel_cmds(c: Ctx):
    o = c.t("orders")
    user = F.concat(F.lit("user-"), F.col("o_custkey").cast("string"))
    known = o.where(F.col("o_orderkey") % 9 == 0).select(F.col("o_orderkey").alias("order_id"),
                                                         F.lit("customer request").alias("reason"),
                                                         user.alias("user_id"))
    unknown = o.where(F.col("o_orderkey") % 103 == 0).select(
        (F.col("o_orderkey") + 1_000_000_000).alias("order_id"), F.lit("customer request"), user)
    return known.unionAll(unknown)


@register("j04_status_commands", OM.rstrip() + STATUS_CMDS_SQL + """
SELECT c.order_id, CASE WHEN m.id IS NULL THEN 'ORDER_NOT_FOUND' ELSE 'ACCEPTED' END AS outcome,
  m.status AS old_status, c.new_status FROM cmds c LEFT JOIN orders_model m ON m.id = c.order_id""")
def j04(spark, sf_dir):
    """Status-change commands; unknown orders rejected with ORDER_NOT_FOUND."""
    c = Ctx(spark, sf_dir)
    r = CMD.apply_status_commands(c.orders_model, _status_cmds(c), c.now)
    return r["outcomes"].select("order_id", "outcome", "old_status", "new_status")


@register("j04_status_snapshot", OM.rstrip() + STATUS_CMDS_SQL + """
SELECT CASE WHEN c.order_id IS NULL THEN m.status ELSE c.new_status END AS status, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE c.order_id IS NOT NULL) AS BIGINT) AS changed
FROM orders_model m LEFT JOIN cmds c ON m.id = c.order_id GROUP BY 1""")
def j04b(spark, sf_dir):
    """The orders snapshot after the accepted commands, by status."""
    c = Ctx(spark, sf_dir)
    r = CMD.apply_status_commands(c.orders_model, _status_cmds(c), c.now)
    return (r["orders"].groupBy("status")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("updated_at") == F.lit(c.now).cast("timestamp_ntz"))
                 .alias("changed")))


@register("j05_cancel_commands", OM.rstrip() + CANCEL_CMDS_SQL + """
SELECT c.order_id, CASE WHEN m.id IS NULL THEN 'ORDER_NOT_FOUND'
  WHEN m.status IN ('CREATED', 'PENDING') THEN 'ACCEPTED' ELSE 'NOT_CANCELLABLE' END AS outcome,
  m.status AS old_status FROM cmds c LEFT JOIN orders_model m ON m.id = c.order_id""")
def j05(spark, sf_dir):
    """Cancel commands, allowed only from CREATED or PENDING."""
    c = Ctx(spark, sf_dir)
    r = CMD.apply_cancel_commands(c.orders_model, _cancel_cmds(c), c.now)
    return r["outcomes"].select("order_id", "outcome", "old_status")


@register("j05_cancel_events", OM.rstrip() + CANCEL_CMDS_SQL + """
SELECT 'order-' || c.order_id AS aggregate_id, 'OrderCancelled' AS event_type, m.status AS old_status
FROM cmds c JOIN orders_model m ON m.id = c.order_id WHERE m.status IN ('CREATED', 'PENDING')""")
def j05b(spark, sf_dir):
    """The OrderCancelled event rows emitted for accepted cancels."""
    c = Ctx(spark, sf_dir)
    r = CMD.apply_cancel_commands(c.orders_model, _cancel_cmds(c), c.now)
    return r["events"].select("aggregate_id", "event_type",
                              F.from_json("payload", "oldStatus STRING")["oldStatus"].alias("old_status"))
