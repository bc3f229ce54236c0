"""Queries over the order read model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_by_ids(model: DataFrame, ids: DataFrame) -> DataFrame:
    """look up many order ids at once; ``found`` is false for unknown ids
    (the batch form of ``getOrderById`` raising on a miss)."""
    hit = model.select("order_id", "last_order_status").withColumn("_hit", F.lit(True))
    return (ids.select("order_id").join(hit, "order_id", "left")
            .select("order_id", F.coalesce(F.col("_hit"), F.lit(False)).alias("found"),
                    "last_order_status"))


def by_status(model: DataFrame, status: str) -> DataFrame:
    """rows whose last status is ``status``."""
    return model.where(F.col("last_order_status") == status)


def customer_orders(model: DataFrame) -> DataFrame:
    """Orders newest first (ties by order id, descending)."""
    return model.orderBy(F.col("created_at").desc(), F.col("order_id").desc())


def count_by_status(model: DataFrame) -> DataFrame:
    """Rows per last status."""
    return model.groupBy("last_order_status").agg(F.count(F.lit(1)).alias("n"))


def spend_per_customer(model: DataFrame, by_currency: bool = False,
                       exclude_status: list | None = None) -> DataFrame:
    """Total spend per customer, summed as decimal(19,2) (exact), returned as double.

    Defaults follow the reference (all currencies and statuses mixed, B15).
    """
    df = model
    if exclude_status:
        df = df.where(~F.col("last_order_status").isin(list(exclude_status)))
    keys = ["customer_id", "currency"] if by_currency else ["customer_id"]
    return df.groupBy(*keys).agg(
        F.sum(F.col("total_amount").cast("decimal(19,2)")).cast("double").alias("total_spend"))


def drift(model: DataFrame, write_model: DataFrame) -> DataFrame:
    """Compare read model with write model; classes missing / extra /
    different / same, counted.  Null-safe comparison per column."""
    r = model.select("order_id", "last_order_status", "total_amount", "customer_id")
    w = write_model.select(F.col("id").alias("_wid"), F.col("status").alias("_wst"),
                           F.col("total_amount").alias("_wamt"), F.col("customer_id").alias("_wcust"))
    j = r.join(w, r["order_id"] == w["_wid"], "full_outer")
    cls = (F.when(F.col("order_id").isNull(), "missing").when(F.col("_wid").isNull(), "extra")
           .when(~(F.col("last_order_status").eqNullSafe(F.col("_wst"))
                   & F.col("total_amount").eqNullSafe(F.col("_wamt"))
                   & F.col("customer_id").eqNullSafe(F.col("_wcust"))), "different")
           .otherwise("same"))
    return j.groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def projection_lag(events: DataFrame, model: DataFrame) -> DataFrame:
    """Seconds from a Created event to its projection; exact percentiles
    from the distributed rank (no single buffer of all values)."""
    created = events.where(F.col("event_type") == "OrderCreated").select("order_id", "occurred_at")
    s = (created.join(model.select("order_id", "projected_at"), "order_id")
         .select(F.timestamp_diff("SECOND", F.col("occurred_at"), F.col("projected_at")).alias("s")))
    from .ordering import exact_quantiles
    q = exact_quantiles(s, "s", [0.5, 0.95, 0.99], with_count=True)
    return q.select(*[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "n")
