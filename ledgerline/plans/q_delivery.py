"""Registered delivery-batching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery as D
from ..operators.log_queries import poll_batch
from .catalog import Ctx, register
from .oracle import NOW_SQL, OUTBOX, with_

OB = with_(OUTBOX)

W08_MAX = 64


@register("a09_group_batch_by_key", OB + f"""
SELECT coalesce(partition_key, aggregate_id) AS delivery_key, list(id ORDER BY created_at, id) AS ids,
  CAST(count(*) AS BIGINT) AS n
FROM (SELECT * FROM outbox WHERE status='PENDING' AND (next_retry_at IS NULL OR next_retry_at <= {NOW_SQL})
      ORDER BY created_at, id LIMIT 100) GROUP BY 1""")
def a09(spark, sf_dir):
    """The poll batch grouped by delivery key, order kept."""
    c = Ctx(spark, sf_dir)
    return D.group_by_key(poll_batch(c.outbox, c.now))


@register("w08_greedy_chunks", OB.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
r0 AS (SELECT id, event_type AS k, strlen(payload) AS sz,
  row_number() OVER (ORDER BY created_at, id) AS grn FROM outbox),
g AS (SELECT id, k, sz, (grn - 1) // 100 AS cycle,
  row_number() OVER (PARTITION BY (grn - 1) // 100, k ORDER BY grn) AS rn FROM r0),
rec AS (
  SELECT cycle, k, rn, id, sz, CASE WHEN sz > {W08_MAX} THEN NULL ELSE 0 END AS chunk_no,
    CASE WHEN sz > {W08_MAX} THEN 0 ELSE sz END AS fill, 0 AS cur FROM g WHERE rn = 1
  UNION ALL
  SELECT g.cycle, g.k, g.rn, g.id, g.sz,
    CASE WHEN g.sz > {W08_MAX} THEN NULL WHEN r.fill + g.sz <= {W08_MAX} THEN r.cur ELSE r.cur + 1 END,
    CASE WHEN g.sz > {W08_MAX} THEN r.fill WHEN r.fill + g.sz <= {W08_MAX} THEN r.fill + g.sz ELSE g.sz END,
    CASE WHEN g.sz > {W08_MAX} THEN r.cur WHEN r.fill + g.sz <= {W08_MAX} THEN r.cur ELSE r.cur + 1 END
  FROM rec r JOIN g ON g.cycle = r.cycle AND g.k = r.k AND g.rn = r.rn + 1)
SELECT id, cycle, k AS delivery_key, CAST(chunk_no AS INT) AS chunk_no, CAST(sz AS BIGINT) AS size FROM rec""")
def w08(spark, sf_dir):
    """Greedy chunks of at most 64 payload bytes per (poll cycle of 100, event type)."""
    c = Ctx(spark, sf_dir)
    return D.greedy_chunks(c.outbox, "event_type", max_bytes=W08_MAX)


@register("w09_pacing", OB + """
SELECT id, cycle, delivery_key, pos, CASE WHEN pos % 5 = 0 THEN 1000 ELSE 0 END AS delay_ms FROM (
  SELECT id, (grn - 1) // 100 AS cycle, event_type AS delivery_key,
    CAST(row_number() OVER (PARTITION BY (grn - 1) // 100, event_type ORDER BY grn) AS INT) AS pos
  FROM (SELECT id, event_type, row_number() OVER (ORDER BY created_at, id) AS grn FROM outbox))""")
def w09(spark, sf_dir):
    """Pause of 1000 ms after every 5th row of a (cycle, key) publish list."""
    c = Ctx(spark, sf_dir)
    return D.pacing(c.outbox, "event_type", pace_every=5, pace_delay_ms=1000)


@register("w09_count_batches", OB + """
SELECT delivery_key, CAST(floor((pos - 1) / 100) AS BIGINT) AS batch_no, CAST(count(*) AS BIGINT) AS n,
  min(id) AS first_id FROM (SELECT id, event_type AS delivery_key,
    row_number() OVER (PARTITION BY event_type ORDER BY created_at, id) AS pos FROM outbox) GROUP BY 1, 2""")
def w09b(spark, sf_dir):
    """W09 document variant: count-based batches of 100 per key."""
    c = Ctx(spark, sf_dir)
    b = D.count_batches(c.outbox, "event_type", 100)
    return b.groupBy("delivery_key", "batch_no").agg(F.count(F.lit(1)).alias("n"),
                                                     F.min("id").alias("first_id"))


@register("s05_keyed_publish_order", OB + """
SELECT coalesce(partition_key, aggregate_id) AS delivery_key, id,
  row_number() OVER (PARTITION BY coalesce(partition_key, aggregate_id) ORDER BY created_at, id) AS pos
FROM outbox WHERE status='PENDING'""")
def s05(spark, sf_dir):
    """Keyed, ordered publish plan of every PENDING row (position per key).

    The physical plan (``keyed_publish_order``) range-partitions by (key,
    created_at, id) and sorts inside partitions; positions use the skew-proof
    rank."""
    from ..operators.ordering import rank_within
    c = Ctx(spark, sf_dir)
    p = c.outbox.where(F.col("status") == "PENDING").select(
        D.delivery_key(c.outbox).alias("delivery_key"), "id", "created_at")
    return rank_within(p, ["delivery_key"], ["created_at", "id"]).select("delivery_key", "id", "pos")


@register("s06_oversize_split", OB + """
SELECT id, strlen(payload) > 8 AS rejected FROM outbox WHERE status='PENDING'""")
def s06(spark, sf_dir):
    """Single-event publish with the size check (limit 8 bytes here)."""
    c = Ctx(spark, sf_dir)
    p = c.outbox.where(F.col("status") == "PENDING")
    ok, bad = D.oversize_split(p, max_bytes=8)
    return (ok.select("id", F.lit(False).alias("rejected"))
            .unionByName(bad.select("id", F.lit(True).alias("rejected"))))
