"""Registered lifecycle queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.time import backoff_seconds
from ..operators import lifecycle as M
from ..operators.log_queries import poll_batch
from ..sources.derive import publish_outcomes
from .catalog import Ctx, register
from .oracle import NOW_SQL, OUTBOX, with_

OB = with_(OUTBOX)
LIFE = ", ".join(M.LIFE_COLS)

POLL_CTE = f""", batch AS (SELECT id FROM outbox WHERE status='PENDING'
  AND (next_retry_at IS NULL OR next_retry_at <= {NOW_SQL}) ORDER BY created_at, id LIMIT 100)"""


def _life(df):
    return df.select(*M.LIFE_COLS)


@register("m01_claim", OB.rstrip() + POLL_CTE + f"""
SELECT o.id, CASE WHEN b.id IS NULL THEN o.status ELSE 'PROCESSING' END AS status, o.retry_count,
  o.error_message, CASE WHEN b.id IS NULL THEN o.updated_at ELSE {NOW_SQL} END AS updated_at,
  o.published_at, o.next_retry_at, o.version + CASE WHEN b.id IS NULL THEN 0 ELSE 1 END AS version
FROM outbox o LEFT JOIN batch b ON o.id=b.id""")
def m01(spark, sf_dir):
    """Claim the poll batch (PENDING -> PROCESSING)."""
    c = Ctx(spark, sf_dir)
    log = c.outbox
    return _life(M.claim(log, poll_batch(log, c.now), c.now))


@register("m02_mark_published", OB.rstrip() + POLL_CTE + f"""
SELECT o.id, 'PUBLISHED' AS status, o.retry_count, o.error_message, {NOW_SQL} AS updated_at,
  {NOW_SQL} AS published_at, o.next_retry_at, o.version + 1 AS version
FROM outbox o JOIN batch b ON o.id=b.id""")
def m02(spark, sf_dir):
    """Per-row markAsPublished over the poll batch."""
    c = Ctx(spark, sf_dir)
    return _life(M.mark_published(poll_batch(c.outbox, c.now), c.now))


@register("m03_bulk_publish", OB + f"""
SELECT id, CASE WHEN hit THEN 'PUBLISHED' ELSE status END AS status, retry_count, error_message,
  CASE WHEN hit THEN {NOW_SQL} ELSE updated_at END AS updated_at,
  CASE WHEN hit THEN {NOW_SQL} ELSE published_at END AS published_at, next_retry_at, version
FROM (SELECT *, (status='PROCESSING' AND id%10<>0) AS hit FROM outbox)""")
def m03(spark, sf_dir):
    """Bulk update of every PROCESSING row whose publish succeeded."""
    c = Ctx(spark, sf_dir)
    log = c.outbox
    oks = publish_outcomes(log.where(F.col("status") == S.PROCESSING)).where("ok")
    return _life(M.bulk_publish(log, oks, c.now))


@register("m04_handle_failure", OB + f"""
SELECT id,
  CASE WHEN hit AND retry_count < 3 THEN 'FAILED' WHEN hit THEN 'DEAD_LETTER' ELSE status END AS status,
  CASE WHEN hit AND retry_count < 3 THEN retry_count + 1 ELSE retry_count END AS retry_count,
  CASE WHEN hit AND retry_count < 3 THEN 'timeout' WHEN hit THEN 'Max retries exceeded: timeout'
       ELSE error_message END AS error_message,
  CASE WHEN hit THEN {NOW_SQL} ELSE updated_at END AS updated_at, published_at,
  CASE WHEN hit AND retry_count < 3
       THEN {NOW_SQL} + INTERVAL 1 SECOND * CAST(power(2, retry_count + 1) AS INT)
       ELSE next_retry_at END AS next_retry_at,
  version + CASE WHEN hit THEN 1 ELSE 0 END AS version
FROM (SELECT *, status IN ('PROCESSING','FAILED') AS hit FROM outbox)""")
def m04(spark, sf_dir):
    """Publish failures -> FAILED with back-off or DEAD_LETTER at the ceiling."""
    c = Ctx(spark, sf_dir)
    log = c.outbox
    failures = (log.where(F.col("status").isin(S.PROCESSING, S.FAILED))
                .select("id", F.lit("timeout").alias("error")))
    return _life(M.handle_failure(log, failures, c.now))


@register("m05_reset_due_failed", OB + f""", rb AS (SELECT id FROM outbox WHERE status='FAILED'
  AND next_retry_at <= {NOW_SQL} AND retry_count < 3 ORDER BY next_retry_at, id LIMIT 100)
SELECT o.id, CASE WHEN rb.id IS NULL THEN o.status ELSE 'PENDING' END AS status, o.retry_count,
  o.error_message, CASE WHEN rb.id IS NULL THEN o.updated_at ELSE {NOW_SQL} END AS updated_at,
  o.published_at, o.next_retry_at, o.version + CASE WHEN rb.id IS NULL THEN 0 ELSE 1 END AS version
FROM outbox o LEFT JOIN rb ON o.id=rb.id""")
def m05(spark, sf_dir):
    """The due retry batch goes back to PENDING."""
    c = Ctx(spark, sf_dir)
    return _life(M.reset_due_failed(c.outbox, c.now))


@register("m05_reset_all_due", OB + f"""
SELECT id, CASE WHEN hit THEN 'PENDING' ELSE status END AS status, retry_count, error_message,
  CASE WHEN hit THEN {NOW_SQL} ELSE updated_at END AS updated_at, published_at, next_retry_at, version + CASE WHEN hit THEN 1 ELSE 0 END AS version
FROM (SELECT *, coalesce(status='FAILED' AND next_retry_at <= {NOW_SQL} AND retry_count < 3, false) AS hit
      FROM outbox)""")
def m05b(spark, sf_dir):
    """M05 without a limit: every due retry in one narrow pass."""
    c = Ctx(spark, sf_dir)
    return _life(M.reset_due_failed(c.outbox, c.now, limit=None))


@register("m06_dead_letter_sweep", OB + f"""
SELECT id, CASE WHEN hit THEN 'DEAD_LETTER' ELSE status END AS status, retry_count,
  CASE WHEN hit THEN concat('Max retries exceeded: ', coalesce(error_message, '')) ELSE error_message END
    AS error_message,
  CASE WHEN hit THEN {NOW_SQL} ELSE updated_at END AS updated_at, published_at, next_retry_at,
  version + CASE WHEN hit THEN 1 ELSE 0 END AS version
FROM (SELECT *, (status='FAILED' AND retry_count >= 3) AS hit FROM outbox)""")
def m06(spark, sf_dir):
    """Sweep FAILED rows at the ceiling into DEAD_LETTER."""
    c = Ctx(spark, sf_dir)
    return _life(M.dead_letter_sweep(c.outbox, c.now))


@register("m07_recover_stuck", OB + f"""
SELECT id, CASE WHEN hit THEN 'PENDING' ELSE status END AS status, retry_count,
  CASE WHEN hit THEN 'Recovered from stuck PROCESSING state' ELSE error_message END AS error_message,
  CASE WHEN hit THEN {NOW_SQL} ELSE updated_at END AS updated_at, published_at, next_retry_at, version + CASE WHEN hit THEN 1 ELSE 0 END AS version
FROM (SELECT *, (status='PROCESSING' AND updated_at < {NOW_SQL} - INTERVAL 5 MINUTE) AS hit FROM outbox)""")
def m07(spark, sf_dir):
    """Recover rows stuck in PROCESSING for over 5 minutes."""
    c = Ctx(spark, sf_dir)
    return _life(M.recover_stuck(c.outbox, c.now))


@register("m08_purge_kept", OB + f"""
SELECT id, status FROM outbox
WHERE NOT coalesce(status='PUBLISHED' AND published_at < {NOW_SQL} - INTERVAL 7 DAY, false)""")
def m08(spark, sf_dir):
    """The snapshot kept after a 7-day retention purge."""
    c = Ctx(spark, sf_dir)
    kept, _ = M.purge(c.outbox, c.now)
    return kept.select("id", "status")


@register("m08_purge_deleted", OB + f"""
SELECT CAST(count(*) FILTER (WHERE status='PUBLISHED' AND published_at < {NOW_SQL} - INTERVAL 7 DAY)
  AS BIGINT) AS deleted FROM outbox""")
def m08b(spark, sf_dir):
    """The deleted count of the purge (cleanupNow(7))."""
    c = Ctx(spark, sf_dir)
    return M.purge(c.outbox, c.now)[1]


@register("m09_purge_with_grace", OB + f"""
SELECT CAST(count(*) FILTER (WHERE status='PUBLISHED'
  AND published_at < {NOW_SQL} - INTERVAL 7 DAY - INTERVAL 1 HOUR) AS BIGINT) AS deleted FROM outbox""")
def m09(spark, sf_dir):
    """Purge count with a one-hour grace period."""
    c = Ctx(spark, sf_dir)
    return M.purge(c.outbox, c.now, grace_hours=1)[1]


@register("m10_purge_batches", OB + f"""
SELECT CAST(floor((rn - 1) / 1000) AS BIGINT) AS batch_no, CAST(count(*) AS BIGINT) AS deleted,
  min(published_at) AS first_published_at, max(published_at) AS last_published_at
FROM (SELECT id, published_at, row_number() OVER (ORDER BY published_at, id) AS rn FROM outbox
      WHERE status='PUBLISHED' AND published_at < {NOW_SQL} - INTERVAL 7 DAY) GROUP BY 1""")
def m10(spark, sf_dir):
    """Purge in batches (batch size 1,000 here; default 10,000)."""
    c = Ctx(spark, sf_dir)
    return M.purge_batches(c.outbox, c.now, batch_size=1000)


@register("m12_replay_dead_letters", OB + f"""
SELECT id, CASE WHEN hit THEN 'PENDING' ELSE status END AS status,
  CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count,
  CASE WHEN hit THEN NULL ELSE error_message END AS error_message,
  CASE WHEN hit THEN {NOW_SQL} ELSE updated_at END AS updated_at, published_at,
  CASE WHEN hit THEN NULL ELSE next_retry_at END AS next_retry_at,
  version + CASE WHEN hit THEN 1 ELSE 0 END AS version
FROM (SELECT *, status='DEAD_LETTER' AS hit FROM outbox)""")
def m12(spark, sf_dir):
    """Replay the dead-letter queue (reset to PENDING, counter 0)."""
    c = Ctx(spark, sf_dir)
    return _life(M.replay_dead_letters(c.outbox, c.now))


@register("s09_dead_letter_sink", OB + f"""
SELECT id, payload, error_message AS error, coalesce(updated_at, {NOW_SQL}) AS failed_at
FROM outbox WHERE status='DEAD_LETTER'""")
def s09(spark, sf_dir):
    """Dead-letter sink records."""
    c = Ctx(spark, sf_dir)
    return M.dead_letter_rows(c.outbox, c.now)


@register("x01_backoff", OB + """
SELECT id, retry_count, CAST(power(2, retry_count) AS INT) AS backoff_seconds FROM outbox
WHERE status='FAILED'""")
def x01(spark, sf_dir):
    """Back-off 2^retry_count seconds."""
    c = Ctx(spark, sf_dir)
    return (c.outbox.where(F.col("status") == S.FAILED)
            .select("id", "retry_count", backoff_seconds(F.col("retry_count")).alias("backoff_seconds")))


@register("r01_delivery_step", OB.rstrip() + f""",
batch AS (SELECT id, coalesce(partition_key, aggregate_id) AS k FROM outbox WHERE status='PENDING'
  AND (next_retry_at IS NULL OR next_retry_at <= {NOW_SQL}) ORDER BY created_at, id LIMIT 100),
judged AS (SELECT b.id, b.k, (b.id%10<>0) AS ok, CASE WHEN b.id%10=0 THEN 'timeout' END AS error FROM batch b),
grp AS (SELECT k, bool_and(ok) AS gok, arg_min(error, CASE WHEN NOT ok THEN id END) AS gerr
        FROM judged GROUP BY k),
settled AS (SELECT j.id, g.gok, coalesce(g.gerr, 'publish failed') AS err FROM judged j JOIN grp g ON j.k=g.k)
SELECT o.id,
  CASE WHEN s.id IS NULL THEN o.status WHEN s.gok THEN 'PUBLISHED'
       WHEN o.retry_count < 3 THEN 'FAILED' ELSE 'DEAD_LETTER' END AS status,
  CASE WHEN s.id IS NOT NULL AND NOT s.gok AND o.retry_count < 3 THEN o.retry_count + 1
       ELSE o.retry_count END AS retry_count,
  CASE WHEN s.id IS NULL OR s.gok THEN o.error_message WHEN o.retry_count < 3 THEN s.err
       ELSE concat('Max retries exceeded: ', s.err) END AS error_message,
  CASE WHEN s.id IS NULL THEN o.updated_at ELSE {NOW_SQL} END AS updated_at,
  CASE WHEN s.gok THEN {NOW_SQL} ELSE o.published_at END AS published_at,
  CASE WHEN s.id IS NOT NULL AND NOT s.gok AND o.retry_count < 3
       THEN {NOW_SQL} + INTERVAL 1 SECOND * CAST(power(2, o.retry_count + 1) AS INT)
       ELSE o.next_retry_at END AS next_retry_at,
  o.version + CASE WHEN s.id IS NULL THEN 0 WHEN s.gok THEN 1 ELSE 2 END AS version
FROM outbox o LEFT JOIN settled s ON o.id=s.id""")
def r01(spark, sf_dir):
    """One poll -> claim -> publish -> settle cycle with per-key publish outcomes."""
    c = Ctx(spark, sf_dir)
    log = c.outbox
    return _life(M.delivery_step(log, publish_outcomes(log), c.now))


@register("r01_stored_cycle", OB.rstrip() + f""",
rec AS (SELECT * REPLACE (CASE WHEN stuck THEN 'PENDING' ELSE status END AS status,
    CASE WHEN stuck THEN 'Recovered from stuck PROCESSING state' ELSE error_message END AS error_message,
    CASE WHEN stuck THEN {NOW_SQL} ELSE updated_at END AS updated_at, version + CASE WHEN stuck THEN 1 ELSE 0 END AS version)
  FROM (SELECT *, status = 'PROCESSING' AND updated_at < {NOW_SQL} - INTERVAL 5 MINUTE AS stuck FROM outbox)),
ret AS (SELECT * REPLACE (CASE WHEN due THEN 'PENDING' WHEN worn THEN 'DEAD_LETTER' ELSE status END AS status,
    CASE WHEN worn THEN concat('Max retries exceeded: ', coalesce(error_message, '')) ELSE error_message END AS error_message,
    CASE WHEN due OR worn THEN {NOW_SQL} ELSE updated_at END AS updated_at, version + CASE WHEN due OR worn THEN 1 ELSE 0 END AS version)
  FROM (SELECT *, status = 'FAILED' AND coalesce(next_retry_at <= {NOW_SQL}, false) AND retry_count < 3 AS due,
               status = 'FAILED' AND retry_count >= 3 AS worn FROM rec)),
batch AS (SELECT id, coalesce(partition_key, aggregate_id) AS k FROM ret WHERE status='PENDING'
  AND (next_retry_at IS NULL OR next_retry_at <= {NOW_SQL}) ORDER BY created_at, id LIMIT 100),
grp AS (SELECT k, bool_and(id%10<>0) AS gok, CASE WHEN bool_or(id%10=0) THEN 'timeout' END AS gerr FROM batch GROUP BY k),
settled AS (SELECT b.id, g.gok, coalesce(g.gerr, 'publish failed') AS err FROM batch b JOIN grp g ON b.k=g.k)
SELECT o.id, CASE WHEN o.status = 'PUBLISHED' OR s.gok THEN 'done' ELSE 'active' END AS part,
  CASE WHEN s.id IS NULL THEN o.status WHEN s.gok THEN 'PUBLISHED' WHEN o.retry_count < 3 THEN 'FAILED' ELSE 'DEAD_LETTER' END AS status,
  CASE WHEN s.id IS NOT NULL AND NOT s.gok AND o.retry_count < 3 THEN o.retry_count + 1 ELSE o.retry_count END AS retry_count,
  CASE WHEN s.id IS NULL OR s.gok THEN o.error_message WHEN o.retry_count < 3 THEN s.err
       ELSE concat('Max retries exceeded: ', s.err) END AS error_message,
  CASE WHEN s.id IS NULL THEN o.updated_at ELSE {NOW_SQL} END AS updated_at,
  CASE WHEN s.gok THEN {NOW_SQL} ELSE o.published_at END AS published_at,
  o.version + CASE WHEN s.id IS NULL THEN 0 WHEN s.gok THEN 1 ELSE 2 END AS version
FROM ret o LEFT JOIN settled s ON o.id=s.id""")
def r01_stored(spark, sf_dir):
    """R01 on a stored log: one cycle that reads and rewrites the active part and adds
    what it published to the done part; then the whole log, read back."""
    from ..session import scratch_path
    from ..sources import log_store
    c = Ctx(spark, sf_dir)
    base = scratch_path(spark, f"logs/r01-{uuid.uuid4().hex[:12]}")
    log_store.create(c.outbox, base)
    M.run_store_cycle(spark, base, publish_outcomes(log_store.read_active(spark, base)), c.now)
    cols = ["status", "retry_count", "error_message", "updated_at", "published_at", "version"]
    return (log_store.read_active(spark, base).withColumn("part", F.lit("active"))
            .unionByName(log_store.read_done(spark, base).withColumn("part", F.lit("done"))).select("id", "part", *cols))
