"""Registered queries over the event log (S01, F01-F03, F07, T01-T03, A01-A06,
A12-A15, X13, X14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.time import cutoff, elapsed_seconds
from ..operators import log_queries as L
from .catalog import Ctx, register
from .oracle import NOW_SQL, OUTBOX, with_

OB = with_(OUTBOX)
LOG_COLS = ", ".join(S.EVENT_LOG.fieldNames())


@register("s01_event_log_scan", OB + f"SELECT {LOG_COLS} FROM outbox")
def s01(spark, sf_dir):
    """The full event log, fixed schema."""
    return Ctx(spark, sf_dir).outbox


@register("t01_poll_batch", OB + f"""
SELECT id, aggregate_id, event_type, created_at FROM outbox
WHERE status='PENDING' AND (next_retry_at IS NULL OR next_retry_at <= {NOW_SQL})
ORDER BY created_at, id LIMIT 100""")
def t01(spark, sf_dir):
    """Poll batch of 100, oldest first."""
    c = Ctx(spark, sf_dir)
    return L.poll_batch(c.outbox, c.now).select("id", "aggregate_id", "event_type", "created_at")


@register("t01_poll_unlimited", OB + f"""
SELECT id, created_at FROM outbox
WHERE status='PENDING' AND (next_retry_at IS NULL OR next_retry_at <= {NOW_SQL})""")
def t01b(spark, sf_dir):
    """T01 document variant: every unpublished row, no limit."""
    c = Ctx(spark, sf_dir)
    return L.poll_batch(c.outbox, c.now, limit=None).select("id", "created_at")


@register("t02_retry_batch", OB + f"""
SELECT id, retry_count, next_retry_at FROM outbox
WHERE status='FAILED' AND next_retry_at <= {NOW_SQL} AND retry_count < 3
ORDER BY next_retry_at, id LIMIT 100""")
def t02(spark, sf_dir):
    """Due retries below the ceiling."""
    c = Ctx(spark, sf_dir)
    return L.retry_batch(c.outbox, c.now).select("id", "retry_count", "next_retry_at")


@register("t03_dead_letter_candidates", OB + """
SELECT id, retry_count, updated_at FROM outbox
WHERE status='FAILED' AND retry_count >= 3 ORDER BY updated_at, id LIMIT 100""")
def t03(spark, sf_dir):
    """FAILED rows at the retry ceiling."""
    c = Ctx(spark, sf_dir)
    return L.dead_letter_candidates(c.outbox).select("id", "retry_count", "updated_at")


@register("f01_stuck_events", OB + f"""
SELECT id, updated_at FROM outbox
WHERE status='PROCESSING' AND updated_at < {NOW_SQL} - INTERVAL 5 MINUTE""")
def f01(spark, sf_dir):
    """PROCESSING rows untouched for 5 minutes."""
    c = Ctx(spark, sf_dir)
    return L.stuck_events(c.outbox, c.now).select("id", "updated_at")


@register("f02_type_and_status", OB + """
SELECT id, event_type, status FROM outbox
WHERE event_type='OrderCreated' AND status IN ('PENDING','FAILED')""")
def f02(spark, sf_dir):
    """OrderCreated rows that are PENDING or FAILED."""
    c = Ctx(spark, sf_dir)
    return L.by_type_and_status(c.outbox, S.ORDER_CREATED, [S.PENDING, S.FAILED]).select(
        "id", "event_type", "status")


@register("f03_trace_by_correlation", OB + """
SELECT o.correlation_id, o.id, o.created_at FROM outbox o
WHERE o.correlation_id IN (SELECT correlation_id FROM outbox GROUP BY correlation_id HAVING count(*) >= 7)""")
def f03(spark, sf_dir):
    """trace views of every complete correlation group (7 events each)."""
    c = Ctx(spark, sf_dir)
    log = c.outbox
    full = (log.groupBy("correlation_id").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= 7).select("correlation_id"))
    return (log.join(full, "correlation_id", "left_semi")
            .select("correlation_id", "id", "created_at"))


@register("f07_payload_contains", OB + """
SELECT id, payload FROM outbox WHERE contains(payload, '"k": 42')""")
def f07(spark, sf_dir):
    """erasure look-up — rows whose payload names a value."""
    c = Ctx(spark, sf_dir)
    return L.payload_contains(c.outbox, '"k": 42').select("id", "payload")


ERASE_SQL = """, marked AS (SELECT o.*, regexp_extract(payload, '"k": ?([0-9]+)', 1) IN
  (SELECT CAST(n_nationkey AS VARCHAR) FROM nation) AS gone FROM outbox o)"""


@register("f07_erasure_kept", OB.rstrip() + ERASE_SQL + """
SELECT id, status FROM marked WHERE NOT gone""")
def f07b(spark, sf_dir):
    """the log without the rows of a list of subjects (extracted key, whole value)."""
    c = Ctx(spark, sf_dir)
    return L.erase_subjects(c.outbox, c.t("nation"), "$.k", "n_nationkey")[0].select("id", "status")


@register("f07_erased_rows", OB.rstrip() + ERASE_SQL + """
SELECT id, payload FROM marked WHERE gone""")
def f07c(spark, sf_dir):
    """the rows that an erasure by a list of subjects removes."""
    c = Ctx(spark, sf_dir)
    return L.erase_subjects(c.outbox, c.t("nation"), "$.k", "n_nationkey")[1].select("id", "payload")


@register("a01_status_counts", OB + """
SELECT d.status, CAST(count(o.id) AS BIGINT) AS n
FROM (VALUES ('PENDING'),('PROCESSING'),('PUBLISHED'),('FAILED'),('DEAD_LETTER')) d(status)
LEFT JOIN outbox o ON o.status = d.status GROUP BY d.status""")
def a01(spark, sf_dir):
    """Count per status, zero-filled."""
    return L.status_counts(Ctx(spark, sf_dir).outbox)


@register("a02_backlog", OB + "SELECT CAST(count(*) AS BIGINT) AS pending FROM outbox WHERE status='PENDING'")
def a02(spark, sf_dir):
    """Backlog size."""
    return L.backlog_size(Ctx(spark, sf_dir).outbox)


@register("a03_avg_processing_seconds", OB + """
SELECT round(avg(date_sub('second', created_at, published_at)), 6) AS avg_seconds FROM outbox
WHERE status='PUBLISHED' AND published_at >= TIMESTAMP '2024-01-01 00:00:00'""")
def a03(spark, sf_dir):
    """Average whole seconds to publish since the start of January."""
    return L.avg_processing_seconds(Ctx(spark, sf_dir).outbox, "2024-01-01 00:00:00").select(
        F.round("avg_seconds", 6).alias("avg_seconds"))



@register("a04_health", OB + """
SELECT pending, failed, dead_letter,
  CASE WHEN pending>10000 OR dead_letter>100 OR failed>1000 THEN 'UNHEALTHY'
       WHEN pending>5000 OR dead_letter>50 OR failed>500 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health
FROM (SELECT CAST(count(*) FILTER (WHERE status='PENDING') AS BIGINT) AS pending,
             CAST(count(*) FILTER (WHERE status='FAILED') AS BIGINT) AS failed,
             CAST(count(*) FILTER (WHERE status='DEAD_LETTER') AS BIGINT) AS dead_letter FROM outbox)""")
def a04(spark, sf_dir):
    """Health class."""
    return L.health(Ctx(spark, sf_dir).outbox)


@register("a05_metric_snapshot", OB + f"""
SELECT metric, value FROM (
 SELECT 'pending' AS metric, CAST(count(*) FILTER (WHERE status='PENDING') AS DOUBLE) AS value FROM outbox
 UNION ALL SELECT 'failed', CAST(count(*) FILTER (WHERE status='FAILED') AS DOUBLE) FROM outbox
 UNION ALL SELECT 'dead_letter', CAST(count(*) FILTER (WHERE status='DEAD_LETTER') AS DOUBLE) FROM outbox
 UNION ALL SELECT 'avg_processing_seconds', round(avg(CASE WHEN status='PUBLISHED'
     AND published_at >= {NOW_SQL} - INTERVAL 24 HOUR
     THEN date_sub('second', created_at, published_at) END), 6) FROM outbox)""")
def a05(spark, sf_dir):
    """Metric snapshot (gauges + average latency over the last day)."""
    c = Ctx(spark, sf_dir)
    return L.metric_snapshot(c.outbox, c.now, window_hours=24).select(
        "metric", F.round("value", 6).alias("value"))


@register("a06_daily_counters", OB + """
SELECT day, published, failed,
  CAST(sum(published) OVER (ORDER BY day) AS BIGINT) AS published_total,
  CAST(sum(failed) OVER (ORDER BY day) AS BIGINT) AS failed_total
FROM (SELECT CAST(updated_at AS DATE) AS day,
        CAST(count(*) FILTER (WHERE status='PUBLISHED') AS BIGINT) AS published,
        CAST(count(*) FILTER (WHERE status IN ('FAILED','DEAD_LETTER')) AS BIGINT) AS failed
      FROM outbox GROUP BY 1)""")
def a06(spark, sf_dir):
    """Published / failed counters per day with running totals."""
    return L.daily_counters(Ctx(spark, sf_dir).outbox)


@register("a12_volume_by_type_day", OB + """
SELECT event_type, CAST(created_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS n
FROM outbox GROUP BY 1, 2""")
def a12(spark, sf_dir):
    """Events per type and day."""
    return L.volume_by_type_day(Ctx(spark, sf_dir).outbox)


@register("a13_time_since_last_published", OB + f"""
SELECT max(published_at) AS last_published_at,
  date_sub('second', max(published_at), {NOW_SQL}) AS seconds_since FROM outbox""")
def a13(spark, sf_dir):
    """Seconds since the newest publish."""
    c = Ctx(spark, sf_dir)
    return L.time_since_last_published(c.outbox, c.now)


@register("a14_cleanup_metrics", OB + f"""
SELECT CAST(count(*) AS BIGINT) AS rows_before,
  CAST(count(*) FILTER (WHERE status='PUBLISHED' AND published_at < {NOW_SQL} - INTERVAL 7 DAY) AS BIGINT) AS deleted,
  min(created_at) AS oldest_created_at,
  CAST(count(*) - count(*) FILTER (WHERE status='PUBLISHED' AND published_at < {NOW_SQL} - INTERVAL 7 DAY) AS BIGINT) AS rows_after,
  date_sub('second', min(created_at), {NOW_SQL}) AS oldest_age_seconds FROM outbox""")
def a14(spark, sf_dir):
    """Cleanup metrics for a 7-day retention."""
    c = Ctx(spark, sf_dir)
    return L.cleanup_metrics(c.outbox, c.now)


@register("a15_duplicate_rate", OB + """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT correlation_id) AS BIGINT) AS distinct_keys,
  CAST(count(*) - count(DISTINCT correlation_id) AS BIGINT) AS duplicates,
  round((count(*) - count(DISTINCT correlation_id)) / count(*), 6) AS duplicate_rate FROM outbox""")
def a15(spark, sf_dir):
    """Duplicate rate of a key (correlation id groups events)."""
    return L.duplicate_rate(Ctx(spark, sf_dir).outbox, "correlation_id")


@register("x13_elapsed_seconds", OB + """
SELECT id, date_sub('second', created_at, updated_at) AS elapsed FROM outbox""")
def x13(spark, sf_dir):
    """Whole seconds between two timestamps, per row."""
    c = Ctx(spark, sf_dir)
    return c.outbox.select("id", elapsed_seconds(F.col("created_at"), F.col("updated_at")).alias("elapsed"))


@register("x14_cutoffs", OB + f"""
SELECT CAST(count(*) FILTER (WHERE created_at < {NOW_SQL} - INTERVAL 7 DAY) AS BIGINT) AS older_7d,
  CAST(count(*) FILTER (WHERE created_at < {NOW_SQL} - INTERVAL 90 MINUTE) AS BIGINT) AS older_90m,
  CAST(count(*) FILTER (WHERE created_at < {NOW_SQL} - INTERVAL 36 HOUR) AS BIGINT) AS older_36h FROM outbox""")
def x14(spark, sf_dir):
    """Cut-offs now - days / minutes / hours."""
    c = Ctx(spark, sf_dir)
    return c.outbox.agg(
        F.count_if(F.col("created_at") < cutoff(c.now, days=7)).alias("older_7d"),
        F.count_if(F.col("created_at") < cutoff(c.now, minutes=90)).alias("older_90m"),
        F.count_if(F.col("created_at") < cutoff(c.now, hours=36)).alias("older_36h"))
