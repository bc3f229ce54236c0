"""Queries over the event log: filters, poll batches and status aggregates.

All are filter / top-k / partial-aggregate plans: a scan with pushed
predicates, ``TakeOrderedAndProject`` for limits (each task keeps only its own
top n, so the final merge is n x tasks rows), and map-side combined aggregates
whose shuffle is one row per group per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.time import cutoff, elapsed_seconds, ts
from .ordering import rank_within


# -- filters and top-k -------------------------------------------------------

def poll_batch(log: DataFrame, now, status: str = S.PENDING, limit: int | None = S.POLL_LIMIT) -> DataFrame:
    """Rows in ``status`` whose retry time is unset or due, oldest first.

    Ties on ``created_at`` are broken by ``id``.  ``limit=None`` is the
    unlimited document variant.
    """
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= ts(now))
    out = log.where((F.col("status") == status) & due).orderBy("created_at", "id")
    return out.limit(limit) if limit is not None else out


def retry_batch(log: DataFrame, now, max_retries: int = S.MAX_RETRIES,
                limit: int | None = S.POLL_LIMIT) -> DataFrame:
    """FAILED rows that are due and still below the retry ceiling."""
    out = (log.where((F.col("status") == S.FAILED) & (F.col("next_retry_at") <= ts(now))
                     & (F.col("retry_count") < max_retries))
           .orderBy("next_retry_at", "id"))
    return out.limit(limit) if limit is not None else out


def dead_letter_candidates(log: DataFrame, max_retries: int = S.MAX_RETRIES,
                           limit: int | None = S.POLL_LIMIT) -> DataFrame:
    """FAILED rows at or above the retry ceiling, oldest update first."""
    out = (log.where((F.col("status") == S.FAILED) & (F.col("retry_count") >= max_retries))
           .orderBy("updated_at", "id"))
    return out.limit(limit) if limit is not None else out


def stuck_events(log: DataFrame, now, minutes: int = S.STUCK_MINUTES) -> DataFrame:
    """PROCESSING rows not touched since ``now - minutes`` (strict)."""
    return (log.where((F.col("status") == S.PROCESSING)
                      & (F.col("updated_at") < cutoff(now, minutes=minutes)))
            .orderBy("updated_at", "id"))


def by_type_and_status(log: DataFrame, event_type: str, statuses) -> DataFrame:
    """rows of one event type in any of ``statuses``."""
    return log.where((F.col("event_type") == event_type) & F.col("status").isin(list(statuses)))


def trace(log: DataFrame, correlation_id) -> DataFrame:
    """all rows sharing a correlation id, oldest first."""
    return log.where(F.col("correlation_id") == correlation_id).orderBy("created_at", "id")


def traces(log: DataFrame) -> DataFrame:
    """F03 for all correlation ids at once: (correlation_id, pos, id, ...), oldest first.
    Positions are a distributed rank, so one id with most rows is not one task's."""
    return rank_within(log.where(F.col("correlation_id").isNotNull()), ["correlation_id"], ["created_at", "id"], "pos")


def payload_contains(log: DataFrame, needle: str) -> DataFrame:
    """rows whose payload text contains ``needle`` (erasure look-up)."""
    return log.where(F.col("payload").contains(needle))


def subject_of(payload: F.Column, path: str) -> F.Column:
    """the subject's id as the payload names it (whole value, not a part of one), at
    a path of names (``$.customer.id``).  Read as the decoder reads it (``from_json``), so
    of a repeated name the last value counts in both."""
    names = path.removeprefix("$").strip(".").split(".")
    if not all(n.replace("_", "").isalnum() for n in names):
        raise ValueError(f"not a path of names: {path}")
    schema = "STRING"
    for name in reversed(names[1:]):
        schema = f"STRUCT<`{name}`: {schema}>"
    out = F.from_json(payload, f"`{names[0]}` {schema}")
    for name in names:
        out = out[name]
    return out


def erase_subjects(log: DataFrame, subjects: DataFrame, path: str, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """``(kept, erased)`` — the next snapshot without the rows of the listed
    subjects, and those rows.  Anti and semi join on the extracted id, so the
    list may be of any length; rows whose payload names no subject are kept."""
    ids = subjects.select(F.col(id_col).cast("string").alias("_subject")).where("_subject is not null").distinct()
    named = subject_of(log["payload"], path) == F.col("_subject")
    return log.join(ids, named, "left_anti"), log.join(ids, named, "left_semi")


# -- aggregates ---------------------------------------------------------------

def status_counts(log: DataFrame) -> DataFrame:
    """Count per status, zero-filled for every known status.

    One pass of conditional counts (a global partial aggregate) unpivoted with
    ``stack``: no join, no dimension table, no shuffle beyond one row per task.
    """
    counts = log.agg(*[F.count_if(F.col("status") == s).alias(s) for s in S.STATUSES])
    pairs = ", ".join(f"'{s}', `{s}`" for s in S.STATUSES)
    return counts.selectExpr(f"stack({len(S.STATUSES)}, {pairs}) AS (status, n)")


def backlog_size(log: DataFrame) -> DataFrame:
    """Number of PENDING rows."""
    return log.agg(F.count_if(F.col("status") == S.PENDING).alias("pending"))


def avg_processing_seconds(log: DataFrame, since) -> DataFrame:
    """Mean whole seconds created -> published for rows published since ``since``.

    Null when no row qualifies.
    """
    secs = elapsed_seconds(F.col("created_at"), F.col("published_at"))
    return (log.where((F.col("status") == S.PUBLISHED) & (F.col("published_at") >= ts(since)))
            .agg(F.avg(secs).alias("avg_seconds")))


# Health thresholds (pending, dead letter, failed).
UNHEALTHY = {"pending": 10000, "dead": 100, "failed": 1000}
DEGRADED = {"pending": 5000, "dead": 50, "failed": 500}


def health(log: DataFrame) -> DataFrame:
    """HEALTHY / DEGRADED / UNHEALTHY from pending, failed and dead-letter counts."""
    c = log.agg(F.count_if(F.col("status") == S.PENDING).alias("pending"),
                F.count_if(F.col("status") == S.FAILED).alias("failed"),
                F.count_if(F.col("status") == S.DEAD_LETTER).alias("dead_letter"))
    p, f, d = F.col("pending"), F.col("failed"), F.col("dead_letter")
    cls = (F.when((p > UNHEALTHY["pending"]) | (d > UNHEALTHY["dead"]) | (f > UNHEALTHY["failed"]),
                  "UNHEALTHY")
           .when((p > DEGRADED["pending"]) | (d > DEGRADED["dead"]) | (f > DEGRADED["failed"]),
                 "DEGRADED")
           .otherwise("HEALTHY"))
    return c.withColumn("health", cls)


def metric_snapshot(log: DataFrame, now, window_hours: int = 1) -> DataFrame:
    """The monitoring gauges in one pass, as a long (metric, value) table."""
    since = cutoff(now, hours=window_hours)
    secs = elapsed_seconds(F.col("created_at"), F.col("published_at"))
    recent = (F.col("status") == S.PUBLISHED) & (F.col("published_at") >= since)
    wide = log.agg(
        F.count_if(F.col("status") == S.PENDING).cast("double").alias("pending"),
        F.count_if(F.col("status") == S.FAILED).cast("double").alias("failed"),
        F.count_if(F.col("status") == S.DEAD_LETTER).cast("double").alias("dead_letter"),
        F.avg(F.when(recent, secs)).alias("avg_processing_seconds"))
    return wide.selectExpr(
        "stack(4, 'pending', pending, 'failed', failed, 'dead_letter', dead_letter, "
        "'avg_processing_seconds', avg_processing_seconds) AS (metric, value)")


def daily_counters(log: DataFrame) -> DataFrame:
    """Published and failed per day with running totals.

    The running total is a window over the day series only (one row per day
    after the partial aggregate), never over raw events.
    """
    from pyspark.sql import Window
    day = F.to_date(F.col("updated_at"))
    daily = (log.groupBy(day.alias("day"))
             .agg(F.count_if(F.col("status") == S.PUBLISHED).alias("published"),
                  F.count_if(F.col("status").isin(S.FAILED, S.DEAD_LETTER)).alias("failed")))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (daily.withColumn("published_total", F.sum("published").over(w))
            .withColumn("failed_total", F.sum("failed").over(w)))


def volume_by_type_day(log: DataFrame) -> DataFrame:
    """Events per (type, day)."""
    return (log.groupBy("event_type", F.to_date("created_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("n")))


def time_since_last_published(log: DataFrame, now) -> DataFrame:
    """Seconds since the newest publish."""
    return (log.agg(F.max("published_at").alias("last_published_at"))
            .withColumn("seconds_since", elapsed_seconds(F.col("last_published_at"), ts(now))))


def cleanup_metrics(log: DataFrame, now, retention_days: int = S.RETENTION_DAYS) -> DataFrame:
    """Rows before, rows deletable, rows after and oldest age (seconds)."""
    dead = (F.col("status") == S.PUBLISHED) & (F.col("published_at") < cutoff(now, days=retention_days))
    return (log.agg(F.count(F.lit(1)).alias("rows_before"),
                    F.count_if(dead).alias("deleted"),
                    F.min("created_at").alias("oldest_created_at"))
            .withColumn("rows_after", F.col("rows_before") - F.col("deleted"))
            .withColumn("oldest_age_seconds", elapsed_seconds(F.col("oldest_created_at"), ts(now))))


def duplicate_rate(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and duplicate share.

    The distinct count is a grouped partial aggregate (no single-task set).
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return (per_key.agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"))
            .withColumn("duplicates", F.col("rows") - F.col("distinct_keys"))
            .withColumn("duplicate_rate",
                        F.round(F.col("duplicates") / F.col("rows"), 6)))


def status_report(log: DataFrame) -> DataFrame:
    """A01 + A04 in one pass: zero-filled count per status with the health
    class on every row (one global partial aggregate, unpivoted; no join)."""
    counts = log.agg(*[F.count_if(F.col("status") == s).alias(s) for s in S.STATUSES])
    p, f, d = F.col(S.PENDING), F.col(S.FAILED), F.col(S.DEAD_LETTER)
    cls = (F.when((p > UNHEALTHY["pending"]) | (d > UNHEALTHY["dead"]) | (f > UNHEALTHY["failed"]),
                  "UNHEALTHY")
           .when((p > DEGRADED["pending"]) | (d > DEGRADED["dead"]) | (f > DEGRADED["failed"]), "DEGRADED")
           .otherwise("HEALTHY"))
    pairs = ", ".join(f"'{s}', `{s}`" for s in S.STATUSES)
    return (counts.withColumn("health", cls)
            .selectExpr(f"stack({len(S.STATUSES)}, {pairs}) AS (status, n)", "health"))
