"""Delivery lifecycle of event rows as table -> table functions.

A state change never updates in place: each function returns the next
snapshot of the log, which the caller writes as a new version (single writer).
Whole-log transitions are narrow ``when`` projections (no shuffle).  Changes
driven by an id list join that list; it is broadcast only when its size has a
known bound (a poll batch of at most ``limit`` rows), otherwise the join is a
regular shuffle join that AQE may still turn into a broadcast at run time.

Per-row saves bump ``version`` (optimistic lock column) and stamp
``updated_at``; bulk updates do not bump the version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.time import backoff_seconds, cutoff, plus_seconds, ts
from .log_queries import dead_letter_candidates, poll_batch, retry_batch

# Largest id list joined by broadcast: poll batches and similar bounded lists.
BROADCAST_ROW_BOUND = 100_000

LIFE_COLS = ["id", "status", "retry_count", "error_message", "updated_at", "published_at",
             "next_retry_at", "version"]


def _flag_ids(log: DataFrame, ids: DataFrame, flag: str, bound: int | None) -> DataFrame:
    marked = ids.select("id").distinct().withColumn(flag, F.lit(True))
    if bound is not None and bound <= BROADCAST_ROW_BOUND:
        marked = F.broadcast(marked)
    return (log.join(marked, "id", "left")
            .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))


def _set(df: DataFrame, cond, **values) -> DataFrame:
    """Assign ``values`` where ``cond`` holds; all right-hand sides and the
    condition see the row as it was before the update."""
    return df.withColumns({name: F.when(cond, value).otherwise(F.col(name))
                           for name, value in values.items()})


def claim(log: DataFrame, batch: DataFrame, now, bound: int | None = S.POLL_LIMIT) -> DataFrame:
    """Rows of ``batch`` become PROCESSING at ``now`` (per-row save)."""
    df = _flag_ids(log, batch, "_hit", bound)
    df = _set(df, F.col("_hit"), status=F.lit(S.PROCESSING), updated_at=ts(now),
              version=F.col("version") + 1)
    return df.drop("_hit")


def mark_published(rows: DataFrame, now) -> DataFrame:
    """Per-row ``markAsPublished`` (status, published_at, updated_at, version)."""
    return (rows.withColumn("status", F.lit(S.PUBLISHED))
            .withColumn("published_at", ts(now)).withColumn("updated_at", ts(now))
            .withColumn("version", F.col("version") + 1))


def bulk_publish(log: DataFrame, ids: DataFrame, now, bound: int | None = None) -> DataFrame:
    """One bulk update of an id list to PUBLISHED (no version bump)."""
    df = _flag_ids(log, ids, "_hit", bound)
    df = _set(df, F.col("_hit"), status=F.lit(S.PUBLISHED), published_at=ts(now),
              updated_at=ts(now))
    return df.drop("_hit")


def handle_failure(log: DataFrame, failures: DataFrame, now, max_retries: int = S.MAX_RETRIES,
                   bound: int | None = None) -> DataFrame:
    """Failed publishes -> FAILED with back-off, or DEAD_LETTER at the ceiling.

    ``failures`` has ``(id, error)``.  Below the ceiling the count is
    incremented first, then ``next_retry_at = now + 2^count`` seconds.
    At the ceiling the count and retry time are left as they are.
    """
    f = (failures.groupBy("id").agg(F.min("error").alias("_err"))  # several reports of a row: the least text
         .withColumn("_hit", F.lit(True)))
    if bound is not None and bound <= BROADCAST_ROW_BOUND:
        f = F.broadcast(f)
    df = log.join(f, "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))  # a failure may have no text
    retry = hit & (F.col("retry_count") < max_retries)
    dead = hit & (F.col("retry_count") >= max_retries)
    new_count = F.col("retry_count") + 1
    df = df.withColumns({
        "next_retry_at": F.when(retry, plus_seconds(ts(now), backoff_seconds(new_count)))
                          .otherwise(F.col("next_retry_at")),
        "retry_count": F.when(retry, new_count).otherwise(F.col("retry_count")),
        "status": F.when(retry, F.lit(S.FAILED)).when(dead, F.lit(S.DEAD_LETTER))
                   .otherwise(F.col("status")),
        "error_message": F.when(retry, F.col("_err"))
                          .when(dead, F.concat(F.lit(S.MAX_RETRIES_PREFIX), F.coalesce(F.col("_err"), F.lit("null"))))
                          .otherwise(F.col("error_message")),
        "updated_at": F.when(hit, ts(now)).otherwise(F.col("updated_at")),
        "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version")),
    })
    return df.drop("_err", "_hit")


def reset_due_failed(log: DataFrame, now, max_retries: int = S.MAX_RETRIES,
                     limit: int | None = S.POLL_LIMIT) -> DataFrame:
    """Due FAILED rows below the ceiling go back to PENDING.

    With ``limit`` only the retry batch (T02) moves; with ``limit=None`` every
    due row moves in one narrow pass.
    """
    if limit is None:
        due = ((F.col("status") == S.FAILED) & (F.col("next_retry_at") <= ts(now))
               & (F.col("retry_count") < max_retries))
        return _set(log, F.coalesce(due, F.lit(False)), status=F.lit(S.PENDING), updated_at=ts(now),
                    version=F.col("version") + 1)
    df = _flag_ids(log, retry_batch(log, now, max_retries, limit), "_hit", limit)
    return _set(df, F.col("_hit"), status=F.lit(S.PENDING), updated_at=ts(now),
                version=F.col("version") + 1).drop("_hit")


def dead_letter_sweep(log: DataFrame, now, max_retries: int = S.MAX_RETRIES,
                      limit: int | None = None) -> DataFrame:
    """FAILED rows at the ceiling become DEAD_LETTER (repairs the
    unreachable automatic dead-lettering)."""
    if limit is None:
        cond = F.coalesce((F.col("status") == S.FAILED) & (F.col("retry_count") >= max_retries),
                          F.lit(False))
        df = log.withColumn("_hit", cond)
    else:
        df = _flag_ids(log, dead_letter_candidates(log, max_retries, limit), "_hit", limit)
    df = _set(df, F.col("_hit"), status=F.lit(S.DEAD_LETTER),
              error_message=F.concat(F.lit(S.MAX_RETRIES_PREFIX),
                                     F.coalesce(F.col("error_message"), F.lit(""))),
              updated_at=ts(now), version=F.col("version") + 1)
    return df.drop("_hit")


def recover_stuck(log: DataFrame, now, minutes: int = S.STUCK_MINUTES) -> DataFrame:
    """PROCESSING rows older than ``minutes`` go back to PENDING with a note."""
    cond = F.coalesce((F.col("status") == S.PROCESSING)
                      & (F.col("updated_at") < cutoff(now, minutes=minutes)), F.lit(False))
    return _set(log, cond, status=F.lit(S.PENDING), error_message=F.lit(S.STUCK_RECOVERED_MESSAGE),
                updated_at=ts(now), version=F.col("version") + 1)


def purge_predicate(now, retention_days: int = S.RETENTION_DAYS, grace_hours: int = 0):
    """Rows deletable by retention: PUBLISHED and published before the cut-off.

    Null-safe: a row with an unknown publish time is never deletable.
    """
    cut = cutoff(now, days=retention_days, hours=grace_hours)
    return F.coalesce((F.col("status") == S.PUBLISHED) & (F.col("published_at") < cut),
                      F.lit(False))


def purge(log: DataFrame, now, retention_days: int = S.RETENTION_DAYS, grace_hours: int = 0):
    """Returns ``(kept, deleted_count_df)``; kept is the next snapshot."""
    pred = purge_predicate(now, retention_days, grace_hours)
    kept = log.where(~pred)
    deleted = log.agg(F.count_if(pred).alias("deleted"))
    return kept, deleted


def purge_batches(log: DataFrame, now, batch_size: int = 10_000,
                  retention_days: int = S.RETENTION_DAYS) -> DataFrame:
    """Deletable rows numbered in (published_at, id) order and cut into
    batches of ``batch_size``; returns the per-batch report."""
    from .ordering import global_rank
    doomed = log.where(purge_predicate(now, retention_days)).select("id", "published_at")
    ranked = global_rank(doomed, ["published_at", "id"])
    return (ranked.groupBy(F.floor((F.col("rn") - 1) / batch_size).cast("bigint").alias("batch_no"))
            .agg(F.count(F.lit(1)).alias("deleted"), F.min("published_at").alias("first_published_at"),
                 F.max("published_at").alias("last_published_at")))


def replay_dead_letters(log: DataFrame, now) -> DataFrame:
    """DEAD_LETTER rows are reset to PENDING with counter 0 and no retry time."""
    cond = F.col("status") == S.DEAD_LETTER
    return _set(log, cond, status=F.lit(S.PENDING), retry_count=F.lit(0),
                next_retry_at=F.lit(None).cast("timestamp_ntz"), error_message=F.lit(None).cast("string"),
                updated_at=ts(now), version=F.col("version") + 1)


def dead_letter_rows(log: DataFrame, now) -> DataFrame:
    """The dead-letter sink records ``(payload, error, failed_at)``."""
    return (log.where(F.col("status") == S.DEAD_LETTER)
            .select("id", "payload", F.col("error_message").alias("error"),
                    F.coalesce(F.col("updated_at"), ts(now)).alias("failed_at")))


def delivery_step(log: DataFrame, outcomes: DataFrame, now, limit: int = S.POLL_LIMIT,
                  max_retries: int = S.MAX_RETRIES) -> DataFrame:
    """One poll -> claim -> publish -> settle cycle.

    The poll batch (at most ``limit`` rows) is claimed, grouped by delivery
    key (``coalesce(partition_key, aggregate_id)``), and each key group
    succeeds only if every row's outcome is ok (a key group is one publish
    call).  Successful groups are bulk-published; failed groups go through
    the retry / dead-letter rule.  Returns the next log snapshot.
    """
    batch = poll_batch(log, now, limit=limit).select(
        "id", F.coalesce("partition_key", "aggregate_id").alias("_key"))
    judged = batch.join(outcomes.select("id", "ok", "error"), "id", "left")
    group_ok = (judged.groupBy("_key")
                .agg(F.bool_and(F.coalesce(F.col("ok"), F.lit(False))).alias("_gok"),
                     F.min_by(F.col("error"), F.when(~F.coalesce(F.col("ok"), F.lit(False)),
                                                     F.col("id"))).alias("_gerr")))
    settled = batch.join(group_ok, "_key")
    if limit is not None and limit <= BROADCAST_ROW_BOUND:
        settled = F.broadcast(settled)
    claimed = claim(log, batch, now, bound=limit)
    ok_ids = settled.where(F.col("_gok")).select("id")
    failed = settled.where(~F.col("_gok")).select(
        "id", F.coalesce(F.col("_gerr"), F.lit("publish failed")).alias("error"))
    published = bulk_publish(claimed, ok_ids, now, bound=limit)
    return handle_failure(published, failed, now, max_retries, bound=limit)


def cycle(log: DataFrame, outcomes: DataFrame, now, limit: int = S.POLL_LIMIT, max_retries: int = S.MAX_RETRIES,
          stuck_minutes: int = S.STUCK_MINUTES) -> DataFrame:
    """Recover stuck rows, reset due retries, sweep exhausted rows to the
    dead-letter state and run one delivery step.  Published rows never change, so
    ``log`` may be the undelivered rows alone."""
    log = recover_stuck(log, now, stuck_minutes)
    log = reset_due_failed(log, now, max_retries, limit=None)
    log = dead_letter_sweep(log, now, max_retries)
    return delivery_step(log, outcomes, now, limit, max_retries)


def run_store_cycle(spark, base: str, outcomes: DataFrame, now, limit: int = S.POLL_LIMIT,
                    max_retries: int = S.MAX_RETRIES, stuck_minutes: int = S.STUCK_MINUTES) -> int:
    """R01 on a log stored in two parts (``sources.log_store``): the active part is read
    and rewritten, published rows are added to the done part, which is not read.
    Returns the version.  Outcomes of the external publish: ``(id, ok, error)``."""
    from ..sources import log_store
    stepped = cycle(log_store.read_active(spark, base), outcomes, now, limit, max_retries, stuck_minutes)
    return log_store.commit_cycle(stepped, base)


def run_cycle(spark, base: str, outcomes: DataFrame, now, limit: int = S.POLL_LIMIT,
              max_retries: int = S.MAX_RETRIES, stuck_minutes: int = S.STUCK_MINUTES) -> int:
    """R01 driver step on a log stored as whole snapshots: one ``cycle``, committed as
    the next snapshot.  Returns the version.

    Outcomes of the external publish come in as a table ``(id, ok, error)``.
    """
    from ..sources.sinks import commit_snapshot, read_latest
    log = cycle(read_latest(spark, base, S.EVENT_LOG), outcomes, now, limit, max_retries, stuck_minutes)
    return commit_snapshot(log.select(*S.EVENT_LOG.fieldNames()), base)
