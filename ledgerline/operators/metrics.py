"""Delivery and business metrics, alerts and call-log checks (A10, A11, A16-A23,
A25, W10-W12, R05, R06 batch twins).

Aggregates are partial (map-side combined); ordered checks over a key
(rolling windows, running sums, per-key ranks) use the distributed helpers in
``ordering`` so that a key holding a third of the rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.time import elapsed_seconds, ts
from .ordering import exact_quantiles, rank_within, running_sum, with_last

# Alert thresholds (backlog, failure rate %, dead letters, lag s,
# table rows, p95 processing s).
ALERT_RULES = (("backlog", 10000.0), ("failure_rate_pct", 10.0), ("dead_letter", 100.0),
               ("lag_seconds", 60.0), ("table_rows", 100000.0), ("p95_processing_seconds", 5.0))
# Bus unit capacity, bytes per second.
BUS_CAPACITY_BYTES_PER_S = 1024 * 1024


def key_shares(df: DataFrame, key: F.Column, threshold: float = 0.7) -> DataFrame:
    """A10: share of rows per key and a hot flag (share >= threshold).

    The total is a scalar subquery (a global partial aggregate), so per-key
    counts never meet in one task and no join is needed.
    """
    per = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return (per.withColumn("total", total)
            .withColumn("share", F.round(F.col("n") / F.col("total"), 6))
            .withColumn("is_hot", F.col("share") >= threshold))


def processing_seconds(log: DataFrame) -> DataFrame:
    return (log.where(F.col("status") == S.PUBLISHED)
            .select(elapsed_seconds(F.col("created_at"), F.col("published_at")).alias("secs")))


def latency_percentiles(log: DataFrame) -> DataFrame:
    """Exact p50 / p95 / p99 of whole seconds from creation to publish."""
    q = exact_quantiles(processing_seconds(log), "secs", [0.5, 0.95, 0.99])
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


def payload_size_percentiles(log: DataFrame) -> DataFrame:
    """Exact payload size percentiles (bytes)."""
    q = exact_quantiles(log.select(F.octet_length("payload").alias("b")), "b", [0.5, 0.95, 0.99])
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


def bytes_per_second(log: DataFrame, capacity: int = BUS_CAPACITY_BYTES_PER_S) -> DataFrame:
    """Bytes created per second vs the bus capacity: busiest second,
    average over active seconds, and seconds above capacity."""
    per_s = (log.groupBy(F.date_trunc("second", F.col("created_at")).alias("sec"))
             .agg(F.sum(F.octet_length("payload")).alias("bytes")))
    return per_s.agg(F.max("bytes").alias("max_bytes_per_s"),
                     F.round(F.avg("bytes"), 6).alias("avg_bytes_per_s"),
                     F.count_if(F.col("bytes") > capacity).alias("seconds_over_capacity"),
                     F.count(F.lit(1)).alias("active_seconds"))


def latency_histogram(log: DataFrame, lo: float = 0, hi: float = 600, buckets: int = 10) -> DataFrame:
    """Processing-time histogram (``width_bucket``: 0 below, n+1 at or above hi)."""
    return (processing_seconds(log)
            .groupBy(F.width_bucket(F.col("secs"), F.lit(lo), F.lit(hi), F.lit(buckets)).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def failures_by_reason(payments: DataFrame) -> DataFrame:
    """Failed payments by reason (``ok``, ``failure_reason``, ``amount``); a failure
    without a reason counts as ``unknown``."""
    failed = payments.where(~F.coalesce("ok", F.lit(False)))
    return failed.groupBy(F.coalesce("failure_reason", F.lit("unknown")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(19,2)")).cast("double").alias("amount"))


def error_classes(log: DataFrame) -> DataFrame:
    """Failures by error class (message without the dead-letter prefix)."""
    cls = F.regexp_replace(F.col("error_message"), "^" + S.MAX_RETRIES_PREFIX, "")
    return (log.where(F.col("error_message").isNotNull())
            .groupBy(cls.alias("error_class"), "status").agg(F.count(F.lit(1)).alias("n")))


def alert_metrics(log: DataFrame, now) -> DataFrame:
    """Inputs of A21 in one pass: backlog, failure rate, dead letters, lag of the
    oldest pending row, table size (rows) and p95 processing seconds."""
    one = log.agg(
        F.count_if(F.col("status") == S.PENDING).cast("double").alias("backlog"),
        F.round(F.count_if(F.col("status").isin(S.FAILED, S.DEAD_LETTER)) * 100.0
                / F.count(F.lit(1)), 6).alias("failure_rate_pct"),
        F.count_if(F.col("status") == S.DEAD_LETTER).cast("double").alias("dead_letter"),
        elapsed_seconds(F.min(F.when(F.col("status") == S.PENDING, F.col("created_at"))), ts(now))
        .cast("double").alias("lag_seconds"),
        F.count(F.lit(1)).cast("double").alias("table_rows"))
    p95 = latency_percentiles(log).select("p95").scalar()
    return one.withColumn("p95_processing_seconds", p95)


def evaluate_alerts(log: DataFrame, now) -> DataFrame:
    """Each rule as (metric, value, threshold, firing); firing = value > threshold."""
    m = alert_metrics(log, now)
    pairs = ", ".join(f"'{name}', CAST(`{name}` AS DOUBLE), CAST({thr} AS DOUBLE)"
                      for name, thr in ALERT_RULES)
    return (m.selectExpr(f"stack({len(ALERT_RULES)}, {pairs}) AS (metric, value, threshold)")
            .withColumn("firing", F.col("value") > F.col("threshold")))


def consumer_lag(stream: DataFrame, partition_col: str, order_cols: list, committed: F.Column) -> DataFrame:
    """Per partition, latest sequence, checkpointed sequence (the last
    committed row) and the lag in events and in minutes.

    Sequence numbers are counts: all rows of the partition, and those up to
    its last committed row.  ``committed`` marks rows already processed.
    """
    at = F.struct(*[F.col(c) for c in order_cols])
    rows = stream.withColumn("_at", at).withColumn("_done", committed)
    t = order_cols[0]
    last = rows.where("_done").groupBy(F.col(partition_col).alias("_p")).agg(F.max("_at").alias("_last"))
    marked = rows.join(last, F.col(partition_col).eqNullSafe(F.col("_p")), "left")
    return (marked.groupBy(partition_col)
            .agg(F.count(F.lit(1)).alias("latest_seq"),
                 F.count_if(F.col("_at") <= F.col("_last")).alias("checkpoint_seq"),
                 F.max(t).alias("_latest_t"),
                 F.max(F.when(F.col("_done"), F.col(t))).alias("_ckpt_t"))
            .withColumn("lag_events", F.col("latest_seq") - F.col("checkpoint_seq"))
            .withColumn("lag_minutes", F.round(elapsed_seconds(F.col("_ckpt_t"), F.col("_latest_t")) / 60.0, 6))
            .drop("_latest_t", "_ckpt_t"))


def rolling_call_rates(calls: DataFrame, window: int = 10, min_calls: int = 5,
                       failure_threshold: float = 0.5, slow_ms: int = 2000,
                       inclusive: bool = True) -> DataFrame:
    """Per target, failure and slow-call rates over the last ``window``
    calls (ordered by ts, id); a breach needs at least ``min_calls`` calls and
    a rate at (``inclusive``) or above the threshold.

    The last rows come from a rows window inside each range partition of the
    (target, ts, id) order, so no call is copied and no target is one task.
    """
    flags = calls.select("id", "target", "ts", F.coalesce(F.col("failed").cast("int"), F.lit(0)).alias("f"),
                         F.coalesce((F.col("dur_ms") > slow_ms).cast("int"), F.lit(0)).alias("s"))
    r = with_last(flags, ["target"], ["ts", "id"], ["f", "s"], window)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = (r.select("target", "pos", "id", "ts", F.size("last_f").cast("bigint").alias("n"),
                    total("last_f").alias("fails"), total("last_s").alias("slow"))
           .withColumn("failure_rate", F.round(F.col("fails") / F.col("n"), 6))
           .withColumn("slow_rate", F.round(F.col("slow") / F.col("n"), 6)))
    cmp = (lambda c: c >= failure_threshold) if inclusive else (lambda c: c > failure_threshold)
    return out.withColumn("breach", (F.col("n") >= min_calls) & cmp(F.col("failure_rate")))


def rate_limit_excess(calls: DataFrame, limit: int, unit: str = "second") -> DataFrame:
    """Calls beyond ``limit`` within one (target, time unit) bucket."""
    b = calls.withColumn("bucket", F.date_trunc(unit, F.col("ts")))
    r = rank_within(b.select("id", "target", "ts", "bucket"), ["target", "bucket"], ["ts", "id"], "pos")
    return r.where(F.col("pos") > limit)


def concurrency_peaks(calls: DataFrame, limit: int = 25, unit_seconds: float = 0.001) -> DataFrame:
    """Peak number of concurrent calls per target from a +1 / -1 sweep
    (end = ts + dur_ms * unit_seconds), ties ordered (time, delta, id) so an
    end before a start at the same instant does not overlap."""
    start = calls.select("target", F.col("ts").alias("t"), F.lit(1).alias("delta"), "id")
    end_t = F.timestamp_add("MICROSECOND", (F.col("dur_ms") * unit_seconds * 1_000_000).cast("bigint"), F.col("ts"))
    end = calls.select("target", end_t.alias("t"), F.lit(-1).alias("delta"), "id")
    sweep = running_sum(start.unionByName(end), ["target"], ["t", "delta", "id"], "delta", "active")
    return (sweep.groupBy("target").agg(F.max("active").alias("peak"))
            .withColumn("over_limit", F.col("peak") > limit))


def sla_report(calls: DataFrame, threshold_ms: int = 2000) -> DataFrame:
    """Per (operation, status) call count, mean duration and breach share."""
    status = F.when(F.col("failed"), "ERROR").otherwise("OK")
    return (calls.groupBy(F.col("target").alias("operation"), status.alias("status"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg("dur_ms"), 6).alias("avg_ms"),
                 F.round(F.avg(F.when(F.col("dur_ms") > threshold_ms, 1.0).otherwise(0.0)), 6)
                 .alias("breach_share")))


def per_minute(log: DataFrame, ts_col: str = "created_at") -> DataFrame:
    """R05 batch twin: events and failures per 1-minute tumbling window."""
    return (log.groupBy(F.window(F.col(ts_col), "1 minute").alias("w"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.count_if(F.col("status").isin(S.FAILED, S.DEAD_LETTER)).alias("failures"))
            .select(F.col("w.start").alias("window_start"), "events", "failures"))


def sliding_failure_rate(log: DataFrame, ts_col: str = "created_at", window_minutes: int = 5,
                         slide_minutes: int = 1) -> DataFrame:
    """R06 batch twin, step 1: failure rate per sliding window."""
    return (log.groupBy(F.window(F.col(ts_col), f"{window_minutes} minutes",
                                 f"{slide_minutes} minutes").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("status").isin(S.FAILED, S.DEAD_LETTER)).alias("f"))
            .select(F.col("w.start").alias("window_start"), "n", "f")
            .withColumn("rate", F.round(F.col("f") / F.col("n"), 6)))


def sustained_breaches(rates: DataFrame, threshold: float, slide_minutes: int = 1,
                       sustain: int = 5) -> DataFrame:
    """R06 batch twin, step 2: breaching windows that close a run of at least
    ``sustain`` consecutive breaching windows (a window without events breaks
    the run).  Gaps-and-islands: island = step index - rank among breaches;
    the rank is the distributed global rank, the island start a grouped min.
    """
    from .ordering import global_rank
    from ..functions.time import ntz_micros
    step = F.floor(ntz_micros(F.col("window_start")) / (slide_minutes * 60_000_000)).cast("bigint")
    b = rates.where(F.col("rate") > threshold).withColumn("k", step)
    r = global_rank(b, ["k"], "_rn").withColumn("island", F.col("k") - F.col("_rn"))
    first = r.groupBy("island").agg(F.min("k").alias("_k0"))
    return (r.join(first, "island")
            .withColumn("run", (F.col("k") - F.col("_k0") + 1).cast("bigint"))
            .where(F.col("run") >= sustain)
            .select("window_start", "n", "f", "rate", "run"))
