"""Structured Streaming jobs.

Effects are idempotent per micro-batch: ``foreachBatch`` writes each output
of batch ``b`` to its own ``batch_id=b`` folder with overwrite, so a batch
replayed after a failure replaces its earlier partial output instead of
duplicating it.  Event time is cast to ``timestamp`` before a watermark
(``withWatermark`` rejects ``timestamp_ntz``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.codec import decode, route, schema_version_check
from ..operators.handlers import HandlerRegistry

MAX_CONSUMER_RETRIES = 3


def event_time(df: DataFrame, col: str = "ts", out: str = "event_ts") -> DataFrame:
    """Event time as a ``timestamp`` (UTC reading of the ``timestamp_ntz``)."""
    from ..functions.time import as_instant
    return df.withColumn(out, as_instant(F.col(col)))


def dedup_stream(stream: DataFrame, key: str = "id", ts_col: str = "event_ts",
                 horizon: str = "7 days") -> DataFrame:
    """Drop redelivered events within a 7-day horizon (state is bounded by
    the watermark)."""
    return stream.withWatermark(ts_col, horizon).dropDuplicatesWithinWatermark([key])


def per_minute_stream(stream: DataFrame, ts_col: str = "event_ts", delay: str = "1 minute") -> DataFrame:
    """Events and failures per 1-minute tumbling window (append mode)."""
    return (stream.withWatermark(ts_col, delay)
            .groupBy(F.window(ts_col, "1 minute").alias("w"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.count_if(F.col("status").isin(S.FAILED, S.DEAD_LETTER)).alias("failures"))
            .select(F.col("w.start").alias("window_start"), "events", "failures"))


def sliding_rate_stream(stream: DataFrame, ts_col: str = "event_ts", delay: str = "1 minute") -> DataFrame:
    """Failure rate over 5-minute windows sliding by 1 minute."""
    return (stream.withWatermark(ts_col, delay)
            .groupBy(F.window(ts_col, "5 minutes", "1 minute").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("status").isin(S.FAILED, S.DEAD_LETTER)).alias("f"))
            .select(F.col("w.start").alias("window_start"), "n", "f",
                    F.round(F.col("f") / F.col("n"), 6).alias("rate")))


def match_payments_stream(purchases: DataFrame, clicks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream-stream left outer join — a purchase with the same user's
    clicks within one hour after it; both sides watermarked so join state is
    dropped once no match can arrive."""
    p = purchases.withWatermark("p_ts", delay).alias("p")
    c = clicks.withWatermark("c_ts", delay).alias("c")
    cond = ((F.col("p.p_user") == F.col("c.c_user")) & (F.col("c.c_ts") >= F.col("p.p_ts"))
            & (F.col("c.c_ts") <= F.col("p.p_ts") + F.expr("INTERVAL 1 HOUR")))
    return p.join(c, cond, "leftOuter").select(F.col("p.p_id").alias("id"), F.col("c.c_id").alias("r_id"))


def classify_consumed(batch: DataFrame, handler_ok=None) -> DataFrame:
    """R02 step: decode, route and decide ack / retry / dead-letter per message.

    ``properties`` may carry ``eventType`` and ``retryCount`` (defaults
    "Unknown" and 0).  Decode failures and unsupported versions are poison:
    dead-lettered at once.  A handler failure is retried while the retry count
    is below ``MAX_CONSUMER_RETRIES`` and then dead-lettered (repairs B6).
    The unknown-type route is acknowledged (the reference's default branch).
    """
    d = decode(batch)
    version = F.coalesce(*[F.col(f"{n}.version") for n in
                           ("order_created", "payment_processed", "inventory_updated", "user_registered")])
    retries = F.coalesce(F.col("properties")["retryCount"].try_cast("int"), F.lit(0))
    ok = handler_ok if handler_ok is not None else F.lit(True)
    poison = (~F.col("decoded_ok") & (F.col("decode_error") != "UNKNOWN_TYPE")) | \
        schema_version_check(version).isNotNull()
    outcome = (F.when(poison, F.lit("dead_letter"))
               .when(ok | (F.col("decode_error") == "UNKNOWN_TYPE"), F.lit("ack"))
               .when(retries >= MAX_CONSUMER_RETRIES, F.lit("dead_letter"))
               .otherwise(F.lit("retry")))
    return d.select("id", "event_type", "payload", route(F.col("event_type")).alias("route"),
                    F.coalesce(F.col("decode_error"), schema_version_check(version)).alias("error"),
                    retries.alias("retry_count"), outcome.alias("outcome"))


def classify_handled(batch: DataFrame, registry: HandlerRegistry, folder: str | None = None) -> DataFrame:
    """R02 step with handlers: as ``classify_consumed``, where the outcome of a
    sound row is its handler's.  Poison rows reach no handler.  Returns (id,
    event_type, payload, route, error, retry_count, outcome)."""
    judged = classify_consumed(batch)
    sound = judged.where(F.col("outcome") != "dead_letter")
    done = registry.run(sound.select("id", "event_type", "payload"), folder=folder).select(
        F.col("id").alias("h_id"), F.col("ok"), F.col("error").alias("h_error"))
    failed = F.col("h_id").isNotNull() & ~F.col("ok")
    outcome = (F.when(~failed, F.col("outcome"))
               .when(F.col("retry_count") >= MAX_CONSUMER_RETRIES, F.lit("dead_letter")).otherwise(F.lit("retry")))
    return judged.join(done, F.col("id") == F.col("h_id"), "left").select(
        "id", "event_type", "payload", "route", F.when(failed, F.coalesce("h_error", F.lit("HANDLER_FAILED"))).otherwise(F.col("error")).alias("error"),
        "retry_count", outcome.alias("outcome"))


def handled_batch_writer(out_dir: str, registry: HandlerRegistry):
    """A ``foreachBatch`` function that runs the registry on each micro-batch and
    writes acked, retry and dead-letter rows to ``{out_dir}/{outcome}/batch_id={b}``."""
    def write(batch: DataFrame, batch_id: int):
        rows = batch.persist()
        c = classify_handled(rows, registry, f"{out_dir}/_routed/batch_id={batch_id}").persist()
        try:
            for outcome in ("ack", "retry", "dead_letter"):
                (c.where(F.col("outcome") == outcome).write.mode("overwrite")
                 .parquet(f"{out_dir}/{outcome}/batch_id={batch_id}"))
        finally:
            c.unpersist()
            rows.unpersist()
    return write


def consumer_batch_writer(out_dir: str, handler_ok=None):
    """A ``foreachBatch`` function writing acked, retry and dead-letter
    rows of each micro-batch to ``{out_dir}/{outcome}/batch_id={b}``."""
    def write(batch: DataFrame, batch_id: int):
        c = classify_consumed(batch, handler_ok).persist()
        try:
            for outcome in ("ack", "retry", "dead_letter"):
                (c.where(F.col("outcome") == outcome).write.mode("overwrite")
                 .parquet(f"{out_dir}/{outcome}/batch_id={batch_id}"))
        finally:
            c.unpersist()
    return write


def late_data_writer(out_dir: str, allowed_lateness_s: int, ts_col: str = "event_ts"):
    """Count and divert late rows.  A row is late when its event time is
    older than (highest event time of earlier batches - allowed lateness).
    The high-water mark is a one-row table per batch id, so a replayed batch
    reads the mark its first run read and rewrites the same output."""
    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        marks = f"{out_dir}/_marks"
        prev = None
        if batch_id > 0:
            try:
                prev = (spark.read.parquet(marks).where(F.col("batch_id") < batch_id)
                        .agg(F.max("mark")).first()[0])
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        limit = None if prev is None else F.lit(prev) - F.expr(f"INTERVAL {allowed_lateness_s} SECONDS")
        late = F.lit(False) if limit is None else F.col(ts_col) < limit
        tagged = batch.withColumn("late", late).persist()
        try:
            tagged.where("late").write.mode("overwrite").parquet(f"{out_dir}/late/batch_id={batch_id}")
            tagged.where("NOT late").write.mode("overwrite").parquet(f"{out_dir}/on_time/batch_id={batch_id}")
            (tagged.agg(F.max(ts_col).alias("mark")).withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").parquet(f"{marks}/b={batch_id}"))
        finally:
            tagged.unpersist()
    return write


def fan_out_writer(out_dir: str, subscribers: dict):
    """One stream, several subscribers — the micro-batch is persisted once
    and each subscriber's filter is written to its own folder."""
    def write(batch: DataFrame, batch_id: int):
        b = batch.persist()
        try:
            for name, cond in subscribers.items():
                b.where(cond).write.mode("overwrite").parquet(f"{out_dir}/{name}/batch_id={batch_id}")
        finally:
            b.unpersist()
    return write
