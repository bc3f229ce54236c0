"""Registered streaming queries.  Each stages Spark-derived inputs as files in
event-time order under the shared checkpoint folder, drains a Structured
Streaming query with ``availableNow`` and returns its result, which must equal
the batch twin (the SQL oracle is the batch query).

A far-future sentinel row ends each input so the final watermark releases all
windows, join rows and time-outs; it is filtered out of the results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.time import as_instant, as_ntz, plus_seconds, ts
from ..operators.handlers import HandlerRegistry, resolved_type
from ..sources import derive
from ..streaming import jobs as J
from ..streaming import late as LG
from ..streaming import stateful as ST
from ..streaming.progress import ProgressLog, checkpoint_status, committed, offset_gaps, progress
from ..streaming.runner import default_state_partitions, new_run_dir, read_output, run_foreach, run_to_parquet
from ..streaming.sources import read_event_stream, stage_in_order  # noqa: F401
from .catalog import Ctx, register
from .oracle import ORDER_EVENTS, OUTBOX, SAGA_EVENTS, SAGA_FULL, SAGA_WALK, TYPED_SRC, with_
from .q_events import SAGA_FOLD
from .q_projection import RM_ALL, RM_SELECT

SENTINEL_TS = "2100-01-01 00:00:00"
SLICES = 4


def _stage(c: Ctx, df, name: str, ts_col: str, tail=None):
    """Stage ``df`` (and a trailing sentinel) and open it as a file stream
    whose micro-batches are the event-time slices."""
    run = new_run_dir(c.spark, name)
    cap = stage_in_order(df, f"{run}/in", ts_col, SLICES, tail=tail)
    return run, read_event_stream(c.spark, f"{run}/in/*", df.schema, max_files=cap)


def _sentinel(df, **values):
    """One row with the columns of ``df``: ``values``, the rest null (also for an empty input)."""
    cols = [(F.lit(None) if f.name not in values else values[f.name] if isinstance(values[f.name], Column) else F.lit(values[f.name]))
            .cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.sparkSession.range(1).select(*cols)


@register("r03_streaming_projection", RM_ALL + RM_SELECT)
def r03(spark, sf_dir):
    """Streaming projection with the out-of-order buffer; redelivered
    Created arrive three days late and every 5th order's status change arrives
    before its Created.  Equals the batch projection as delivered."""
    c = Ctx(spark, sf_dir)
    ev = c.rich_events
    arrival = (F.when(F.col("seq") == 4, plus_seconds(F.col("occurred_at"), 3 * 86400))
               .when((F.col("seq") == 2) & (F.col("order_id") % 5 == 0),
                     plus_seconds(F.col("occurred_at"), -2 * 86400))
               .otherwise(F.col("occurred_at")))
    staged = ev.withColumn("arrival_ts", as_instant(arrival))
    sentinel = _sentinel(staged, order_id=-1, seq=0, event_type="Sentinel", occurred_at=ts(SENTINEL_TS), arrival_ts=as_instant(ts(SENTINEL_TS)))
    run, stream = _stage(c, staged, "r03", "arrival_ts", tail=sentinel)
    run_to_parquet(ST.project_stream(stream), f"{run}/out", f"{run}/ckpt",
                   state_partitions=default_state_partitions(spark))
    emitted = read_output(spark, f"{run}/out").where(F.col("order_id") >= 0)
    rm = ST.latest_rows(emitted)
    return rm.select("order_id", "customer_id", "total_amount", "currency", "item_count", "shipping_address",
                     "last_order_status", "cancellation_reason", "created_at", ts(c.now).alias("projected_at"),
                     "last_correlation_id")


@register("r03_streaming_skipped", with_(ORDER_EVENTS) + """
SELECT order_id, seq, event_type FROM order_events e
WHERE event_type <> 'OrderCreated' AND NOT EXISTS
  (SELECT 1 FROM order_events c WHERE c.order_id = e.order_id AND c.event_type = 'OrderCreated')""")
def r03b(spark, sf_dir):
    """Buffered events whose Created never arrived, emitted on time-out."""
    c = Ctx(spark, sf_dir)
    ev = c.rich_events.withColumn("arrival_ts", as_instant(F.col("occurred_at")))
    sentinel = _sentinel(ev, order_id=-1, seq=0, event_type="Sentinel", occurred_at=ts(SENTINEL_TS), arrival_ts=as_instant(ts(SENTINEL_TS)))
    run, stream = _stage(c, ev, "r03b", "arrival_ts", tail=sentinel)
    run_to_parquet(ST.project_stream(stream), f"{run}/out", f"{run}/ckpt",
                   state_partitions=default_state_partitions(spark))
    emitted = read_output(spark, f"{run}/out")
    return (emitted.where((F.col("kind") == "skipped") & (F.col("order_id") >= 0))
            .select("order_id", "seq", "event_type"))


@register("r07_streaming_saga", with_(SAGA_EVENTS).rstrip() + SAGA_FOLD
          + " SELECT order_id, state, reached, compensation FROM st")
def r07s(spark, sf_dir):
    """Saga state kept per order in streaming state; equals the batch fold."""
    c = Ctx(spark, sf_dir)
    ev = derive.saga_events(c.t("orders"))
    sentinel = _sentinel(ev, order_id=-1, event_type="Sentinel", ts=ts(SENTINEL_TS))
    run, stream = _stage(c, ev, "r07", "ts", tail=sentinel)
    run_to_parquet(ST.saga_stream(stream), f"{run}/out", f"{run}/ckpt",
                   state_partitions=default_state_partitions(spark))
    emitted = read_output(spark, f"{run}/out").where(F.col("order_id") >= 0)
    return ST.latest_saga(emitted).select("order_id", "state", "reached", "compensation")


@register("r07_streaming_machine", with_(SAGA_FULL).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + SAGA_WALK
          + "SELECT *, state NOT IN ('COMPLETED', 'FAILED') AS timed_out FROM saga_end")
def r07ms(spark, sf_dir):
    """The saga automaton in streaming state; equals the batch fold, and sagas
    that have not ended are timed out (the last input is far in the future)."""
    c = Ctx(spark, sf_dir)
    ev = derive.saga_events_with_compensation(c.t("orders"))
    run, stream = _stage(c, ev, "r07m", "ts", tail=_sentinel(ev, order_id=-1, event_type="Sentinel", ts=ts(SENTINEL_TS)))
    run_to_parquet(ST.saga_machine_stream(stream), f"{run}/out", f"{run}/ckpt", state_partitions=default_state_partitions(spark))
    return ST.latest_machine(read_output(spark, f"{run}/out").where(F.col("order_id") >= 0))


@register("r04_streaming_dedup", with_(OUTBOX) + "SELECT id, event_type FROM outbox")
def r04(spark, sf_dir):
    """Every 13th event is delivered twice (one hour apart); the 7-day
    streaming dedup keeps one copy of each.  Input: the S04 file stream source
    with a per-trigger cap (one file per micro-batch)."""
    c = Ctx(spark, sf_dir)
    log = c.outbox.select("id", "event_type", "status", as_instant(F.col("created_at")).alias("event_ts"))
    again = log.where(F.col("id") % 13 == 0).withColumn(
        "event_ts", F.col("event_ts") + F.expr("INTERVAL 1 HOUR"))
    run, stream = _stage(c, log.unionByName(again), "r04", "event_ts")
    run_to_parquet(J.dedup_stream(stream), f"{run}/out", f"{run}/ckpt",
                   state_partitions=default_state_partitions(spark))
    return read_output(spark, f"{run}/out").select("id", "event_type")


def _log_stream_input(c: Ctx):
    log = c.outbox.select("id", "status", as_instant(F.col("created_at")).alias("event_ts"))
    return log, _sentinel(log, id=-1, status="Sentinel", event_ts=as_instant(ts(SENTINEL_TS)))


@register("r05_streaming_per_minute", with_(OUTBOX) + """
SELECT date_trunc('minute', created_at) AS window_start, CAST(count(*) AS BIGINT) AS events,
  CAST(count(*) FILTER (WHERE status IN ('FAILED','DEAD_LETTER')) AS BIGINT) AS failures
FROM outbox GROUP BY 1""")
def r05s(spark, sf_dir):
    """Tumbling 1-minute throughput and failures, streaming (append mode)."""
    c = Ctx(spark, sf_dir)
    log, sentinel = _log_stream_input(c)
    run, stream = _stage(c, log, "r05", "event_ts", tail=sentinel)
    run_to_parquet(J.per_minute_stream(stream), f"{run}/out", f"{run}/ckpt",
                   state_partitions=default_state_partitions(spark))
    out = read_output(spark, f"{run}/out")
    return (out.where(F.col("window_start") < as_instant(ts(SENTINEL_TS)) - F.expr("INTERVAL 1 DAY"))
            .select(as_ntz(F.col("window_start")).alias("window_start"), "events", "failures"))


@register("j11_streaming_match", """
SELECT p.event_id AS id, c.event_id AS r_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
  ON p.user_id = c.user_id AND c.ts >= p.ts AND c.ts <= p.ts + INTERVAL 1 HOUR""")
def j11s(spark, sf_dir):
    """Stream-stream left outer join of purchases with clicks within one hour."""
    c = Ctx(spark, sf_dir)
    e = c.t("events").select("event_id", "user_id", "event_type", as_instant(F.col("ts")).alias("ets"))
    sentinel = _sentinel(e, event_id=-1, user_id=-1, event_type="sentinel", ets=as_instant(ts(SENTINEL_TS)))
    run, stream = _stage(c, e, "j11", "ets", tail=sentinel)
    purchases = stream.where(F.col("event_type").isin("purchase", "sentinel")).select(
        F.col("event_id").alias("p_id"), F.col("user_id").alias("p_user"), F.col("ets").alias("p_ts"))
    clicks = stream.where(F.col("event_type").isin("click", "sentinel")).select(
        F.col("event_id").alias("c_id"), F.col("user_id").alias("c_user"), F.col("ets").alias("c_ts"))
    run_to_parquet(J.match_payments_stream(purchases, clicks), f"{run}/out", f"{run}/ckpt",
                   state_partitions=default_state_partitions(spark))
    return read_output(spark, f"{run}/out").where(F.col("id") >= 0).select("id", F.col("r_id"))


def _payments(rows):
    """A payment handler that fails for amounts over 100."""
    amount = F.from_json(F.col("payload"), "amount DOUBLE")["amount"]
    small = F.coalesce(amount <= 100, F.lit(True))
    return rows.select("id", small.alias("ok"), F.when(~small, F.lit("amount over 100")).alias("error"))


def _orders(rows):
    return rows.select("id", F.lit(True).alias("ok"))


def _registry() -> HandlerRegistry:
    return HandlerRegistry().register(S.PAYMENT_PROCESSED, _payments, "payment").register(S.ORDER_CREATED, _orders, "order")


@register("handlers_routed", with_(TYPED_SRC) + """
SELECT id, CASE t WHEN 'PaymentProcessed' THEN 'payment' WHEN 'OrderCreated' THEN 'order' ELSE 'default' END AS route,
  NOT (t = 'PaymentProcessed' AND NOT broken AND value > 100) AS ok,
  CASE WHEN t = 'PaymentProcessed' AND NOT broken AND value > 100 THEN 'amount over 100' END AS error
FROM (SELECT *, CASE WHEN has_props THEN event_type WHEN broken OR event_type = 'Mystery' THEN 'Unknown'
                     ELSE event_type END AS t FROM typed_src)""")
def handlers(spark, sf_dir):
    """Handler registry: two handlers and the default branch in one
    routed pass; the type is the message property, else the payload's own field."""
    t = derive.typed_events(Ctx(spark, sf_dir).t("events"))
    named = t.select("id", "payload", resolved_type(F.col("properties"), F.col("payload")).alias("event_type"))
    return _registry().run(named)


@register("r02_consumer_outcomes", with_(TYPED_SRC) + """
SELECT id, CASE event_type WHEN 'OrderCreated' THEN 'order' WHEN 'PaymentProcessed' THEN 'payment'
  WHEN 'InventoryUpdated' THEN 'inventory' WHEN 'UserRegistered' THEN 'user' ELSE 'unknown' END AS route,
  CASE WHEN broken AND event_type <> 'Mystery' THEN 'dead_letter'
       WHEN event_type <> 'Mystery' AND version NOT IN ('1','1.0','2','2.0') THEN 'dead_letter'
       WHEN event_type = 'Mystery' OR NOT (event_type = 'PaymentProcessed' AND value > 100) THEN 'ack'
       WHEN (CASE WHEN has_props THEN id % 4 ELSE 0 END) >= 3 THEN 'dead_letter'
       ELSE 'retry' END AS outcome FROM typed_src""")
def r02(spark, sf_dir):
    """Consume -> decode -> route -> ack / retry / dead-letter with
    idempotent per-batch writes; the payment handler fails for amounts over 100."""
    c = Ctx(spark, sf_dir)
    t = derive.typed_events(c.t("events")).withColumn("event_ts", as_instant(F.col("ts")))
    run, stream = _stage(c, t, "r02", "event_ts")
    run_foreach(stream, J.handled_batch_writer(f"{run}/out", _registry()), f"{run}/ckpt")
    parts = [read_output(spark, f"{run}/out/{o}") for o in ("ack", "retry", "dead_letter")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("id", "route", "outcome")


@register("r06_streaming_sliding", with_(OUTBOX).rstrip() + """,
sw AS (SELECT date_trunc('minute', created_at) - INTERVAL 1 MINUTE * o AS window_start,
  CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE status IN ('FAILED','DEAD_LETTER')) AS BIGINT) AS f,
  round(count(*) FILTER (WHERE status IN ('FAILED','DEAD_LETTER')) / count(*), 6) AS rate
  FROM outbox, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY 1)
SELECT window_start, n, f, rate FROM sw""")
def r06s(spark, sf_dir):
    """Failure rate over 5-minute windows sliding by 1 minute, streaming."""
    c = Ctx(spark, sf_dir)
    log, sentinel = _log_stream_input(c)
    run, stream = _stage(c, log, "r06", "event_ts", tail=sentinel)
    run_to_parquet(J.sliding_rate_stream(stream), f"{run}/out", f"{run}/ckpt",
                   state_partitions=default_state_partitions(spark))
    out = read_output(spark, f"{run}/out")
    return (out.where(F.col("window_start") < as_instant(ts("2099-01-01 00:00:00")))
            .select(as_ntz(F.col("window_start")).alias("window_start"), "n", "f", "rate"))


@register("s12_fan_out", with_(OUTBOX) + """
SELECT 'alerts' AS subscriber, CAST(count(*) FILTER (WHERE status IN ('FAILED','DEAD_LETTER')) AS BIGINT) AS n
FROM outbox
UNION ALL SELECT 'audit', CAST(count(*) AS BIGINT) FROM outbox
UNION ALL SELECT 'orders', CAST(count(*) FILTER (WHERE event_type = 'OrderCreated') AS BIGINT) FROM outbox""")
def s12(spark, sf_dir):
    """One stream fanned out to three subscribers (alerts, audit, orders)."""
    c = Ctx(spark, sf_dir)
    log = c.outbox.select("id", "status", "event_type", as_instant(F.col("created_at")).alias("event_ts"))
    run, stream = _stage(c, log, "s12", "event_ts")
    subs = {"alerts": F.col("status").isin("FAILED", "DEAD_LETTER"), "audit": F.lit(True),
            "orders": F.col("event_type") == "OrderCreated"}
    run_foreach(stream, J.fan_out_writer(f"{run}/out", subs), f"{run}/ckpt")
    parts = [read_output(spark, f"{run}/out/{name}").agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(name).alias("subscriber"), "n") for name in subs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("s10_stream_progress", "SELECT CAST(count(*) AS BIGINT) AS input_rows FROM events")
def s10(spark, sf_dir):
    """Rows read across all micro-batches of a drained stream, from the progress table."""
    c = Ctx(spark, sf_dir)
    e = c.t("events").select("event_id", as_instant(F.col("ts")).alias("event_ts"))
    run, stream = _stage(c, e, "s10", "event_ts")
    with ProgressLog(spark, f"{run}/progress"):
        run_to_parquet(stream, f"{run}/out", f"{run}/ckpt", state_partitions=default_state_partitions(spark))
    return progress(spark, f"{run}/progress").agg(F.sum("input_rows").cast("bigint").alias("input_rows"))


@register("s10_checkpoint_status", """
SELECT source_no, CAST(count(*) AS BIGINT) AS input_rows, true AS done, false AS behind, CAST(0 AS BIGINT) AS gaps
FROM (SELECT CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS source_no FROM events) GROUP BY 1""")
def s10_status(spark, sf_dir):
    """Checkpoint status per source of a stream that reads two: rows up to the last
    offset, nothing behind it, no gap between the offsets of one batch and the next,
    and every batch of the checkpoint committed."""
    c = Ctx(spark, sf_dir)
    e = c.t("events").select("event_id", "event_type", as_instant(F.col("ts")).alias("event_ts"))
    run, one = _stage(c, e.where("event_type = 'purchase'"), "s10a", "event_ts")
    _, two = _stage(c, e.where("event_type <> 'purchase' OR event_type IS NULL"), "s10b", "event_ts")
    with ProgressLog(spark, f"{run}/progress"):
        run_to_parquet(one.unionByName(two), f"{run}/out", f"{run}/ckpt", state_partitions=default_state_partitions(spark))
    reports = progress(spark, f"{run}/progress")
    done = committed(spark, f"{run}/ckpt").agg(F.bool_and("done")).scalar()
    gaps = offset_gaps(reports).agg(F.count(F.lit(1))).scalar()
    return checkpoint_status(reports).select("source_no", "input_rows", done.alias("done"), "behind", gaps.alias("gaps"))


@register("r10_late_data")
def r10(spark, sf_dir):
    """Every 50th event is redelivered three days late as a new event;
    rows older than the previous batches' high-water mark minus one hour are
    counted and diverted.  Stateful across batches: rows-only check."""
    c = Ctx(spark, sf_dir)
    log = c.outbox.select("id", "status", as_instant(F.col("created_at")).alias("event_ts"))
    late = (c.outbox.where(F.col("id") % 50 == 0)
            .select((F.col("id") + 1_000_000_000).alias("id"), "status",
                    as_instant(F.col("created_at")).alias("event_ts"),
                    as_instant(plus_seconds(F.col("created_at"), 3 * 86400)).alias("arrival_ts")))
    staged = log.withColumn("arrival_ts", F.col("event_ts")).unionByName(late)
    run, stream = _stage(c, staged, "r10", "arrival_ts")
    run_foreach(stream, J.late_data_writer(f"{run}/out", allowed_lateness_s=3600), f"{run}/ckpt")
    late_rows = read_output(spark, f"{run}/out/late").select("id", F.lit(True).alias("late"))
    on_time = read_output(spark, f"{run}/out/on_time").select("id", F.lit(False).alias("late"))
    return late_rows.unionByName(on_time)


@register("r10_all_watermarks", """
SELECT op, CAST((SELECT count(*) + count(*) FILTER (WHERE event_id % 50 = 0) + 1 FROM events) AS BIGINT) AS arrived, true AS balanced, true AS counted,
  CAST(0 AS BIGINT) AS engine_dropped FROM (SELECT unnest(['R04', 'R05', 'R06', 'J11']) AS op)""")
def r10_all(spark, sf_dir):
    """R10 for every watermark: every 50th event arrives again three days late, as a new
    one.  Late rows are taken out in front of four stateful queries; what arrived is
    what was kept plus what was late, each query accounts for every row that was kept,
    and its own watermark drops none."""
    c = Ctx(spark, sf_dir)
    row = ["id", "status", "user_id", "event_type", "event_ts"]
    e = c.t("events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 0, S.FAILED).otherwise(S.PUBLISHED).alias("status"), "user_id", "event_type",
                             as_instant(F.col("ts")).alias("event_ts"), as_instant(F.col("ts")).alias("arrival_ts"))
    again = e.where(F.col("id") % 50 == 0).withColumns({"id": F.col("id") + 1_000_000_000, "arrival_ts": F.col("arrival_ts") + F.expr("INTERVAL 3 DAYS")})
    far = as_instant(ts(SENTINEL_TS))
    staged = e.unionByName(again)
    run, stream = _stage(c, staged, "r10all", "arrival_ts", tail=_sentinel(staged, id=-1, user_id=-1, status="Sentinel", event_type="sentinel", event_ts=far, arrival_ts=far))
    with ProgressLog(spark, f"{run}/gate-progress"):
        run_foreach(LG.observed(stream.select(*row)), LG.gate_writer(f"{run}/gate", 3600), f"{run}/gate-ckpt")
    schema = stream.select(*row).schema
    passed = LG.on_time(spark, f"{run}/gate", schema)
    kept = spark.read.schema(schema).parquet(f"{run}/gate/on_time").where("id >= 0")
    purchases = passed.where(F.col("event_type").isin("purchase", "sentinel")).select(F.col("id").alias("p_id"), F.col("user_id").alias("p_user"), F.col("event_ts").alias("p_ts"))
    clicks = passed.where(F.col("event_type").isin("click", "sentinel")).select(F.col("id").alias("c_id"), F.col("user_id").alias("c_user"), F.col("event_ts").alias("c_ts"))
    before = as_instant(ts("2099-01-01 00:00:00"))
    jobs = {"R04": (J.dedup_stream(passed, horizon="1 hour"), lambda o: o.where("id >= 0").agg(F.count(F.lit(1)).alias("x")), kept, 1),
            "R05": (J.per_minute_stream(passed, delay="1 hour"), lambda o: o.where(F.col("window_start") < before).agg(F.sum("events").alias("x")), kept, 1),
            "R06": (J.sliding_rate_stream(passed, delay="1 hour"), lambda o: o.where(F.col("window_start") < before).agg(F.sum("n").alias("x")), kept, 5),
            "J11": (J.match_payments_stream(purchases, clicks), lambda o: o.where("id >= 0").agg(F.countDistinct("id").alias("x")), kept.where("event_type = 'purchase'"), 1)}
    out = None
    for op, (job, measure, rows, times) in jobs.items():
        with ProgressLog(spark, f"{run}/{op}-progress"):
            run_to_parquet(job, f"{run}/{op}", f"{run}/{op}-ckpt", state_partitions=default_state_partitions(spark))
        have, want = measure(read_output(spark, f"{run}/{op}")).scalar(), rows.agg(F.count(F.lit(1))).scalar()
        one = LG.balance(spark, f"{run}/gate", schema, f"{run}/gate-progress").select(
            F.lit(op).alias("op"), "arrived", (F.col("balanced") & (F.col("late") > 0)).alias("balanced"), (have == want * times).alias("counted"),
            LG.engine_dropped(spark, f"{run}/{op}-progress").scalar().cast("bigint").alias("engine_dropped"))
        out = one if out is None else out.unionByName(one)
    return out
