"""Registered monitoring and business-metric queries (A10, A11, A16-A23, A25,
W10-W12, R05, R06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.time import as_instant
from ..operators import alerts
from ..operators import metrics as MX
from ..streaming.runner import default_state_partitions, new_run_dir, read_output, run_foreach
from ..streaming.sources import read_event_stream, stage_in_order
from .catalog import Ctx, register
from .oracle import CALL_LOG, NOW_SQL, ORDER_ITEMS, ORDERS_MODEL, OUTBOX, TYPED_SRC, with_

OB = with_(OUTBOX)
CL = with_(CALL_LOG)

PROC = "(SELECT date_sub('second', created_at, published_at) AS secs FROM outbox WHERE status='PUBLISHED')"


@register("a10_hot_partitions", OB + """
SELECT event_type AS key, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
  round(count(*) / sum(count(*)) OVER (), 6) AS share, round(count(*) / sum(count(*)) OVER (), 6) >= 0.2 AS is_hot
FROM outbox GROUP BY event_type""")
def a10(spark, sf_dir):
    """A10: share of events per key (event type) with a hot flag at 20 %."""
    c = Ctx(spark, sf_dir)
    return MX.key_shares(c.outbox, F.col("event_type"), threshold=0.2)


@register("a11_latency_percentiles", OB + f"""
SELECT round(quantile_cont(secs, 0.5), 6) AS p50, round(quantile_cont(secs, 0.95), 6) AS p95,
  round(quantile_cont(secs, 0.99), 6) AS p99 FROM {PROC}""")
def a11(spark, sf_dir):
    """Exact latency percentiles (creation -> publish, whole seconds)."""
    return MX.latency_percentiles(Ctx(spark, sf_dir).outbox)


@register("a16_payload_size_percentiles", OB + """
SELECT round(quantile_cont(strlen(payload), 0.5), 6) AS p50, round(quantile_cont(strlen(payload), 0.95), 6) AS p95,
  round(quantile_cont(strlen(payload), 0.99), 6) AS p99 FROM outbox""")
def a16(spark, sf_dir):
    """Payload size percentiles in bytes."""
    return MX.payload_size_percentiles(Ctx(spark, sf_dir).outbox)


@register("a16_bytes_per_second", OB + """
SELECT max(b) AS max_bytes_per_s, round(avg(b), 6) AS avg_bytes_per_s,
  CAST(count(*) FILTER (WHERE b > 1048576) AS BIGINT) AS seconds_over_capacity,
  CAST(count(*) AS BIGINT) AS active_seconds
FROM (SELECT date_trunc('second', created_at) AS s, CAST(sum(strlen(payload)) AS BIGINT) AS b
      FROM outbox GROUP BY 1)""")
def a16b(spark, sf_dir):
    """Bytes per second against the 1 MB/s bus capacity."""
    return MX.bytes_per_second(Ctx(spark, sf_dir).outbox)


@register("a25_latency_histogram", OB + f"""
SELECT CAST(CASE WHEN secs < 0 THEN 0 WHEN secs >= 600 THEN 11 ELSE floor(secs / 60) + 1 END AS BIGINT) AS bucket,
  CAST(count(*) AS BIGINT) AS n FROM {PROC} GROUP BY 1""")
def a25(spark, sf_dir):
    """Processing-time histogram, 10 buckets over 0-600 s."""
    return MX.latency_histogram(Ctx(spark, sf_dir).outbox)


@register("a23_errors_by_type", OB + """
SELECT regexp_replace(error_message, '^Max retries exceeded: ', '') AS error_class, status,
  CAST(count(*) AS BIGINT) AS n FROM outbox WHERE error_message IS NOT NULL GROUP BY 1, 2""")
def a23(spark, sf_dir):
    """Failures by error class."""
    return MX.error_classes(Ctx(spark, sf_dir).outbox)


@register("a21_alerts", OB + f""",
m AS (SELECT CAST(count(*) FILTER (WHERE status='PENDING') AS DOUBLE) AS backlog,
  round(count(*) FILTER (WHERE status IN ('FAILED','DEAD_LETTER')) * 100.0 / count(*), 6) AS failure_rate_pct,
  CAST(count(*) FILTER (WHERE status='DEAD_LETTER') AS DOUBLE) AS dead_letter,
  CAST(date_sub('second', min(created_at) FILTER (WHERE status='PENDING'), {NOW_SQL}) AS DOUBLE) AS lag_seconds,
  CAST(count(*) AS DOUBLE) AS table_rows FROM outbox),
p AS (SELECT round(quantile_cont(secs, 0.95), 6) AS p95 FROM {PROC})
SELECT metric, value, threshold, value > threshold AS firing FROM (
  SELECT 'backlog' AS metric, backlog AS value, 10000.0::DOUBLE AS threshold FROM m
  UNION ALL SELECT 'failure_rate_pct', failure_rate_pct, 10.0 FROM m
  UNION ALL SELECT 'dead_letter', dead_letter, 100.0 FROM m
  UNION ALL SELECT 'lag_seconds', lag_seconds, 60.0 FROM m
  UNION ALL SELECT 'table_rows', table_rows, 100000.0 FROM m
  UNION ALL SELECT 'p95_processing_seconds', p95, 5.0 FROM p)""")
def a21(spark, sf_dir):
    """Alert rules evaluated on the metric table."""
    c = Ctx(spark, sf_dir)
    return MX.evaluate_alerts(c.outbox, c.now)


@register("a22_consumer_lag", OB + """
SELECT p, CAST(max(seq) AS BIGINT) AS latest_seq,
  CAST(coalesce(max(seq) FILTER (WHERE done), 0) AS BIGINT) AS checkpoint_seq,
  CAST(max(seq) - coalesce(max(seq) FILTER (WHERE done), 0) AS BIGINT) AS lag_events,
  round(date_sub('second', max(created_at) FILTER (WHERE done), max(created_at)) / 60.0, 6) AS lag_minutes
FROM (SELECT id % 4 AS p, created_at, status='PUBLISHED' AS done,
        row_number() OVER (PARTITION BY id % 4 ORDER BY created_at, id) AS seq FROM outbox) GROUP BY p""")
def a22(spark, sf_dir):
    """Consumer lag per partition (4 partitions by id; committed = PUBLISHED)."""
    c = Ctx(spark, sf_dir)
    s = c.outbox.withColumn("p", F.col("id") % 4)
    return MX.consumer_lag(s, "p", ["created_at", "id"], F.col("status") == "PUBLISHED")


@register("w10_rolling_failure_rate", CL + """
SELECT target, id, ts, n, failure_rate FROM (
  SELECT target, id, ts, count(*) OVER w AS n,
    round(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER w / count(*) OVER w, 6) AS failure_rate
  FROM call_log WINDOW w AS (PARTITION BY target ORDER BY ts, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
WHERE n >= 5 AND failure_rate >= 0.5""")
def w10(spark, sf_dir):
    """Breaker check — failure rate over the last 10 calls >= 50 % with >= 5 calls."""
    r = MX.rolling_call_rates(Ctx(spark, sf_dir).call_log)
    return r.where("breach").select("target", "id", "ts", "n", "failure_rate")


@register("w11_rate_limit_excess", CL + """
SELECT target, id, ts FROM (SELECT target, id, ts, row_number() OVER
  (PARTITION BY target, date_trunc('hour', ts) ORDER BY ts, id) AS pos FROM call_log) WHERE pos > 5""")
def w11(spark, sf_dir):
    """Calls beyond 5 per (target, hour) (the test events are sparse)."""
    return MX.rate_limit_excess(Ctx(spark, sf_dir).call_log, 5, "hour").select("target", "id", "ts")


@register("w12_concurrency_peaks", CL + """
SELECT target, CAST(max(active) AS BIGINT) AS peak, max(active) > 5 AS over_limit FROM (
  SELECT target, sum(delta) OVER (PARTITION BY target ORDER BY t, delta, id ROWS UNBOUNDED PRECEDING) AS active
  FROM (SELECT target, ts AS t, 1 AS delta, id FROM call_log
        UNION ALL SELECT target, ts + INTERVAL 1 SECOND * dur_ms, -1, id FROM call_log)) GROUP BY target""")
def w12(spark, sf_dir):
    """Concurrency sweep per target vs a limit of 5 (durations read in
    seconds for the sparse test log)."""
    r = MX.concurrency_peaks(Ctx(spark, sf_dir).call_log, limit=5, unit_seconds=1.0)
    return r.withColumn("peak", F.col("peak").cast("bigint"))


@register("a19_sla_report", CL + """
SELECT target AS operation, CASE WHEN failed THEN 'ERROR' ELSE 'OK' END AS status,
  CAST(count(*) AS BIGINT) AS n, round(avg(dur_ms), 6) AS avg_ms,
  round(avg(CASE WHEN dur_ms > 2000 THEN 1.0 ELSE 0.0 END), 6) AS breach_share FROM call_log GROUP BY 1, 2""")
def a19(spark, sf_dir):
    """SLA report per (operation, status) with breach share over 2 s."""
    return MX.sla_report(Ctx(spark, sf_dir).call_log)


@register("r05_per_minute_batch", OB + """
SELECT date_trunc('minute', created_at) AS window_start, CAST(count(*) AS BIGINT) AS events,
  CAST(count(*) FILTER (WHERE status IN ('FAILED','DEAD_LETTER')) AS BIGINT) AS failures
FROM outbox GROUP BY 1""")
def r05(spark, sf_dir):
    """R05 (batch twin): events and failures per minute."""
    return MX.per_minute(Ctx(spark, sf_dir).outbox)


SLIDE_SQL = """sw AS (SELECT date_trunc('minute', created_at) - INTERVAL 1 MINUTE * o AS window_start,
  CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE status IN ('FAILED','DEAD_LETTER')) AS BIGINT) AS f,
  round(count(*) FILTER (WHERE status IN ('FAILED','DEAD_LETTER')) / count(*), 6) AS rate
  FROM outbox, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY 1)"""


@register("r06_sliding_failure_rate", OB.rstrip() + ", " + SLIDE_SQL + """
SELECT window_start, n, f, rate FROM sw""")
def r06(spark, sf_dir):
    """R06 (batch twin): failure rate per 5-minute window sliding by 1 minute."""
    return MX.sliding_failure_rate(Ctx(spark, sf_dir).outbox)


@register("r06_sustained_breaches", OB.rstrip() + ", " + SLIDE_SQL + """,
b AS (SELECT *, CAST(epoch(window_start) // 60 AS BIGINT) AS k FROM sw WHERE rate > 0.25),
r AS (SELECT *, k - row_number() OVER (ORDER BY k) AS island FROM b)
SELECT window_start, n, f, rate, CAST(k - min(k) OVER (PARTITION BY island) + 1 AS BIGINT) AS run FROM r
QUALIFY k - min(k) OVER (PARTITION BY island) + 1 >= 3""")
def r06b(spark, sf_dir):
    """R06 (batch twin): windows whose failure rate stayed above 25 % for 3+ consecutive windows."""
    rates = MX.sliding_failure_rate(Ctx(spark, sf_dir).outbox)
    return MX.sustained_breaches(rates, 0.25, sustain=3)


# -- business metrics --------------------------------------------------------

@register("a17_orders_by_status_channel", with_(ORDERS_MODEL) + """
SELECT status, CASE customer_id % 3 WHEN 0 THEN 'WEB' WHEN 1 THEN 'MOBILE' ELSE 'API' END AS channel,
  CAST(count(*) AS BIGINT) AS n FROM orders_model GROUP BY 1, 2""")
def a17(spark, sf_dir):
    """Orders by (status, channel); channel derived from the customer key."""
    om = Ctx(spark, sf_dir).orders_model
    ch = F.when(F.col("customer_id") % 3 == 0, "WEB").when(F.col("customer_id") % 3 == 1, "MOBILE").otherwise("API")
    return om.groupBy("status", ch.alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@register("a17_value_by_currency", with_(ORDERS_MODEL) + """
SELECT currency, CAST(count(*) AS BIGINT) AS n, CAST(sum(total_amount) AS DOUBLE) AS total,
  CAST(max(total_amount) AS DOUBLE) AS max_amount, CAST(min(item_count) AS INT) AS min_items,
  CAST(max(item_count) AS INT) AS max_items, CAST(sum(item_count) AS BIGINT) AS items
FROM orders_model GROUP BY 1""")
def a17b(spark, sf_dir):
    """Order value and item summary by currency (exact decimal sums)."""
    om = Ctx(spark, sf_dir).orders_model
    return om.groupBy("currency").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_amount").cast("double").alias("total"),
        F.max("total_amount").cast("double").alias("max_amount"),
        F.min("item_count").alias("min_items"), F.max("item_count").alias("max_items"),
        F.sum("item_count").cast("bigint").alias("items"))


@register("a17_fulfilment_by_priority", """
SELECT o.o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(date_diff('day', o.o_orderdate, s.last_ship)) AS BIGINT) AS total_days,
  CAST(max(date_diff('day', o.o_orderdate, s.last_ship)) AS BIGINT) AS max_days
FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) s
  ON o.o_orderkey = s.l_orderkey GROUP BY 1""")
def a17c(spark, sf_dir):
    """Fulfilment time (order date -> last ship date, days) by priority."""
    c = Ctx(spark, sf_dir)
    ship = c.t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    o = c.t("orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    days = F.datediff(F.to_date("last_ship"), F.to_date("o_orderdate"))
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(days).cast("bigint").alias("total_days"),
        F.max(days).cast("bigint").alias("max_days"))


@register("a18_payment_metrics", with_(TYPED_SRC) + """
SELECT currency, CASE id % 3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'PAYPAL' ELSE 'BANK' END AS method,
  CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE value <= 100) AS BIGINT) AS succeeded,
  CAST(count(*) FILTER (WHERE value > 100) AS BIGINT) AS failed,
  CAST(sum(CAST(value AS DECIMAL(19,2))) AS DOUBLE) AS amount
FROM typed_src WHERE event_type='PaymentProcessed' AND NOT broken GROUP BY 1, 2""")
def a18(spark, sf_dir):
    """Payment success / failure and amount by (currency, method), decoded payloads."""
    from ..functions.codec import decode
    from ..sources.derive import typed_events
    d = decode(typed_events(Ctx(spark, sf_dir).t("events")))
    p = d.where(F.col("payment_processed").isNotNull() & F.col("decoded_ok")).select("payment_processed.*")
    return p.groupBy("currency", F.col("paymentMethod").alias("method")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("paymentStatus") == "SUCCESS").alias("succeeded"),
        F.count_if(F.col("paymentStatus") == "FAILED").alias("failed"),
        F.sum(F.col("amount").cast("decimal(19,2)")).cast("double").alias("amount"))


@register("a20_stock_decrement", with_(ORDER_ITEMS) + """
SELECT p.p_partkey AS part_id, CAST(p.p_size * 500 AS BIGINT) AS opening,
  CAST(coalesce(d.demand, 0) AS DOUBLE) AS demand,
  CAST(p.p_size * 500 - coalesce(d.demand, 0) AS DOUBLE) AS remaining,
  p.p_size * 500 - coalesce(d.demand, 0) < 0 AS short
FROM part p LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS demand FROM lineitem GROUP BY 1) d
  ON p.p_partkey = d.l_partkey""")
def a20(spark, sf_dir):
    """Stock per part after order items are taken (opening = size x 500)."""
    c = Ctx(spark, sf_dir)
    demand = c.t("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("demand"))
    p = c.t("part").join(demand, F.col("p_partkey") == F.col("l_partkey"), "left")
    opening = (F.col("p_size") * 500).cast("bigint")
    rem = opening - F.coalesce(F.col("demand"), F.lit(0.0))
    return p.select(F.col("p_partkey").alias("part_id"), opening.alias("opening"),
                    F.coalesce(F.col("demand"), F.lit(0.0)).cast("double").alias("demand"),
                    rem.cast("double").alias("remaining"), (rem < 0).alias("short"))


#: The service's rules with thresholds that the test log reaches.
ALERT_RULES_TEST = (alerts.Rule("HighBacklog", "pending", 100, 5), alerts.Rule("VeryHighBacklog", "pending", 800, 5),
                    alerts.Rule("HighFailureRate", "failed_per_second", 0.006, 2), alerts.Rule("CircuitBreakerOpen", "breaker_open", 1, 1, at_least=True))

ALERT_STATES = OB.rstrip() + "," + CALL_LOG.strip() + """,
ends AS (SELECT date_trunc('minute', min(created_at)) AS lo, date_trunc('minute', max(created_at)) AS hi FROM outbox),
g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS minute FROM ends),
acts AS (SELECT date_trunc('minute', created_at) AS minute, status IN ('PENDING', 'PROCESSING', 'PUBLISHED') AS c, false AS s,
    status IN ('FAILED', 'DEAD_LETTER') AS f, false AS k, false AS kf FROM outbox
  UNION ALL SELECT date_trunc('minute', published_at), false, true, false, false, false FROM outbox WHERE status = 'PUBLISHED'
  UNION ALL SELECT date_trunc('minute', ts), false, false, false, true, failed FROM call_log),
n AS (SELECT g.minute, count(*) FILTER (WHERE c) - count(*) FILTER (WHERE s) AS net, count(*) FILTER (WHERE f) AS f,
    count(*) FILTER (WHERE k) AS k, count(*) FILTER (WHERE kf) AS kf FROM g LEFT JOIN acts a ON a.minute = g.minute GROUP BY 1),
w AS (SELECT minute, CAST(sum(net) OVER (ORDER BY minute) AS DOUBLE) AS pending,
    sum(f) OVER (ORDER BY minute ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 300.0 AS rate, k > 0 AND kf * 2 >= k AS opened FROM n),
t AS (SELECT 'HighBacklog' AS rule, minute, pending > 100 AS true_, 5 AS wait FROM w UNION ALL SELECT 'VeryHighBacklog', minute, pending > 800, 5 FROM w
  UNION ALL SELECT 'HighFailureRate', minute, rate > 0.006, 2 FROM w UNION ALL SELECT 'CircuitBreakerOpen', minute, opened, 1 FROM w),
u AS (SELECT *, coalesce(max(CASE WHEN NOT true_ THEN minute END) OVER (PARTITION BY rule ORDER BY minute), lo - INTERVAL 1 MINUTE) + INTERVAL 1 MINUTE AS since
  FROM t, ends),
x AS (SELECT *, true_ AND minute - since >= INTERVAL 1 MINUTE * wait AS firing FROM u),
y AS (SELECT rule, minute, since, true_, CASE WHEN firing THEN 'firing' WHEN true_ THEN 'pending'
    WHEN coalesce(lag(firing) OVER (PARTITION BY rule ORDER BY minute), false) THEN 'resolved' ELSE 'inactive' END AS state FROM x),
z AS (SELECT *, lag(state) OVER (PARTITION BY rule ORDER BY minute) AS before FROM y)
SELECT rule, minute, state, CASE WHEN true_ THEN since END AS since FROM z WHERE state <> coalesce(before, 'inactive')"""


def _alert_span(log):
    ends = log.agg(F.date_trunc("minute", F.min("created_at")).cast("timestamp_ntz").alias("lo"), F.date_trunc("minute", F.max("created_at")).cast("timestamp_ntz").alias("hi"))
    return ends.first()


@register("a21_alert_states", ALERT_STATES)
def a21_states(spark, sf_dir):
    """A21 over time: changes of state of rules with ``for`` on every minute of the log."""
    c = Ctx(spark, sf_dir)
    log = c.outbox
    span = _alert_span(log)
    minutes = alerts.grid(span.lo, span.hi, spark)
    return alerts.transitions(alerts.states(alerts.metrics(alerts.minute_counts(log, c.call_log), minutes), ALERT_RULES_TEST))


@register("a21_streaming_alerts", ALERT_STATES)
def a21_stream(spark, sf_dir):
    """A21 over time, as a stream of what happened to the log: equals the batch form."""
    c = Ctx(spark, sf_dir)
    log, calls = c.outbox, c.call_log
    span = _alert_span(log)
    kind = F.when(F.col("status").isin(S.FAILED, S.DEAD_LETTER), "failed").otherwise("created")
    acts = (log.select(as_instant(F.col("created_at")).alias("event_ts"), kind.alias("kind"))
            .unionByName(log.where(F.col("status") == S.PUBLISHED).select(as_instant(F.col("published_at")).alias("event_ts"), F.lit("settled").alias("kind")))
            .unionByName(calls.select(as_instant(F.col("ts")).alias("event_ts"), F.when(F.col("failed"), "call_failed").otherwise("call").alias("kind"))))
    run = new_run_dir(spark, "alerts")
    tail = spark.range(1).select(as_instant(F.lit(span.hi) + F.expr("INTERVAL 1 DAY")).alias("event_ts"), F.lit("end").alias("kind"))
    cap = stage_in_order(acts, f"{run}/in", "event_ts", 3, tail=tail)
    stream = read_event_stream(spark, f"{run}/in/*", acts.schema, max_files=cap)
    run_foreach(alerts.minute_stream(stream), alerts.alert_writer(f"{run}/out", span.lo, ALERT_RULES_TEST, until=span.hi), f"{run}/ckpt",
                state_partitions=default_state_partitions(spark))
    return alerts.transitions(read_output(spark, f"{run}/out/states").drop("batch_id"))
