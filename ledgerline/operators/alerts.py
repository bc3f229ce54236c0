"""A21 over time: alert rules with ``for``, on a dense grid of minutes.

A rule is true at a minute if its metric is above (or equal to) the threshold.  It is
``pending`` from the first minute of a stretch of true ones, ``firing`` once the stretch
has lasted ``for_minutes``, ``resolved`` at the first false minute after firing, else
``inactive``.  The time since when a rule is true is its last false minute plus one, a
prefix maximum, so a long history is cut by time over many tasks.  The streaming form
takes minutes as their watermark passes, carries one row per rule from batch to batch,
and gives the same states.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import ensure_checkpoint_dir
from .ordering import running_max, running_sum, with_neighbour

INACTIVE, PENDING, FIRING, RESOLVED = "inactive", "pending", "firing", "resolved"
RATE_MINUTES = 5


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    threshold: float
    for_minutes: int
    at_least: bool = False  # >= instead of >


# The alert rules of the service.
RULES = (Rule("HighBacklog", "pending", 10_000, 5), Rule("HighFailureRate", "failed_per_second", 10, 5),
         Rule("CircuitBreakerOpen", "breaker_open", 1, 1, at_least=True))


def grid(first, last, spark: SparkSession) -> DataFrame:
    """(minute) of every minute from ``first`` to ``last`` (timestamps without a zone)."""
    ends = [F.date_trunc("minute", F.lit(str(x)).cast("timestamp_ntz")).cast("timestamp_ntz") for x in (first, last)]
    return spark.range(1).select(F.explode(F.sequence(*ends, F.expr("INTERVAL 1 MINUTE"))).alias("minute"))


def _minute(col: str):
    return F.date_trunc("minute", F.col(col)).cast("timestamp_ntz")


def minute_counts(log: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(minute, created, settled, failed, calls, call_failures) where anything happened.

    ``settled``: rows published in the minute; ``failed``: rows that are FAILED or
    DEAD_LETTER, at the minute they were made.  ``calls``: (ts, failed) of a downstream target.
    The counts (one row per minute) are read several times, so they are pinned once."""
    def part(rows: DataFrame, at: str, **counts):
        return rows.where(F.col(at).isNotNull()).groupBy(_minute(at).alias("minute")).agg(*[c.alias(n) for n, c in counts.items()])

    one = F.count(F.lit(1))
    parts = [part(log.where(F.col("status").isin(S.PENDING, S.PROCESSING, S.PUBLISHED)), "created_at", created=one),
             part(log.where(F.col("status") == S.PUBLISHED), "published_at", settled=one),
             part(log.where(F.col("status").isin(S.FAILED, S.DEAD_LETTER)), "created_at", failed=one)]
    if calls is not None:
        parts.append(part(calls, "ts", calls=one, call_failures=F.count_if("failed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    names = ["created", "settled", "failed", "calls", "call_failures"]
    have = [c for c in names if c in out.columns]
    ensure_checkpoint_dir(log.sparkSession)
    return out.groupBy("minute").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) if c in have else F.lit(0).cast("bigint").alias(c) for c in names]).checkpoint()


def metrics(counts: DataFrame, minutes: DataFrame, breaker_share: float = 0.5, opening: tuple | None = None) -> DataFrame:
    """(metric, minute, value) for every minute of the grid: ``pending`` (created and not
    settled yet), ``failed_per_second`` (over the last five minutes) and ``breaker_open``
    (1 if at least ``breaker_share`` of the minute's calls failed).

    The running number begins with the counts before the grid, or with ``opening``:
    (a minute of the grid, the number at its end)."""
    names = ["created", "settled", "calls", "call_failures"]
    net = F.col("created") - F.col("settled")
    first = minutes.agg(F.min("minute")).scalar()
    if opening is None:
        before = counts.where(F.col("minute") < first).agg(F.coalesce(F.sum(net), F.lit(0))).scalar()
        net = net + F.when(F.col("minute") == first, before).otherwise(F.lit(0))
    else:
        net = F.when(F.col("minute") > F.lit(opening[0]), net).when(F.col("minute") == F.lit(opening[0]), F.lit(opening[1])).otherwise(F.lit(0))
    # A minute's failures count in the rates of RATE_MINUTES minutes: at most so many rows per minute.
    later = counts.where(F.col("minute") >= first).withColumn("_later", F.explode(F.sequence(F.lit(0), F.lit(RATE_MINUTES - 1))))
    spread = later.groupBy(F.timestamp_add("MINUTE", F.col("_later"), F.col("minute")).alias("minute")).agg(
        *[F.sum(F.when(F.col("_later") == 0, F.col(c))).alias(c) for c in names], F.sum("failed").alias("recent"))
    dense = (minutes.join(spread, "minute", "left").select("minute", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in [*names, "recent"]])
             .withColumn("_one", F.lit(0)).withColumn("_net", net.cast("bigint")))
    last = running_sum(dense, ["_one"], ["minute"], "_net", "pending")
    rate = F.col("recent") / F.lit(60.0 * RATE_MINUTES)
    opened = ((F.col("calls") > 0) & (F.col("call_failures") >= F.col("calls") * F.lit(breaker_share))).cast("double")
    return last.select("minute", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in (
        ("pending", F.col("pending")), ("failed_per_second", rate), ("breaker_open", opened))])).alias("m")).select("m.metric", "minute", "m.value")


def _truth(values: DataFrame, rules) -> DataFrame:
    """(rule, minute, value, for_minutes, true) of each rule on its metric."""
    spark = values.sparkSession
    table = spark.createDataFrame([(r.name, r.metric, float(r.threshold), int(r.for_minutes), bool(r.at_least)) for r in rules],
                                  "rule string, metric string, threshold double, for_minutes int, at_least boolean")
    above = F.when(F.col("at_least"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return values.join(F.broadcast(table), "metric").select("rule", "minute", "value", "for_minutes", F.coalesce(above, F.lit(False)).alias("true"))


def states(values: DataFrame, rules=RULES, carry: DataFrame | None = None) -> DataFrame:
    """(rule, minute, value, state, since) for each minute of ``values`` (metric, minute, value; no gaps).

    ``carry``: (rule, last_false, was_firing) of the minutes before, at most one row per rule."""
    rows = _truth(values, rules).withColumn("_false", F.when(~F.col("true"), F.col("minute")))
    minute = F.col("minute")
    run = running_max(rows, ["rule"], ["minute"], ["_false"], "_last", ["minute"], "_first_", before=True)
    if carry is None:
        carry = values.sparkSession.createDataFrame([], "rule string, last_false timestamp_ntz, was_firing boolean")
    first = F.coalesce("_first_minute", minute)
    # With nothing known before the first minute, a stretch begins there at the earliest.
    floor = F.coalesce("last_false", first - F.expr("INTERVAL 1 MINUTE"))
    known = (run.join(F.broadcast(carry.withColumnRenamed("rule", "_r")), F.col("rule") == F.col("_r"), "left")
             .withColumn("_prior", F.coalesce("_last_false", floor)).withColumn("_before", F.when(~F.col("true"), minute).otherwise(F.col("_prior"))))
    since = F.col("_before") + F.expr("INTERVAL 1 MINUTE")
    lasted = F.timestamp_diff("MINUTE", since, minute)
    # A false minute resolves a rule if the stretch up to the minute before had lasted long enough.
    was_true = F.coalesce(F.col("_last_false") < minute - F.expr("INTERVAL 1 MINUTE"), F.lit(True))
    ended = F.timestamp_diff("MINUTE", F.col("_prior") + F.expr("INTERVAL 2 MINUTE"), minute)
    was = F.when(F.col("_first_minute").isNull(), F.coalesce("was_firing", F.lit(False))).otherwise(was_true & (ended >= F.col("for_minutes")))
    state = (F.when(F.col("true") & (lasted >= F.col("for_minutes")), FIRING).when(F.col("true"), PENDING)
             .when(F.coalesce(was, F.lit(False)), RESOLVED).otherwise(INACTIVE))
    return known.select("rule", "minute", "value", state.alias("state"), F.when(F.col("true"), since).alias("since"), F.col("_before").alias("last_false"))


def transitions(found: DataFrame) -> DataFrame:
    """(rule, minute, state, since) where a rule's state changes (the first minute included if it is not inactive)."""
    before = with_neighbour(found.select("rule", "minute", "state", "since"), ["rule"], ["minute"], ["state"])
    return before.where(F.col("state") != F.coalesce("prev_state", F.lit(INACTIVE))).select("rule", "minute", "state", "since")


# --- streaming --------------------------------------------------------------------------

def minute_stream(log: DataFrame, ts_col: str = "event_ts", delay: str = "1 minute") -> DataFrame:
    """Counts per minute of a stream of (event_ts, kind): kind is created, settled, failed,
    call or call_failed.  A minute comes out once the watermark has passed it."""
    kinds = {"created": ("created",), "settled": ("settled",), "failed": ("failed",), "calls": ("call", "call_failed"), "call_failures": ("call_failed",)}
    return (log.withWatermark(ts_col, delay).groupBy(F.window(ts_col, "1 minute").alias("w"))
            .agg(*[F.count_if(F.col("kind").isin(*k)).alias(n) for n, k in kinds.items()])
            .select(F.timestamp_add("SECOND", F.unix_seconds("w.start"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("minute"), *kinds))


CARRY = "minute timestamp_ntz, pending bigint, rules array<struct<rule: string, last_false: timestamp_ntz, was_firing: boolean>>"


def _carried(spark: SparkSession, path: str, batch_id: int):
    """What the newest batch before this one has left, or None."""
    try:
        rows = spark.read.schema(CARRY + ", b bigint").parquet(path).where(F.col("b") < batch_id)
        return next(iter(rows.orderBy(F.desc("b")).limit(1).collect()), None)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def alert_writer(out_dir: str, first: dt.datetime, rules=RULES, breaker_share: float = 0.5, until: dt.datetime | None = None):
    """A ``foreachBatch`` function over ``minute_stream``: writes the states of the minutes
    that a micro-batch completes to ``{out_dir}/states/batch_id={b}``, their counts to
    ``{out_dir}/minutes/batch_id={b}``, and one row of what the next batch needs to
    ``{out_dir}/_carry/b={b}``.  A replayed batch reads what its first run read.

    ``first``: the first minute of the grid.  Minutes after ``until`` are left out."""
    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        new = batch if until is None else batch.where(F.col("minute") <= F.lit(until))
        new.write.mode("overwrite").parquet(f"{out_dir}/minutes/batch_id={batch_id}")
        stored = spark.read.schema(batch.schema).parquet(f"{out_dir}/minutes")
        last = stored.where(F.col("batch_id") == batch_id).agg(F.max("minute")).first()[0]
        held = _carried(spark, f"{out_dir}/_carry", batch_id)
        if last is None or held is not None and last <= held.minute:
            return
        # The minutes before, as far back as a rate looks.
        begin = first if held is None else max(first, held.minute - dt.timedelta(minutes=RATE_MINUTES - 2))
        counts = stored.where((F.col("batch_id") <= batch_id) & (F.col("minute") >= F.lit(begin))).drop("batch_id")
        values = metrics(counts, grid(begin, last, spark), breaker_share, None if held is None else (held.minute, held.pending))
        carry = None
        if held is not None:
            values = values.where(F.col("minute") > F.lit(held.minute))
            carry = spark.createDataFrame([tuple(r) for r in held.rules], "rule string, last_false timestamp_ntz, was_firing boolean")
        values = values.persist()
        found = states(values, rules, carry).persist()
        try:
            found.drop("last_false").write.mode("overwrite").parquet(f"{out_dir}/states/batch_id={batch_id}")
            ends = found.where(F.col("minute") == F.lit(last)).select("rule", "last_false", (F.col("state") == FIRING).alias("was_firing")).collect()
            pending = values.where((F.col("metric") == "pending") & (F.col("minute") == F.lit(last))).first().value
            (spark.createDataFrame([(last, int(pending), [tuple(r) for r in ends])], CARRY).coalesce(1)
             .write.mode("overwrite").parquet(f"{out_dir}/_carry/b={batch_id}"))
        finally:
            found.unpersist()
            values.unpersist()
    return write
