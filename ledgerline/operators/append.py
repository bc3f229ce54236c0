"""Idempotent append of events to the log.

Appends build new event-log rows with built-in expressions; duplicates are
found with semi / anti joins on keys (shuffle joins that partition on the key,
so no key list passes through the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.codec import event_id_for, metadata_json, uuid_v5
from ..functions.time import ts
from .ordering import rank_within

DEFAULT_EXISTS_STATUSES = (S.PENDING, S.PUBLISHED)
ROWS_A_TASK = 250_000  #: rows of both sides that a task of the inbox join takes


def append_rows(events: DataFrame, now, keep: list | None = None) -> DataFrame:
    """New PENDING event-log rows.

    ``events`` has aggregate_id, aggregate_type, event_type, payload and
    optional event_id / correlation_id / created_at / version.  A missing
    event id is the name-based id of (aggregate, version), or without a version
    of (aggregate, type, time, payload), so different events of one aggregate
    never share an id; partition key = aggregate id; retry count 0.  ``keep``
    lists extra input columns to carry.
    """
    cols = set(events.columns)
    opt = lambda c, default: F.col(c) if c in cols else default
    none = F.lit(None)
    version = opt("version", none.cast("bigint"))
    created = F.coalesce(opt("created_at", none.cast("timestamp_ntz")), ts(now))
    unversioned = uuid_v5(F.to_json(F.array(F.col("aggregate_id"), F.col("event_type"), created.cast("string"), F.col("payload"))))
    return events.select(
        F.coalesce(opt("event_id", none.cast("string")),
                   F.when(version.isNotNull(), event_id_for(F.col("aggregate_id"), version)).otherwise(unversioned)).alias("event_id"),
        "aggregate_id", "aggregate_type", "event_type", "payload",
        F.lit(S.PENDING).alias("status"), F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("aggregate_id").alias("partition_key"),
        opt("correlation_id", F.lit(None).cast("string")).alias("correlation_id"),
        created.alias("created_at"), created.alias("updated_at"),
        F.coalesce(version.cast("bigint"), F.lit(0)).alias("version"), *(keep or []))


def log_rows(appended: DataFrame, after_id: F.Column | int, source: str = "order-service", triggered_by: F.Column | None = None) -> DataFrame:
    """Appended rows as rows of the event log (``schemas.EVENT_LOG``): ids go on after
    ``after_id`` in the order of (created_at, event_id), metadata is the X04 document,
    and a correlation id that is not a number is in the metadata only."""
    from .ordering import global_rank
    first = after_id if isinstance(after_id, F.Column) else F.lit(int(after_id))
    ranked = global_rank(appended, ["created_at", "event_id"], "_n")
    trace = F.coalesce(F.col("correlation_id").cast("string"), F.col("event_id"))
    meta = metadata_json(F.lit(source), triggered_by if triggered_by is not None else F.lit(None).cast("string"), trace, F.col("created_at"))
    none = F.lit(None).cast("timestamp_ntz")
    rows = ranked.withColumns({"id": (first + F.col("_n")).cast("bigint"), "metadata": meta, "published_at": none, "next_retry_at": none,
                               "correlation_id": F.col("correlation_id").try_cast("bigint")})
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.EVENT_LOG.fields])


def append_mixed(batches: list[DataFrame], now, keep: list | None = None) -> DataFrame:
    """Append several typed batches as one (columns aligned by name,
    missing ones null)."""
    out = None
    for b in batches:
        out = b if out is None else out.unionByName(b, allowMissingColumns=True)
    return append_rows(out, now, keep)


def event_exists(log: DataFrame, requests: DataFrame,
                 statuses=DEFAULT_EXISTS_STATUSES) -> DataFrame:
    """For each (aggregate_id, event_type) request, does a row in one of
    ``statuses`` exist?  Duplicates in the log are tolerated (semi join)."""
    live = log.where(F.col("status").isin(list(statuses))).select("aggregate_id", "event_type")
    found = (requests.select("aggregate_id", "event_type").distinct()
             .join(live, ["aggregate_id", "event_type"], "left_semi").withColumn("exists", F.lit(True)))
    return (requests.join(found, ["aggregate_id", "event_type"], "left")
            .withColumn("exists", F.coalesce(F.col("exists"), F.lit(False))))


def unseen(incoming: DataFrame, seen_ids: DataFrame, key: str = "event_id", rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Keep only events whose id is not in the processed (inbox) set.

    Both sides are counted first and dealt by the key into as many partitions as give a
    task ``rows_a_task`` rows of both, so its sorts and its table of ids do not grow with the
    input; the ids are made distinct in the same stage."""
    seen = seen_ids.select(key)
    rows = incoming.select(key).unionAll(seen).count()
    n = max(incoming.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_a_task))
    return incoming.repartition(n, key).join(seen.repartition(n, key).distinct(), key, "left_anti")


def version_conflicts(current: DataFrame, appends: DataFrame, order_cols: list | None = None) -> DataFrame:
    """Optimistic version check.  ``current`` has (aggregate_id, version)
    rows of the store; ``appends`` has (aggregate_id, expected_version, ...).
    An append is accepted when its expected version equals the aggregate's
    current maximum (0 for a new aggregate).  Of several appends with that
    version the first wins (by ``order_cols``, else all columns in their order;
    equal rows by chance), the others conflict; returns ``accepted`` flag."""
    own = order_cols or appends.columns
    appends = rank_within(appends, ["aggregate_id", "expected_version"], own, "_nth")
    head = current.groupBy("aggregate_id").agg(F.max("version").alias("_cur"))
    return (appends.join(head, "aggregate_id", "left")
            .withColumn("current_version", F.coalesce(F.col("_cur"), F.lit(0)).cast("bigint"))
            .withColumn("accepted", (F.col("expected_version") == F.col("current_version")) & (F.col("_nth") == 1))
            .drop("_cur", "_nth"))


def append_chain(current: DataFrame, appends: DataFrame, order_cols: list | None = None) -> DataFrame:
    """W07 for a batch that goes on: ``accepted`` marks, per aggregate, the longest run of
    expected versions without a gap that begins at the stored head (0 for a new
    aggregate), as if the appends came one after the other.  Of several appends with one
    expected version the first is taken (see ``version_conflicts``); a gap rejects all
    that come after it.  ``current_version`` is the stored head.

    An island check: the n-th different version (from 0) that is not below the head
    is in the run if it is the head plus n.  Ranks are distributed (``rank_within``), so
    an aggregate with most of the appends is not one task's."""
    own = order_cols or appends.columns
    ranked = rank_within(appends, ["aggregate_id", "expected_version"], own, "_nth")
    head = current.groupBy("aggregate_id").agg(F.max("version").alias("_cur"))
    known = ranked.join(head, "aggregate_id", "left").withColumn("current_version", F.coalesce("_cur", F.lit(0)).cast("bigint")).drop("_cur")
    live = F.coalesce((F.col("_nth") == 1) & (F.col("expected_version") >= F.col("current_version")), F.lit(False))
    # Rows that cannot win are ranked behind all others, so one rank serves all rows.
    placed = rank_within(known.withColumn("_lost", (~live).cast("int")), ["aggregate_id"], ["_lost", "expected_version", "_nth"], "_place")
    run = (F.col("_lost") == 0) & (F.col("expected_version") == F.col("current_version") + F.col("_place") - 1)
    return placed.withColumn("accepted", run).drop("_nth", "_lost", "_place")


def uniqueness_conflicts(df: DataFrame, natural_key: str, order_cols: list) -> DataFrame:
    """Registrations that lose to an earlier one of the same natural key
    (first wins, ties by the order columns).

    The winner per key is a partial ``min_by`` aggregate, then an equi-join:
    no window over a possibly hot key.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    first = df.groupBy(natural_key).agg(F.min(order).alias("_first"))
    return (df.join(first, natural_key)
            .where(order != F.col("_first")).drop("_first"))
