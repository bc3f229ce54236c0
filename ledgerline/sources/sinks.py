"""Writers: snapshots, partitioned archives, keyed publish files and the
dead-letter sink (S05, S09, S13, S14, state-change snapshots).

State changes are never in-place updates: each write goes to a new snapshot
folder (``<base>/v=<n>``) under one writer, and readers take the newest.
Partitioned sinks use dynamic partition overwrite so a rerun of a failed job
replaces exactly the partitions it produced (idempotent on retry).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import purge_predicate


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Write the next snapshot of a table to ``{base}/v={version}``."""
    path = f"{base.rstrip('/')}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_partitioned(df: DataFrame, path: str, partition_col: str) -> None:
    """Dynamic partition overwrite: only partitions present in ``df`` are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))


def archive_rows(log: DataFrame, now, retention_days: int = 7) -> DataFrame:
    """Rows to move to cheap storage — the rows retention would delete,
    with a ``dt`` (publish date) partition column."""
    return (log.where(purge_predicate(now, retention_days))
            .withColumn("dt", F.to_date("published_at")))


def archive(log: DataFrame, path: str, now, retention_days: int = 7) -> None:
    """Write the archive partitioned by day (idempotent per day)."""
    write_partitioned(archive_rows(log, now, retention_days), path, "dt")


def with_month(df: DataFrame, ts_col: str = "created_at") -> DataFrame:
    """Month partition column ``ym`` (``yyyy-MM``)."""
    return df.withColumn("ym", F.date_format(F.col(ts_col), "yyyy-MM"))


def retain_months(df: DataFrame, keep_from_month: str) -> DataFrame:
    """The table after dropping month partitions older than ``keep_from_month``
    (pruned by the partition filter when read from a ``ym``-partitioned path)."""
    return df.where(F.col("ym") >= keep_from_month)


def drop_month_partitions(spark: SparkSession, path: str, new_base: str, version: int,
                          keep_from_month: str) -> str:
    """Partition drop as a snapshot rewrite: kept months are copied to a
    new snapshot (partition pruning reads only them)."""
    kept = retain_months(spark.read.parquet(path), keep_from_month)
    out = f"{new_base.rstrip('/')}/v={version}"
    kept.write.mode("overwrite").partitionBy("ym").parquet(out)
    return out


def publish_files(df: DataFrame, path: str, key_col: str, num_partitions: int) -> None:
    """Keyed, ordered publish to files — each key's rows in (created_at,
    id) order over consecutive files (range-partitioned, so hot keys split)."""
    from ..operators.delivery import keyed_publish_order
    keyed_publish_order(df, key_col, num_partitions).write.mode("overwrite").parquet(path)


def write_dead_letters(rows: DataFrame, path: str, batch: str | int = 0) -> None:
    """Dead-letter records ``(payload, error, failed_at)`` of a batch; writing a batch
    again (a retry) replaces what it wrote and nothing else."""
    write_partitioned(rows.select("payload", "error", "failed_at").withColumn("batch", F.lit(str(batch))), path, "batch")


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    from .. import schemas as S
    return spark.read.schema(S.DEAD_LETTERS).parquet(path).select(*S.DEAD_LETTERS.fieldNames())


def write_topics(rows: DataFrame, path: str, event_type: str = "event_type") -> None:
    """Rows by destination topic; those without a topic go to ``none``."""
    from ..functions.codec import topic
    write_partitioned(rows.withColumn("topic", F.coalesce(topic(F.col(event_type)), F.lit("none"))), path, "topic")


def status_group(status_col: str = "status") -> F.Column:
    """Storage partition of an event row: ``active`` (still to deliver) or
    ``done`` (published).  Polls, retries and stuck checks read only
    ``active``; retention reads only ``done``."""
    return F.when(F.col(status_col) == "PUBLISHED", F.lit("done")).otherwise(F.lit("active"))


def write_event_log(log: DataFrame, base: str, version: int) -> str:
    """S01 storage layout: a snapshot partitioned by ``status_group`` and
    range-sorted by ``created_at`` so status filters prune whole partitions
    and time filters skip row groups by their statistics.  The range exchange
    spreads the write over ``spark.sql.shuffle.partitions`` balanced tasks
    (two status groups never mean two tasks)."""
    path = f"{base.rstrip('/')}/v={version}"
    (log.withColumn("status_group", status_group())
     .repartitionByRange("status_group", "created_at", "id")
     .sortWithinPartitions("status_group", "created_at", "id")
     .write.mode("overwrite").partitionBy("status_group").parquet(path))
    return path


def read_active(spark: SparkSession, path: str) -> DataFrame:
    """The undelivered part of a stored log (partition-pruned read)."""
    from ..schemas import EVENT_LOG
    from pyspark.sql import types as T
    schema = T.StructType(EVENT_LOG.fields + [T.StructField("status_group", T.StringType())])
    return spark.read.schema(schema).parquet(path).where(F.col("status_group") == "active")


COMMITS = "_commits"


def _commits(spark: SparkSession, base: str) -> DataFrame | None:
    """(version, folder) of every committed snapshot; None when there is none.
    Only a missing folder means that: any other failure is raised."""
    try:
        return spark.read.schema("version bigint, folder string").parquet(f"{base.rstrip('/')}/{COMMITS}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _latest(spark: SparkSession, base: str) -> tuple[int, str | None]:
    commits = _commits(spark, base)
    row = None if commits is None else commits.agg(F.max(F.struct("version", "folder")).alias("m")).first().m
    return (0, None) if row is None else (int(row.version), row.folder)


def latest_version(spark: SparkSession, base: str) -> int:
    """The committed snapshot version of a table folder (0 when none)."""
    return _latest(spark, base)[0]


def commit_snapshot(df: DataFrame, base: str, partition_by: str | None = None) -> int:
    """Write ``df`` as the next snapshot and then commit it (single writer).

    The data goes to a folder of its own, never to one that exists, and the
    commit is one more record in ``_commits``; nothing is overwritten.  A job
    that dies before the record leaves the earlier snapshot current."""
    spark = df.sparkSession
    nxt = latest_version(spark, base) + 1
    folder = f"v={nxt}-{uuid.uuid4().hex[:12]}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(partition_by) if partition_by else w).parquet(f"{base.rstrip('/')}/{folder}")
    _record(spark, base, nxt, folder)
    return nxt


def _record(spark: SparkSession, base: str, version: int, folder: str) -> None:
    (spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(folder).alias("folder"))
     .coalesce(1).write.mode("append").parquet(f"{base.rstrip('/')}/{COMMITS}"))


def read_latest(spark: SparkSession, base: str, schema=None) -> DataFrame:
    """The current snapshot of a table folder."""
    _, folder = _latest(spark, base)
    if folder is None:
        raise FileNotFoundError(f"no committed snapshot under {base}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{base.rstrip('/')}/{folder}")
