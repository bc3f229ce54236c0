"""A stored event log in two parts: ``active`` (still to deliver) and ``done``.

A delivery cycle reads and rewrites ``active`` and only adds the rows it published to
``done``, so its cost does not grow with the history.  Every commit writes a data
folder of its own, ``log/commit=<name>/status_group=active|done``, and then one record
that says what the folder is to each part: ``set`` (it replaces what was there),
``add`` (it joins it) or nothing.  A part is the folders from its last ``set`` on.
Nothing is overwritten; a job that dies before its record changes nothing (single
writer).  ``compact`` merges what cycles have added; ``purge_done`` applies retention
to ``done`` alone.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from .sinks import status_group

ACTIVE, DONE = "active", "done"
RECORDS = "version bigint, folder string, active string, done string"
_STORED = T.StructType([*S.EVENT_LOG.fields, T.StructField("status_group", T.StringType())])


def _records(spark: SparkSession, base: str) -> DataFrame:
    try:
        return spark.read.schema(RECORDS).parquet(f"{base.rstrip('/')}/_records")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORDS)


def version(spark: SparkSession, base: str) -> int:
    """The newest committed version, 0 when there is none."""
    return int(_records(spark, base).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0])


def folders(spark: SparkSession, base: str, part: str) -> list[str]:
    """The folders that make up a part now, oldest first."""
    records = _records(spark, base).where(F.col(part).isNotNull())
    last = records.where(F.col(part) == "set").agg(F.max("version").alias("last"))
    rows = records.join(F.broadcast(last), F.col("version") >= F.col("last")).select("version", "folder").collect()
    return [r.folder for r in sorted(rows, key=lambda r: r.version)]


def _read(spark: SparkSession, base: str, part: str) -> DataFrame:
    names = folders(spark, base, part)
    if not names:
        return spark.createDataFrame([], S.EVENT_LOG)
    root = f"{base.rstrip('/')}/log"
    return (spark.read.schema(_STORED).option("basePath", root).parquet(*[f"{root}/commit={n}" for n in names])
            .where(F.col("status_group") == part).select(*S.EVENT_LOG.fieldNames()))


def read_active(spark: SparkSession, base: str) -> DataFrame:
    """Rows that are not published."""
    return _read(spark, base, ACTIVE)


def read_done(spark: SparkSession, base: str) -> DataFrame:
    """Published rows."""
    return _read(spark, base, DONE)


def read_log(spark: SparkSession, base: str) -> DataFrame:
    """The whole log."""
    return read_active(spark, base).unionByName(read_done(spark, base))


def _commit(rows: DataFrame, base: str, active: str | None, done: str | None) -> int:
    spark, base = rows.sparkSession, base.rstrip("/")
    nxt = version(spark, base) + 1
    name = f"{nxt:012d}-{uuid.uuid4().hex[:12]}"
    # Ranges of the creation time inside each group: time filters skip row groups, and two groups are not two tasks.
    (rows.select(*S.EVENT_LOG.fieldNames()).withColumn("status_group", status_group())
     .repartitionByRange("status_group", "created_at", "id").sortWithinPartitions("status_group", "created_at", "id")
     .write.mode("errorifexists").partitionBy("status_group").parquet(f"{base}/log/commit={name}"))
    (spark.range(1).select(F.lit(nxt).cast("bigint").alias("version"), F.lit(name).alias("folder"), F.lit(active).cast("string").alias("active"),
                           F.lit(done).cast("string").alias("done"))
     .coalesce(1).write.mode("append").parquet(f"{base}/_records"))
    return nxt


def create(log: DataFrame, base: str) -> int:
    """Store a log; what was stored under ``base`` before is no longer part of it."""
    return _commit(log, base, "set", "set")


def append(rows: DataFrame, base: str) -> int:
    """Add new rows (``operators.append.log_rows``) without reading what is there."""
    return _commit(rows, base, "add", "add")


def commit_cycle(active: DataFrame, base: str) -> int:
    """``active`` after a cycle: rows still to deliver replace the active part, published ones join ``done``."""
    return _commit(active, base, "set", "add")


def purge_done(spark: SparkSession, base: str, now, retention_days: int = S.RETENTION_DAYS) -> int:
    """Retention (M08) on the done part; the active part is neither read nor written."""
    from ..operators.lifecycle import purge_predicate
    return _commit(read_done(spark, base).where(~purge_predicate(now, retention_days)), base, None, "set")


def compact(spark: SparkSession, base: str) -> int:
    """Merge the folders of both parts into one commit."""
    return _commit(read_log(spark, base), base, "set", "set")
