"""Progress and checkpoint status of streaming queries as a table.

A listener writes one record per micro-batch: rows, rates, watermark, and the start
and end offset of every source.  ``recentProgress`` keeps only the newest reports in
the driver; here every report goes to Parquet, ``flush_every`` at a time, so the
driver holds a bounded number and a stream of any length is counted whole.  The
records of a replayed micro-batch share (query, batch) and the newest one counts.
"""

from __future__ import annotations

import json
import threading
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = ("query_id string, query_name string, run_id string, batch_id bigint, reported_at string, input_rows bigint, "
          "input_rows_per_s double, processed_rows_per_s double, trigger_ms bigint, watermark string, state_rows bigint, "
          "dropped_by_watermark bigint, sources array<struct<description: string, start_offset: string, end_offset: string, "
          "latest_offset: string, input_rows: bigint>>, observed string")


def _record(p) -> tuple:
    d = json.loads(p.json)
    state = d.get("stateOperators") or []
    text = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x, sort_keys=True)
    sources = [(s.get("description"), text(s.get("startOffset")), text(s.get("endOffset")), text(s.get("latestOffset")),
                int(s.get("numInputRows") or 0)) for s in d.get("sources") or []]
    return (d["id"], d.get("name"), d["runId"], int(d["batchId"]), d["timestamp"], int(d.get("numInputRows") or 0),
            float(d.get("inputRowsPerSecond") or 0), float(d.get("processedRowsPerSecond") or 0),
            int((d.get("durationMs") or {}).get("triggerExecution") or 0), (d.get("eventTime") or {}).get("watermark"),
            sum(int(s.get("numRowsTotal") or 0) for s in state), sum(int(s.get("numRowsDroppedByWatermark") or 0) for s in state),
            sources, json.dumps(d.get("observedMetrics") or {}, sort_keys=True))


class ProgressLog(StreamingQueryListener):
    """Writes the progress of all queries of a session to ``path`` while it is entered::

        with ProgressLog(spark, path):
            run_to_parquet(...)
    """

    def __init__(self, spark: SparkSession, path: str, flush_every: int = 64):
        self.spark, self.path, self.flush_every = spark, path, flush_every
        self._held: list[tuple] = []
        self._lock, self._running = threading.Lock(), set()
        self._errors: list[Exception] = []

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        with self._lock:
            self._held.append(_record(event.progress))
            full = len(self._held) >= self.flush_every
        if full:
            self._flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._flush()
        with self._lock:
            self._running.discard(str(event.runId))

    def _flush(self) -> None:
        with self._lock:
            rows, self._held = self._held, []
        if not rows:
            return
        try:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        except Exception as e:  # the listener bus would swallow it: raised when the log is left
            with self._lock:
                self._held, _ = rows + self._held, self._errors.append(e)

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *exc) -> None:
        until = time.time() + 60  # reports come a moment after their query has ended
        while self._running and time.time() < until:
            time.sleep(0.05)
        self.spark.streams.removeListener(self)
        self._flush()
        if self._held and self._errors and exc[0] is None:
            raise self._errors[-1]


def progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per micro-batch of each query, the newest report of each."""
    try:
        reports = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        reports = spark.createDataFrame([], SCHEMA)
    row = F.struct("reported_at", *[c for c in reports.columns if c not in ("query_id", "batch_id", "reported_at")])
    newest = reports.groupBy("query_id", "batch_id").agg(F.max_by(row, F.struct("reported_at", "run_id", "input_rows")).alias("_r"))
    return newest.select("query_id", "batch_id", "_r.*").select(*reports.columns)


def checkpoint_status(reports: DataFrame) -> DataFrame:
    """Per query and source: micro-batches, rows, the last offset that was processed, the
    offset it started from, and whether the source had more than that."""
    each = reports.select("query_id", "batch_id", "watermark", F.posexplode("sources").alias("source_no", "s"))
    last = F.max_by(F.struct(F.col("s.end_offset").alias("offset"), F.col("s.latest_offset").alias("latest"), "watermark"), "batch_id")
    return each.groupBy("query_id", "source_no").agg(
        F.first("s.description").alias("source"), F.count(F.lit(1)).alias("batches"), F.sum("s.input_rows").alias("input_rows"),
        F.max("batch_id").alias("last_batch"), F.min_by("s.start_offset", "batch_id").alias("first_offset"), last.alias("_l")).select(
        "query_id", "source_no", "source", "batches", "input_rows", "last_batch", "first_offset", F.col("_l.offset").alias("last_offset"),
        F.col("_l.watermark").alias("watermark"), F.coalesce(F.col("_l.latest") != F.col("_l.offset"), F.lit(False)).alias("behind"))


def committed(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(batch_id, offsets, done) of what a checkpoint folder still holds: the offset log
    beside the commit log, so a batch that was started but not finished shows up."""
    def log(name: str) -> DataFrame:
        lines = spark.read.option("wholetext", True).text(f"{checkpoint.rstrip('/')}/{name}").select(
            F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
        return lines.where(F.col("file").rlike("^[0-9]+$")).select(F.col("file").cast("bigint").alias("batch_id"), "value")

    # A version line, the metadata, then one line per source.
    offsets = log("offsets").withColumn("lines", F.split(F.trim("value"), "\n")).select(
        "batch_id", F.expr("slice(lines, 3, greatest(size(lines) - 2, 0))").alias("offsets"))
    done = log("commits").select("batch_id", F.lit(True).alias("done"))
    return offsets.join(done, "batch_id", "left").select("batch_id", "offsets", F.coalesce("done", F.lit(False)).alias("done"))


def offset_gaps(reports: DataFrame) -> DataFrame:
    """Micro-batches of a query whose sources do not start where the batch before ended."""
    at = Window.partitionBy("query_id").orderBy("batch_id")  # one row per micro-batch
    before = reports.select("query_id", "batch_id", F.col("sources.start_offset").alias("starts"),
                            F.lag("sources.end_offset").over(at).alias("ended"), F.lag("batch_id").over(at).alias("before"))
    return before.where("before IS NOT NULL AND (batch_id <> before + 1 OR NOT starts <=> ended)")
