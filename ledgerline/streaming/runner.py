"""Run a streaming query to completion over staged files (``availableNow``).

Results go to a Parquet folder per micro-batch through ``foreachBatch``
(overwrite per batch id: a replayed batch replaces its output), and the
checkpoint lives in the shared checkpoint folder, so a restarted run resumes
where the failed one stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for one run."""
    return scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


class _StatePartitions:
    """Set ``spark.sql.shuffle.partitions`` while a new streaming query starts.

    The number of state-store partitions of a stateful query is fixed by this
    setting at its first start (and then kept in the checkpoint); the caller's
    value is restored afterwards.
    """

    def __init__(self, spark: SparkSession, n: int | None):
        self.spark, self.n, self.old = spark, n, None

    def __enter__(self):
        if self.n:
            self.old = self.spark.conf.get("spark.sql.shuffle.partitions")
            self.spark.conf.set("spark.sql.shuffle.partitions", str(self.n))

    def __exit__(self, *exc):
        if self.n and self.old is not None:
            self.spark.conf.set("spark.sql.shuffle.partitions", self.old)


def default_state_partitions(spark: SparkSession) -> int:
    """State partitions sized to the cluster's task slots."""
    return max(1, spark.sparkContext.defaultParallelism)


def run_to_parquet(stream: DataFrame, out_dir: str, checkpoint: str, output_mode: str = "append",
                   timeout_s: int | None = None, state_partitions: int | None = None):
    """Drain ``stream`` with ``availableNow`` into ``{out_dir}/batch_id=<n>``."""
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    with _StatePartitions(stream.sparkSession, state_partitions):
        q = (stream.writeStream.outputMode(output_mode).foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not finish")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def run_foreach(stream: DataFrame, fn, checkpoint: str, timeout_s: int | None = None,
                state_partitions: int | None = None):
    """Drain ``stream`` with ``availableNow`` through a ``foreachBatch`` function."""
    with _StatePartitions(stream.sparkSession, state_partitions):
        q = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not finish")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def read_output(spark: SparkSession, out_dir: str, schema=None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(out_dir)
