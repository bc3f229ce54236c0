"""Stream sources and stream test inputs.

Production reads a message bus (the ``kafka`` format, configured by the
caller); the same transformations run on the file source, which is what the
tests use (``availableNow`` drains it and stops).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import ntz_micros
from ..session import ensure_checkpoint_dir

def read_event_stream(spark: SparkSession, path: str, schema: T.StructType,
                      max_files: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Partitioned stream source with a per-trigger cap (the prefetch of
    the bus consumer becomes ``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``).
    The default cap is one wave of tasks (``defaultParallelism`` files)."""
    if max_files is None:
        max_files = max(1, spark.sparkContext.defaultParallelism)
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def read_bus_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int) -> DataFrame:
    """S04 (production): the Kafka-compatible bus source; ``max_offsets`` rows
    per micro-batch is the caller's to size.  Needs the Kafka connector on the
    classpath."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("maxOffsetsPerTrigger", str(max_offsets)).load()
            .select(F.col("key").cast("string").alias("partition_key"),
                    F.col("value").cast("string").alias("payload"),
                    F.col("partition"), F.col("offset"), F.col("timestamp").alias("enqueued_at")))


def stage_in_order(df: DataFrame, path: str, ts_col: str, slices: int,
                   files_per_slice: int | None = None, tail: DataFrame | None = None) -> int:
    """Write ``df`` as ``slices`` consecutive event-time slices for a file
    stream source; returns the per-trigger file cap that makes one micro-batch
    read exactly one slice.

    Each slice is a parallel write of exactly ``files_per_slice`` files
    (round-robin, one task per file; default one wave of tasks).  Slices are
    written one after another, so every file of slice ``i`` is older than every
    file of slice ``i+1``; the file source takes files in modification-time
    order, so batch ``i`` is slice ``i`` and the watermark never passes rows of
    a later batch.  ``tail`` (e.g. a sentinel row) is written last, alone.
    The input is pinned once.  Slice bounds are approximate quantiles of the
    event time (a sketch of fixed size; slices need not be equal); rows without
    a time are in the first slice.
    """
    spark = df.sparkSession
    n = files_per_slice or max(1, spark.sparkContext.defaultParallelism)
    epoch = F.unix_micros(F.col(ts_col)) if dict(df.dtypes)[ts_col] == "timestamp" else ntz_micros(F.col(ts_col))
    ensure_checkpoint_dir(spark)
    with_e = df.withColumn("_e", epoch).checkpoint()
    cuts = with_e.approxQuantile("_e", [i / slices for i in range(1, slices)], 0.01) if slices > 1 else []
    if len(cuts) < slices - 1:  # no row has a time
        cuts = [0.0] * (slices - 1)
    bounds = [None] + cuts + [None]
    for i in range(slices):
        lo, hi = bounds[i], bounds[i + 1]
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col("_e") > F.lit(lo))
        if hi is not None:
            cond = cond & (F.col("_e") <= F.lit(hi))
        if i == 0:
            cond = cond | F.col("_e").isNull()
        (with_e.where(cond).drop("_e").repartition(n)
         .write.mode("overwrite").parquet(f"{path.rstrip('/')}/slice={i:04d}"))
    if tail is not None:
        tail.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/slice={slices:04d}")
    return n
