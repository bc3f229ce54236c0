"""R10 for every watermark: late rows are taken out, counted and kept before a stateful
operator sees them.

A watermark drops late rows silently, and the engine's own count is taken after partial
aggregation.  The gate decides first, by the watermark's rule: a row is late if its event
time is not after (highest event time of earlier micro-batches - delay).  Late rows go to
a folder of their own, the others are the input of the stateful query, whose watermark of
the same delay then finds nothing to drop, as long as it takes whole micro-batches of
the gate.  Input, kept and late rows are counted by ``observe`` and from the folders.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .progress import progress
from .sources import read_event_stream


def gate_writer(out_dir: str, delay_s: int, ts_col: str = "event_ts"):
    """A ``foreachBatch`` function that writes ``on_time`` and ``late`` rows per batch id.
    The mark is one row per batch id, so a replayed batch decides as its first run did.
    Rows without an event time are late: no window or time-out can hold them."""
    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        try:
            mark = spark.read.parquet(f"{out_dir}/_marks").where(F.col("b") < batch_id).agg(F.max("mark")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            mark = None
        fits = F.col(ts_col).isNotNull()
        if mark is not None:
            fits = fits & (F.col(ts_col) > F.lit(mark) - F.expr(f"INTERVAL {int(delay_s)} SECONDS"))
        rows = batch.withColumn("_fits", F.coalesce(fits, F.lit(False))).persist()
        try:
            rows.where(~F.col("_fits")).drop("_fits").write.mode("overwrite").parquet(f"{out_dir}/late/batch_id={batch_id}")
            rows.where("_fits").drop("_fits").write.mode("overwrite").parquet(f"{out_dir}/on_time/batch_id={batch_id}")
            # Counted apart from the folders: input rows of the batch, and the mark for the next ones.
            (rows.agg(F.max(ts_col).alias("mark"), F.count(F.lit(1)).alias("rows")).coalesce(1)
             .write.mode("overwrite").parquet(f"{out_dir}/_marks/b={batch_id}"))
        finally:
            rows.unpersist()
    return write


def observed(stream: DataFrame, name: str = "arrived") -> DataFrame:
    """The stream with a count of its rows in every progress report."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"))


def on_time(spark: SparkSession, out_dir: str, schema) -> DataFrame:
    """The rows that passed the gate, as a stream of whole gate batches."""
    return read_event_stream(spark, f"{out_dir}/on_time/*", schema, max_files=0)


def balance(spark: SparkSession, out_dir: str, schema, progress_path: str | None = None, name: str = "arrived") -> DataFrame:
    """One row: ``arrived`` (by ``observe`` if there is a progress table, else by the
    gate), ``kept``, ``late`` and whether the two add up to the first."""
    def rows(folder: str):
        return spark.read.schema(schema).parquet(f"{out_dir}/{folder}").agg(F.count(F.lit(1))).scalar()

    if progress_path is None:
        arrived = spark.read.schema("mark timestamp, rows bigint").parquet(f"{out_dir}/_marks").agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    else:
        counts = F.from_json("observed", "map<string, string>")[name]
        arrived = progress(spark, progress_path).agg(F.coalesce(F.sum(
            F.coalesce(F.regexp_extract(counts, r"(\d+)", 1).try_cast("bigint"), F.lit(0))), F.lit(0))).scalar()
    return spark.range(1).select(arrived.alias("arrived"), rows("on_time").alias("kept"), rows("late").alias("late")) \
        .withColumn("balanced", F.col("arrived") == F.col("kept") + F.col("late"))


def engine_dropped(spark: SparkSession, progress_path: str) -> DataFrame:
    """Rows that watermarks dropped in the queries of a progress table, as the engine counts them."""
    return progress(spark, progress_path).agg(F.coalesce(F.sum("dropped_by_watermark"), F.lit(0)).alias("engine_dropped"))
