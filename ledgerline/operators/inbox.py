"""J02 over a window of days: an inbox with a mergeable filter per day.

Processed ids are stored by day.  Each day also has a blocked Bloom filter: the id's
hash chooses one 32,768-bit block, and ``PROBES`` bits inside it are set.  Blocks of
one day are merged with a bitwise or, so every batch adds its own.  A lookup joins
the incoming ids with the blocks of the window, one block per id and day; ids that miss
every day are new without reading an inbox row, and days without a hit are not read
at all.  Hits are verified against the stored ids, so the answer is exact.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WINDOW_DAYS = 7
PROBES = 6
BLOCK_BITS = 32_768
#: Blocks per day: 16 bits per id for 8 million ids a day.
BLOCKS = 4096
#: Filters of a window up to this size are broadcast.
BROADCAST_BYTES = 64 << 20


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(blocks)).cast("int")


def _probe(key: Column, k: int) -> Column:
    """A position from 1 to ``BLOCK_BITS``."""
    return F.pmod(F.xxhash64(F.lit(k + 1), key), F.lit(BLOCK_BITS)) + 1


def _bit(bitmap: Column, position: Column) -> Column:
    at = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int"))) != 0


def record(ids: DataFrame, base: str, key: str = "event_id", day: str = "day", blocks: int = BLOCKS) -> None:
    """Add processed ids (``key``, ``day`` as a date).  Adding ids again changes nothing."""
    base = base.rstrip("/")
    rows = ids.select(F.col(key).cast("string").alias("id"), F.col(day).cast("date").alias("day")).where("id IS NOT NULL AND day IS NOT NULL")
    rows.write.mode("append").partitionBy("day").parquet(f"{base}/ids")
    bits = rows.select("day", _block(F.col("id"), blocks).alias("block"), F.explode(F.array(*[_probe(F.col("id"), k) for k in range(PROBES)])).alias("p"))
    bits.groupBy("day", "block").agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")) \
        .write.mode("append").partitionBy("day").parquet(f"{base}/filters")


def _window(spark: SparkSession, path: str, schema: str, last_day, days: int) -> DataFrame:
    """The partitions of the ``days`` days that end with ``last_day``."""
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    last = F.lit(str(last_day)).cast("date")
    return rows.where((F.col("day") > F.date_sub(last, days)) & (F.col("day") <= last))


def filters(spark: SparkSession, base: str, last_day, days: int = WINDOW_DAYS) -> DataFrame:
    """(day, block, bitmap) of the window, merged."""
    stored = _window(spark, f"{base.rstrip('/')}/filters", "block int, bitmap binary, day date", last_day, days)
    return stored.groupBy("day", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def possible(incoming: DataFrame, base: str, last_day, key: str = "event_id", days: int = WINDOW_DAYS, blocks: int = BLOCKS) -> DataFrame:
    """(id, day) that the filters do not rule out."""
    spark = incoming.sparkSession
    own = incoming.select(F.col(key).cast("string").alias("id")).where("id IS NOT NULL").distinct().withColumn("block", _block(F.col("id"), blocks))
    stored = filters(spark, base, last_day, days)
    if days * blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES:
        stored = F.broadcast(stored)
    hit = None
    for k in range(PROBES):
        bit = _bit(F.col("bitmap"), _probe(F.col("id"), k))
        hit = bit if hit is None else hit & bit
    return own.join(stored, "block").where(hit).select("id", "day")


def stored_ids(spark: SparkSession, base: str, hit_days: list[dt.date], last_day, days: int = WINDOW_DAYS) -> DataFrame:
    """The ids of some days of the window: other days' folders are pruned."""
    rows = _window(spark, f"{base.rstrip('/')}/ids", "id string, day date", last_day, days)
    return rows.where(F.col("day").isin(hit_days) if hit_days else F.lit(False))


def unseen(incoming: DataFrame, base: str, last_day, key: str = "event_id", days: int = WINDOW_DAYS, blocks: int = BLOCKS) -> DataFrame:
    """Rows of ``incoming`` whose id is not in the inbox of the window (rows without
    an id stay; repeated rows stay, as in ``append.unseen``)."""
    spark = incoming.sparkSession
    ensure_checkpoint_dir(spark)
    maybe = possible(incoming, base, last_day, key, days, blocks).checkpoint(eager=True)
    hit_days = [r.day for r in maybe.select("day").distinct().collect()]  # at most ``days`` of them
    known = stored_ids(spark, base, hit_days, last_day, days).distinct()
    seen = maybe.join(known, ["id", "day"], "left_semi").select(F.col("id").alias("_seen")).distinct()
    return incoming.join(seen, F.col(key).cast("string") == F.col("_seen"), "left_anti")
