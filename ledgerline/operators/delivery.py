"""Delivery batching: key groups, size-bounded chunks, pacing and keyed
publish order (A09, W08, W09, S05, S06).

The reference publishes one poll batch (at most ``poll_limit`` rows) per
cycle, grouped by delivery key, and packs each key group greedily into
size-bounded chunks.  Replayed over a whole log, rows are numbered in poll
order with the distributed ``global_rank`` and cut into cycles of
``poll_limit``; every (cycle, key) group therefore holds at most
``poll_limit`` rows, which is what bounds ``collect_list`` and the
``aggregate`` fold below.  The greedy reset cannot be a window sum (the
running sum restarts at each chunk boundary), so it is a higher-order
``aggregate`` over the bounded, sorted group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from .ordering import global_rank, rank_within

OUT_T = T.ArrayType(T.StructType([T.StructField("id", T.LongType()),
                                  T.StructField("chunk_no", T.IntegerType()),
                                  T.StructField("size", T.LongType())]))


def delivery_key(df: DataFrame) -> F.Column:
    """A null partition key falls back to the aggregate id."""
    return F.coalesce(F.col("partition_key"), F.col("aggregate_id"))


def group_by_key(batch: DataFrame, key: F.Column | None = None) -> DataFrame:
    """One row per delivery key with the batch's ids in (created_at, id)
    order.  ``batch`` is a poll batch, so each list has at most the poll limit."""
    k = key if key is not None else delivery_key(batch)
    return (batch.groupBy(k.alias("delivery_key"))
            .agg(F.sort_array(F.collect_list(F.struct("created_at", "id"))).alias("_items"),
                 F.count(F.lit(1)).alias("n"))
            .select("delivery_key", F.col("_items.id").alias("ids"), "n"))


def with_cycles(rows: DataFrame, poll_limit: int = S.POLL_LIMIT,
                order_cols=("created_at", "id")) -> DataFrame:
    """Number rows in poll order and cut them into publish cycles of ``poll_limit``."""
    ranked = global_rank(rows, list(order_cols), "_rn")
    return ranked.withColumn("cycle", F.floor((F.col("_rn") - 1) / poll_limit).cast("bigint"))


def greedy_chunks(rows: DataFrame, key_col: str, max_bytes: int = S.MAX_BATCH_BYTES,
                  poll_limit: int = S.POLL_LIMIT, size_col: str | None = None) -> DataFrame:
    """Chunk number of each row inside its (cycle, key) group.

    A row joins the current chunk while the chunk's bytes stay within
    ``max_bytes``; otherwise it opens the next chunk.  A row larger than
    ``max_bytes`` on its own is split out (``chunk_no`` null, B11) and does
    not disturb the chunk being filled.  Returns (id, cycle, delivery_key,
    chunk_no, size).
    """
    size = F.col(size_col) if size_col else F.octet_length(F.col("payload"))
    base = with_cycles(rows.select("id", "created_at", F.col(key_col).alias("delivery_key"),
                                   size.cast("bigint").alias("size")), poll_limit)
    groups = (base.groupBy("cycle", "delivery_key")
              .agg(F.sort_array(F.collect_list(F.struct("_rn", "id", "size"))).alias("items")))
    init = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("bigint").alias("fill"),
                    F.array().cast(OUT_T).alias("out"))

    def step(acc, x):
        over = x["size"] > max_bytes
        fits = acc["fill"] + x["size"] <= max_bytes
        chunk = F.when(over | fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        fill = (F.when(over, acc["fill"]).when(fits, acc["fill"] + x["size"])
                .otherwise(x["size"]))
        assigned = F.when(~over, chunk).cast("int")
        return F.struct(chunk.alias("chunk"), fill.alias("fill"),
                        F.array_append(acc["out"], F.struct(x["id"].alias("id"),
                                                            assigned.alias("chunk_no"),
                                                            x["size"].alias("size"))).alias("out"))

    folded = groups.select("cycle", "delivery_key",
                           F.aggregate("items", init, step)["out"].alias("out"))
    chunks = folded.select("cycle", "delivery_key", F.inline("out"))
    return chunks.select("id", "cycle", "delivery_key", "chunk_no", "size")


def pacing(rows: DataFrame, key_col: str, pace_every: int = S.POLL_LIMIT,
           pace_delay_ms: int = 1000, poll_limit: int = S.POLL_LIMIT) -> DataFrame:
    """Position of each row inside its (cycle, key) publish list and the
    pause after it (``pace_delay_ms`` after every ``pace_every`` rows).

    Separate ``pace_every`` / ``pace_delay_ms`` parameters replace the single
    overloaded batch-size setting (B10).  Groups are bounded by the poll limit,
    so the window here never holds more than ``poll_limit`` rows.
    """
    base = with_cycles(rows.select("id", "created_at", F.col(key_col).alias("delivery_key")), poll_limit)
    w = Window.partitionBy("cycle", "delivery_key").orderBy("_rn")
    pos = F.row_number().over(w)
    return (base.withColumn("pos", pos)
            .withColumn("delay_ms", F.when(F.col("pos") % pace_every == 0, F.lit(pace_delay_ms))
                        .otherwise(F.lit(0)))
            .select("id", "cycle", "delivery_key", "pos", "delay_ms"))


def count_batches(rows: DataFrame, key_col: str, batch_size: int = 100) -> DataFrame:
    """W09 document variant: count-based batches of ``batch_size`` per key in
    (created_at, id) order; positions come from the skew-proof rank."""
    r = rank_within(rows.select("id", "created_at", F.col(key_col).alias("delivery_key")),
                    ["delivery_key"], ["created_at", "id"])
    return r.withColumn("batch_no", F.floor((F.col("pos") - 1) / batch_size).cast("bigint"))


def keyed_publish_order(rows: DataFrame, key_col: str, num_partitions: int) -> DataFrame:
    """Keyed, ordered publish plan for an ordered sink.

    Range-partitioned on (key, created_at, id) and sorted inside partitions:
    a key's rows form one contiguous, ordered run over consecutive partitions,
    so reading partitions in index order replays every key in order.  A key
    holding a third of the rows spans several partitions instead of one task.
    """
    order = [key_col, "created_at", "id"]
    return rows.repartitionByRange(num_partitions, *order).sortWithinPartitions(*order)


def oversize_split(rows: DataFrame, max_bytes: int = S.MAX_BATCH_BYTES):
    """(publishable, rejected) by payload size; a rejected row gets
    the error text the publisher would raise."""
    size = F.octet_length(F.col("payload"))
    ok = rows.where(size <= max_bytes)
    bad = (rows.where(size > max_bytes)
           .withColumn("error", F.lit("Event is too large to fit in a batch")))
    return ok, bad
