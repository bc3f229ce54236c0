"""J07 with a shadow model: compare two stored models by digests of key ranges.

A stored model is cut into ``leaves`` ranges of a hash of its key, one partition folder
each, and carries a tree of digests: for every range, at every level, how many rows
it holds and two sums of row hashes.  Two models are compared from the root down: only
the children of ranges that differ are looked at, and only the rows of leaves that
differ are read and joined.  A model that agrees with its shadow costs one digest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FAN_OUT = 16
LEAVES = 4096
#: Most leaves of a model: the list of differing ones goes through the driver.
MOST_LEAVES = 1 << 16


def _leaf(key: str, leaves: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(leaves)).cast("int")


def _row_hash(seed: int, columns: list[str]) -> Column:
    # A null leaves a hash as it was, so each column says whether it is one.
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.isnull(c), F.col(c))]).cast("decimal(38,0)")


def _levels(leaves: int) -> int:
    n = 0
    while FAN_OUT ** n < leaves:
        n += 1
    return n


def digests(model: DataFrame, key: str, columns: list[str], leaves: int = LEAVES) -> DataFrame:
    """(level, node, n, a, b) of all ranges; level 0 is the root, the last one the leaves."""
    depth = _levels(leaves)
    rows = model.select(_leaf(key, leaves).alias("_leaf"), _row_hash(1, [key, *columns]).alias("a"), _row_hash(2, [key, *columns]).alias("b"))
    leaf = rows.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    up = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("_leaf") / FAN_OUT ** (depth - k)).cast("int").alias("node")) for k in range(depth + 1)])
    return leaf.select(F.explode(up).alias("_at"), "n", "a", "b").groupBy("_at.level", "_at.node").agg(
        F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def store(model: DataFrame, base: str, key: str, columns: list[str], leaves: int = LEAVES) -> None:
    """Write a model with its digests.  Both sides of a comparison need the same
    columns, types and number of leaves."""
    if not 0 < leaves <= MOST_LEAVES:
        raise ValueError(f"leaves must be between 1 and {MOST_LEAVES}")
    base = base.rstrip("/")
    rows = model.select(key, *columns).withColumn("_leaf", _leaf(key, leaves))
    rows.repartitionByRange("_leaf", key).sortWithinPartitions("_leaf", key).write.mode("overwrite").partitionBy("_leaf").parquet(f"{base}/rows")
    stored = model.sparkSession.read.schema(rows.schema).parquet(f"{base}/rows")
    (model.sparkSession.range(1).select(F.lit(rows.schema.json()).alias("value")).coalesce(1).write.mode("overwrite").text(f"{base}/schema"))
    digests(stored, key, columns, leaves).write.mode("overwrite").partitionBy("level").parquet(f"{base}/digests")


def _digests(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema("node int, n bigint, a decimal(38,0), b decimal(38,0), level int").parquet(f"{base.rstrip('/')}/digests")


def read_model(spark: SparkSession, base: str) -> DataFrame:
    """The rows of a stored model, with their leaf (``_leaf``); also of an empty one."""
    base = base.rstrip("/")
    schema = StructType.fromJson(json.loads(spark.read.text(f"{base}/schema").first().value))
    return spark.read.schema(schema).parquet(f"{base}/rows")


def differing_leaves(spark: SparkSession, one: str, two: str, leaves: int = LEAVES) -> tuple[list[int], int]:
    """The leaves whose digests differ, and how many digests were compared to find them."""
    suspects, compared = [0], 0
    for level in range(_levels(leaves) + 1):
        nodes = suspects if level == 0 else [FAN_OUT * s + k for s in suspects for k in range(FAN_OUT)]
        sides = [_digests(spark, x).where((F.col("level") == level) & F.col("node").isin(nodes)).select("node", F.struct("n", "a", "b").alias(f"d{k}"))
                 for k, x in enumerate((one, two))]
        both = sides[0].join(sides[1], "node", "full_outer").select("node", (~F.col("d0").eqNullSafe(F.col("d1"))).alias("differs")).collect()
        compared += len(both)
        suspects = sorted(r.node for r in both if r.differs)
        if not suspects:
            break
    return suspects, compared


def compare(spark: SparkSession, one: str, two: str, key: str, columns: list[str], leaves: int = LEAVES,
            suspects: list[int] | None = None) -> DataFrame:
    """(key, cls) of every row that is not the same on both sides: ``missing`` (not in
    ``one``), ``extra`` (not in ``two``) or ``different``.  Reads differing leaves only
    (``suspects``, if they are known already)."""
    if suspects is None:
        suspects, _ = differing_leaves(spark, one, two, leaves)

    def rows(base: str, side: str) -> DataFrame:
        stored = read_model(spark, base).where(F.col("_leaf").isin(suspects) if suspects else F.lit(False))
        return stored.select(F.col(key).alias(f"{side}_key"), F.struct(*columns).alias(f"{side}_row"))

    a, b = rows(one, "a"), rows(two, "b")
    cls = (F.when(F.isnull("a_row"), "missing").when(F.isnull("b_row"), "extra").when(~F.col("a_row").eqNullSafe(F.col("b_row")), "different"))
    found = a.join(b, F.col("a_key").eqNullSafe(F.col("b_key")), "full_outer")
    return found.select(F.coalesce("a_key", "b_key").alias(key), cls.alias("cls")).where(F.col("cls").isNotNull())


def report(spark: SparkSession, one: str, two: str, key: str, columns: list[str], leaves: int = LEAVES) -> DataFrame:
    """(cls, n) with ``same`` from the digests, and ``rows_read`` and ``rows_stored`` of both models together."""
    suspects, _ = differing_leaves(spark, one, two, leaves)
    last = _levels(leaves)
    size = [_digests(spark, x).where(F.col("level") == last).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("node").isin(suspects), F.col("n"))), F.lit(0)).alias("read")) for x in (one, two)]
    stored = size[0].unionByName(size[1]).agg(F.sum("n").alias("stored"), F.sum("read").alias("read"))
    odd = compare(spark, one, two, key, columns, leaves, suspects).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    left = size[0].select("n").scalar() - odd.agg(F.coalesce(F.sum(F.when(F.col("cls").isin("extra", "different"), F.col("n"))), F.lit(0))).scalar()
    same = spark.range(1).select(F.lit("same").alias("cls"), left.alias("n"))
    return odd.unionByName(same).where("n > 0").withColumns({"rows_read": stored.select("read").scalar(), "rows_stored": stored.select("stored").scalar()})
