"""Sharding along a Hilbert curve through several metadata dimensions.

Each dimension is cut into ``2**BITS`` ranges at its quantiles (strings are
compared as a whole, their quantiles come from counts of the sorted different
values, and nothing but the edges is gathered).  A dimension with fewer ranges is
spread over the whole grid, so that it reaches the curve's leading bits like the
others.  A row's cell in that grid gives its place on the curve; rows are sorted by it and
the sorted sequence is cut into runs.  Rows near each other on the curve are
near in every dimension, so a file has a narrow range of each and a filter on
any of them skips most files.

Laws: ``rows`` (counts at most one apart) or ``bytes`` (a row goes where the
middle of its bytes falls on a scale of equal parts, so sizes differ by about
one row).

Defined results: nulls of a dimension come first; a null text has size 1 and
CRC 0; ties on the curve are sorted by id, CRC and size, and rows equal in all
of them are interchangeable; an empty table gives an empty table.  Other
columns of the input may have any names.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pin

SHARDS = 16
BITS = 6
DIMENSIONS = ("lang", "source", "size")
ACCURACY = 2000  #: of the approximate quantiles; their sketch has a fixed size


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of ``cells`` (row, dimension), each below 2**bits.

    Every level takes the leading bit of all dimensions, then mirrors and swaps
    the rest so that the next level's curve starts where this one ended."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(n):
            mirror = (x[d] & bit) > 0
            swap = np.where(mirror, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(mirror, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> level) & 1, turn ^ ((1 << level) - 1), turn)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            place = (place << 1) | ((x[d] >> level) & 1)
    return place


def code(column: Column, kind: T.DataType) -> Column:
    """A long or double that sorts like the column (strings: the column); NaN counts as null."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        number = column.cast("double")
        return F.when(~F.isnan(number), number)
    return column.cast("bigint")


def _cells(values: pd.Series, edges: np.ndarray, bits: int) -> np.ndarray:
    """Cell of each value on a scale of ``2**bits``; nulls are in the first one."""
    return _ranges(values, edges) * (2 ** bits - 1) // max(1, len(edges))


def _ranges(values: pd.Series, edges: np.ndarray) -> np.ndarray:
    if edges.dtype != object:
        return np.where(values.isna(), 0, np.searchsorted(edges, values.fillna(0).to_numpy(edges.dtype), side="right"))
    which, different = pd.factorize(values)
    cell = np.array([bisect_right(edges, v) for v in different] + [0], np.int64)
    return cell[which]


def _grid(docs: DataFrame, dimensions, size: Column) -> list[Column]:
    """A long or string for each dimension; ``size`` is the text's, whatever columns there are."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    return [code(size, T.LongType()) if d == "size" else code(docs[d], kinds[d]) for d in dimensions]


def string_edges(rows: DataFrame, name: str, steps: int) -> list[str]:
    """The different values at the ``steps``-quantiles, sorted.  One row per sorted part and the edges are gathered."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    held = pin(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", part), "strings")
    n, begin = 0, []
    for r in sorted(held.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        begin.append((r.part, n))
        n += r.n
    if not n:
        return []
    from pyspark.sql import Window

    at = F.broadcast(rows.sparkSession.createDataFrame(begin, "part bigint, rows_before bigint"))
    upto = F.col("rows_before") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    step = lambda x: F.least(F.lit(steps - 1), F.floor(x * steps / F.lit(n)))
    edges = held.join(at, "part").withColumn("upto", upto).where(step(F.col("upto")) > step(F.col("upto") - F.col("n"))).select("v")
    return sorted(r.v for r in edges.collect())


def ordered(docs: DataFrame, grid: list[Column], keep: dict[str, Column], ties: list[str], bits: int = BITS) -> DataFrame:
    """``keep``'s columns (named k_...) with ``curve``, ``part`` (sorted range of the curve) and ``at`` (place in the part)."""
    names = [f"d{k}" for k in range(len(grid))]
    rows = pin(docs.select(*[c.alias(f"k_{n}") for n, c in keep.items()], *[c.alias(n) for c, n in zip(grid, names)]), "dimensions")
    steps = [k / 2 ** bits for k in range(1, 2 ** bits)]
    texts = [isinstance(rows.schema[n].dataType, T.StringType) for n in names]
    cuts = rows.agg(F.count("*"), *[F.percentile_approx(n, steps, ACCURACY).alias(n) for n, t in zip(names, texts) if not t]).first()
    edges = [np.array(string_edges(rows, n, 2 ** bits), object) if t else np.unique(np.array(cuts[n] or [], float if dict(rows.dtypes)[n] == "double" else np.int64)) for n, t in zip(names, texts)]

    @F.pandas_udf("bigint")
    def place(*codes: pd.Series) -> pd.Series:
        cells = [_cells(c, e, bits) for c, e in zip(codes, edges)]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    curve = rows.select(*[f"k_{n}" for n in keep], place(*names).alias("curve"))
    sort = ["curve", *[f"k_{n}" for n in ties]]
    spread = curve.repartitionByRange(*sort).sortWithinPartitions(*sort)
    row = F.monotonically_increasing_id()
    return pin(spread.select("*", F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "curve")


def cut_runs(rows: DataFrame, law: str, shards: int, size: str) -> DataFrame:
    """``rows`` of ``ordered`` with shard and slot (gapless from 0 in each shard).

    Only one row per sorted part is gathered to find where the parts begin."""
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    held = sorted(tuple(r) for r in parts.collect())
    n, b, begin = 0, 0, []
    for part, rows_here, bytes_here in held:
        begin.append((part, n, b))
        n, b = n + rows_here, b + bytes_here
    at = rows.sparkSession.createDataFrame(begin, "part bigint, rows_before bigint, bytes_before bigint")
    known = rows.join(F.broadcast(at), "part").withColumn("rank", F.col("rows_before") + F.col("at"))
    if law == "rows":
        shard = F.expr(f"cast(rank * {shards} div {max(1, n)} as int)")
        first = F.expr(f"(shard * {max(1, n)} + {shards - 1}) div {shards}")
        return known.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).drop("rows_before", "bytes_before", "rank")
    from pyspark.sql import Window

    before = F.sum(size).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    middle = (F.col("bytes_before") + F.coalesce(before, F.lit(0))) * 2 + F.col(size)
    placed = known.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(1, b)))).cast("int"))
    starts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("rank") - F.col("first")) \
        .drop("rows_before", "bytes_before", "rank", "first")


def shard_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions=DIMENSIONS,
                 shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) of every row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    keep = {"doc_id": docs[id_col], "size": F.octet_length(text).cast("bigint") + 1, "text_crc32": F.crc32(F.encode(text, "UTF-8"))}
    grid = _grid(docs, dimensions, keep["size"])
    rows = cut_runs(ordered(docs, grid, keep, ["doc_id", "text_crc32", "size"]), law, shards, "k_size")
    return rows.select(F.col("k_doc_id").alias("doc_id"), F.col("k_size").alias("size"), F.col("k_text_crc32").alias("text_crc32"),
                       F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", dimensions=DIMENSIONS,
                 shards: int = SHARDS, law: str = "rows") -> None:
    """Write whole rows as ``path/shard=K``, sorted along the curve inside each shard."""
    size = F.octet_length(F.coalesce(docs[text_col], F.lit(""))).cast("bigint") + 1
    keep = {f"c{k}": docs[c] for k, c in enumerate(docs.columns)} | {"id": docs[id_col], "size": size}
    rows = cut_runs(ordered(docs, _grid(docs, dimensions, size), keep, ["id", "size"]), law, shards, "k_size")
    own = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    own.select(*[F.col(f"k_c{k}").alias(c) for k, c in enumerate(docs.columns)], F.col("shard").alias("shard")) \
        .write.partitionBy("shard").parquet(path)
