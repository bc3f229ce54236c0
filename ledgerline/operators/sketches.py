"""A11 / A16 at scale: quantile sketches per minute that merge into hours and days.

A KLL sketch of a fixed size stands for all values of a minute; sketches of any
periods merge, so a day's percentiles come from its minutes without reading rows
again.  ``measured_error`` compares with the rows: the error of a quantile is how far the
share of values up to the estimate is from the asked one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: about 0.7 % of rank error.
K = 400
PROBS = (0.5, 0.95, 0.99)


def minute_sketches(rows: DataFrame, ts_col: str, value: Column, by: list | None = None, k: int = K) -> DataFrame:
    """(by..., minute, sketch, n, low, high) of a value; nulls are left out."""
    keys = list(by or [])
    own = rows.select(*keys, F.date_trunc("minute", F.col(ts_col)).cast("timestamp_ntz").alias("minute"), value.cast("double").alias("_v")).where("_v IS NOT NULL")
    return own.groupBy(*keys, "minute").agg(F.kll_sketch_agg_double("_v", k).alias("sketch"), F.count(F.lit(1)).alias("n"),
                                            F.min("_v").alias("low"), F.max("_v").alias("high"))


def roll_up(sketches: DataFrame, unit: str, by: list | None = None, period: str = "minute", k: int = K) -> DataFrame:
    """Merge sketches of short periods into longer ones (``unit``: hour, day, month)."""
    keys = list(by or [])
    longer = sketches.withColumn(period, F.date_trunc(unit, F.col(period)).cast("timestamp_ntz")).withColumnRenamed(period, unit)
    return longer.groupBy(*keys, unit).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"),
                                           F.min("low").alias("low"), F.max("high").alias("high"))


def quantiles(sketches: DataFrame, probs=PROBS) -> DataFrame:
    """The sketches with a column per probability (``p50`` ...)."""
    return sketches.withColumns({f"p{round(p * 100)}": F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in probs}).drop("sketch")


def measured_error(rows: DataFrame, estimates: DataFrame, ts_col: str, value: Column, unit: str, probs=PROBS) -> DataFrame:
    """(unit, n, error_p50, ...): the distance between the asked probability and the ranks
    that the estimate has among the rows (0 inside them: ties share a range of ranks)."""
    own = rows.select(F.date_trunc(unit, F.col(ts_col)).cast("timestamp_ntz").alias(unit), value.cast("double").alias("_v")).where("_v IS NOT NULL")
    names = [f"p{round(p * 100)}" for p in probs]
    joined = own.join(estimates.select(unit, *names), unit)
    agg = [f(F.col("_v"), F.col(n)).alias(f"{tag}_{n}") for n in names
           for tag, f in (("below", lambda v, e: F.avg((v < e).cast("int"))), ("upto", lambda v, e: F.avg((v <= e).cast("int"))))]
    ranks = joined.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), *agg)
    return ranks.select(unit, "n", *[F.greatest(F.col(f"below_{n}") - p, F.lit(p) - F.col(f"upto_{n}"), F.lit(0.0)).alias(f"error_{n}")
                                     for n, p in zip(names, probs)])
