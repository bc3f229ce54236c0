"""Readers for the driver tables and for tables this library writes.

Reads are lazy: Catalyst prunes columns and pushes filters into the Parquet
scan, so readers never select or filter eagerly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """An event log written by this library (fixed schema, no inference)."""
    return spark.read.schema(schemas.EVENT_LOG).parquet(path)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """The orders write model."""
    return spark.read.schema(schemas.ORDERS).parquet(path)


def read_order_view(spark: SparkSession, path: str) -> DataFrame:
    """The order read model."""
    return spark.read.schema(schemas.READ_MODEL).parquet(path)
