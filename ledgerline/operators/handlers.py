"""Handler registry: one DataFrame function per event type, and one routed pass.

A handler takes the rows of its event type and returns one row for each of them
with the row's key, ``ok`` (handled) and optionally ``error``.  Rows are routed
once: they are written to one folder per route in the shared folder, and each
handler reads its own folder only, so neither the source nor the decode runs once
per handler, and a type that holds most rows stays spread over many files.  Types
without a handler take the default branch, which acknowledges them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

HandlerFn = Callable[[DataFrame], DataFrame]
DEFAULT_ROUTE = "default"
NO_RESULT = "NO_RESULT"


def acknowledge(rows: DataFrame) -> DataFrame:
    """The default branch: every row is handled."""
    return rows.withColumn("ok", F.lit(True))


def resolved_type(properties: Column, payload: Column, unknown: str = "Unknown") -> Column:
    """The event type of a message: its property, else the payload's own field
    (a publisher may send a bare body), else ``unknown``."""
    inside = F.from_json(payload, "eventType STRING")["eventType"]
    return F.coalesce(properties["eventType"], inside, F.lit(unknown))


class HandlerRegistry:
    """Handlers by event type.  ``key`` names the column that identifies a row."""

    def __init__(self, default: HandlerFn = acknowledge, key: str = "id"):
        self.default, self.key = default, key
        self._handlers: dict[str, tuple[str, HandlerFn]] = {}

    def register(self, event_type: str, fn: HandlerFn, route: str | None = None) -> HandlerRegistry:
        """Handle ``event_type`` with ``fn``; several types may share a route name, not a type."""
        if event_type in self._handlers:
            raise ValueError(f"event type {event_type} has a handler")
        name = route or event_type
        if name == DEFAULT_ROUTE or any(r == name and f is not fn for r, f in self._handlers.values()):
            raise ValueError(f"route {name} is taken")
        self._handlers[event_type] = (name, fn)
        return self

    def handles(self, event_type: str):
        """Decorator form of ``register``."""
        return lambda fn: self.register(event_type, fn) and fn

    def route(self, event_type: Column) -> Column:
        """Route name of a row; null and unknown types take the default route."""
        out = F.lit(DEFAULT_ROUTE)
        for kind, (name, _) in self._handlers.items():
            out = F.when(event_type == kind, F.lit(name)).otherwise(out)
        return out

    def run(self, rows: DataFrame, event_type: str = "event_type", folder: str | None = None) -> DataFrame:
        """(key, route, ok, error) of every row.

        ``folder`` is where the routed rows go (replaced if it exists, so a repeated
        micro-batch replaces its own); a new one in the shared folder by default.
        A row that its handler gives no result for is not ok, with error ``NO_RESULT``.
        Keys must be unique per row."""
        spark = rows.sparkSession
        folder = folder or scratch_path(spark, f"routed/{uuid.uuid4().hex}")
        routed = rows.withColumn("_route", self.route(F.col(event_type)))
        routed.write.mode("overwrite").partitionBy("_route").parquet(folder)
        written = spark.read.schema(routed.schema).parquet(folder)
        results = None
        for name, fn in [*dict(self._handlers.values()).items(), (DEFAULT_ROUTE, self.default)]:
            done = fn(written.where(F.col("_route") == name).drop("_route"))
            error = F.col("error").cast("string") if "error" in done.columns else F.lit(None).cast("string")
            part = done.select(F.col(self.key).alias("_key"), F.coalesce(F.col("ok"), F.lit(False)).alias("ok"), error.alias("error"))
            results = part if results is None else results.unionByName(part)
        return written.select(self.key, F.col("_route").alias("route")).join(results, F.col(self.key) == F.col("_key"), "left").select(
            self.key, "route", F.coalesce("ok", F.lit(False)).alias("ok"),
            F.when(F.isnull("_key"), F.lit(NO_RESULT)).otherwise(F.col("error")).alias("error"))
