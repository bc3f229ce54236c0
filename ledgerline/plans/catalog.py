"""Registry of named queries: each is a Spark plan over the driver tables and,
where SQL can express it, an independent DuckDB oracle.

Query functions take ``(spark, sf_dir)`` and return a lazy DataFrame; nothing
is collected.  Computed columns carry the same alias in both implementations.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import derive
from ..sources.tables import table
from .oracle import NOW


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


class Ctx:
    """Lazily derived inputs for one ``sf_dir``."""

    now = NOW

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def outbox(self) -> DataFrame:
        return derive.outbox_from_events(self.t("events"))

    @property
    def order_events(self) -> DataFrame:
        return derive.order_events_from_orders(self.t("orders"))

    @property
    def rich_events(self) -> DataFrame:
        return derive.enrich_order_events(self.order_events, self.t("lineitem"))

    @property
    def orders_model(self) -> DataFrame:
        return derive.orders_write_model(self.t("orders"), self.t("lineitem"))

    @property
    def call_log(self) -> DataFrame:
        return derive.call_log(self.t("events"))


def all_queries() -> dict[str, Query]:
    # Importing the query modules fills the registry.
    from . import q_log  # noqa: F401
    for mod in _OPTIONAL:
        __import__(f"{__package__}.{mod}")
    return dict(REGISTRY)


_OPTIONAL: list[str] = ["q_lifecycle", "q_projection", "q_codec", "q_delivery", "q_metrics", "q_quality", "q_events", "q_streaming", "q_commands", "q_scale", "q_round_trip"]
