"""Small hand-made event-log rows for tests."""

from __future__ import annotations

import datetime as dt

from ledgerline import schemas as S


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def log_rows(spark, rows: list[dict]):
    base = {"aggregate_id": "order-123", "aggregate_type": "ORDER", "event_type": "OrderCreated",
            "payload": '{"orderId":"order-123"}', "status": "PENDING", "retry_count": 0, "error_message": None,
            "partition_key": "order-123", "correlation_id": None, "metadata": None,
            "created_at": ts("2024-01-30 00:00:00"), "updated_at": ts("2024-01-30 00:00:00"),
            "published_at": None, "next_retry_at": None, "version": 0}
    data = []
    for r in rows:
        d = dict(base)
        d.update(r)
        data.append(tuple(d[f] for f in S.EVENT_LOG.fieldNames()))
    return spark.createDataFrame(data, S.EVENT_LOG)


def by_id(df):
    return {r["id"]: r for r in df.collect()}
