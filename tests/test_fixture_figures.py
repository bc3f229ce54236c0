"""The figures FIXTURES.md records for sf0.01 (computed there in two engines)."""

from pyspark.sql import functions as F

from ledgerline.operators import lifecycle as M
from ledgerline.operators import log_queries as L
from ledgerline.operators import metrics as MX
from ledgerline.operators import projection as P
from ledgerline.plans.catalog import Ctx

SF = "/root/testdata/sf0.01"


def _counts(df, col):
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def test_event_log_figures(spark):
    c = Ctx(spark, SF)
    log = c.outbox
    assert _counts(log, "status") == {"PENDING": 1000, "PROCESSING": 500, "FAILED": 500, "DEAD_LETTER": 500,
                                      "PUBLISHED": 7500}
    assert L.stuck_events(log, c.now).count() == 334
    assert M.purge(log, c.now)[0].count() == 4253
    assert L.avg_processing_seconds(log, "2000-01-01").first()[0] == 299.28
    due = log.where((F.col("status") == "FAILED") & (F.col("next_retry_at") <= F.lit(c.now).cast("timestamp_ntz")))
    assert due.count() == 500 and due.where(F.col("retry_count") < 3).count() == 300


def test_projection_figures(spark):
    c = Ctx(spark, SF)
    assert _counts(c.order_events, "event_type") == {"OrderCreated": 15203, "OrderStatusChanged": 10021,
                                                     "OrderCancelled": 1364}
    assert _counts(P.project(c.rich_events, c.now, "as_delivered"), "last_order_status") == {
        "CANCELLED": 1185, "CREATED": 5018, "SHIPPED": 7914}
    assert _counts(P.project(c.rich_events, c.now, "dedup"), "last_order_status") == {
        "CANCELLED": 1283, "CREATED": 4268, "SHIPPED": 8566}


def test_call_log_figures(spark):
    calls = Ctx(spark, SF).call_log
    assert MX.rolling_call_rates(calls).where("breach").count() == 63
    assert MX.rate_limit_excess(calls, 5, "hour").count() == 347
    peaks = {r.target: r.peak for r in MX.concurrency_peaks(calls, 5, unit_seconds=1.0).collect()}
    assert peaks == {"click": 5, "error": 6, "purchase": 6, "signup": 5, "view": 7}
