from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline.operators import lifecycle as M
from ledgerline.operators.log_queries import poll_batch, retry_batch

from .conftest import NOW
from .helpers import by_id, log_rows, ts


def test_retry_increments_then_backs_off(spark):
    log = log_rows(spark, [{"id": 1, "status": "PROCESSING", "retry_count": 1}])
    out = by_id(M.handle_failure(log, spark.createDataFrame([(1, "boom")], "id long, error string"), NOW))[1]
    assert out["status"] == S.FAILED and out["retry_count"] == 2
    assert out["next_retry_at"] == ts("2024-01-31 00:00:04")  # 2^2 s after now
    assert out["error_message"] == "boom" and out["version"] == 1


def test_dead_letter_at_ceiling_keeps_count(spark):
    log = log_rows(spark, [{"id": 1, "status": "PROCESSING", "retry_count": 3}])
    out = by_id(M.handle_failure(log, spark.createDataFrame([(1, "boom")], "id long, error string"), NOW))[1]
    assert out["status"] == S.DEAD_LETTER and out["retry_count"] == 3
    assert out["error_message"] == "Max retries exceeded: boom" and out["next_retry_at"] is None


def test_fail_fail_then_succeed_is_published(spark):
    log = log_rows(spark, [{"id": 1}])
    fail = spark.createDataFrame([(1, "timeout", False)], "id long, error string, ok boolean")
    okay = spark.createDataFrame([(1, None, True)], "id long, error string, ok boolean")
    now = ts(NOW)
    for i, outcome in enumerate([fail, fail, okay]):
        t = now.replace(minute=i * 10)
        log = M.reset_due_failed(log, t, limit=None)
        log = M.delivery_step(log, outcome, t)
        log = spark.createDataFrame(log.collect(), S.EVENT_LOG)
    row = by_id(log)[1]
    assert row["status"] == S.PUBLISHED and row["retry_count"] == 2


def test_b1_unreachable_dead_letter_and_sweep(spark):
    """Third failure leaves the row FAILED with count 3; the retry query never
    picks it; only the dead-letter sweep moves it (both branches of B1)."""
    log = log_rows(spark, [{"id": 1, "status": "PROCESSING", "retry_count": 2}])
    log = M.handle_failure(log, spark.createDataFrame([(1, "x")], "id long, error string"), NOW)
    row = by_id(log)[1]
    assert row["status"] == S.FAILED and row["retry_count"] == 3
    assert retry_batch(log, "2024-02-01 00:00:00").count() == 0
    swept = by_id(M.dead_letter_sweep(log, NOW))[1]
    assert swept["status"] == S.DEAD_LETTER


def test_recover_stuck_only_old(spark):
    log = log_rows(spark, [{"id": 1, "status": "PROCESSING", "updated_at": ts("2024-01-30 23:50:00")},
                           {"id": 2, "status": "PROCESSING", "updated_at": ts("2024-01-30 23:59:00")}])
    out = by_id(M.recover_stuck(log, NOW))
    assert out[1]["status"] == S.PENDING and out[1]["error_message"] == S.STUCK_RECOVERED_MESSAGE
    assert out[2]["status"] == S.PROCESSING and out[2]["error_message"] is None


def test_poll_orders_and_ties(spark):
    t = ts("2024-01-30 00:00:00")
    log = log_rows(spark, [{"id": i, "created_at": t} for i in (5, 3, 9)] +
                   [{"id": 1, "next_retry_at": ts("2024-02-05 00:00:00")}])
    assert [r["id"] for r in poll_batch(log, NOW, limit=2).collect()] == [3, 5]


def test_purge_is_null_safe_and_counts(spark):
    log = log_rows(spark, [{"id": 1, "status": "PUBLISHED", "published_at": ts("2024-01-01 00:00:00")},
                           {"id": 2, "status": "PUBLISHED", "published_at": None},
                           {"id": 3, "status": "PUBLISHED", "published_at": ts("2024-01-30 00:00:00")}])
    kept, deleted = M.purge(log, NOW)
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]
    assert deleted.first()["deleted"] == 1


def test_claim_broadcasts_only_bounded_batch(spark):
    log = log_rows(spark, [{"id": i} for i in range(10)])
    plan = M.claim(log, poll_batch(log, NOW, limit=3), NOW)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
    assert M.claim(log, poll_batch(log, NOW, limit=3), NOW).where(F.col("status") == S.PROCESSING).count() == 3


def test_stored_log_prunes_to_active_partition(spark):
    from ledgerline.session import scratch_path
    from ledgerline.sources.derive import outbox_from_events
    from ledgerline.sources.sinks import read_active, write_event_log
    from ledgerline.sources.tables import table

    from .conftest import SF_SMALL
    log = outbox_from_events(table(spark, SF_SMALL, "events"))
    path = write_event_log(log, scratch_path(spark, "log-test"), 1)
    active = read_active(spark, path)
    plan = active._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status_group" in plan
    batch = poll_batch(active.drop("status_group"), NOW)
    assert [r.id for r in batch.collect()] == [r.id for r in poll_batch(log, NOW).collect()]


def test_snapshot_commits_and_cycles(spark):
    from ledgerline.session import scratch_path
    from ledgerline.sources.derive import outbox_from_events, publish_outcomes
    from ledgerline.sources.sinks import commit_snapshot, latest_version, read_latest
    from ledgerline.sources.tables import table
    import uuid

    from .conftest import SF_SMALL
    base = scratch_path(spark, f"log-{uuid.uuid4().hex[:8]}")
    log = outbox_from_events(table(spark, SF_SMALL, "events"))
    assert latest_version(spark, base) == 0
    assert commit_snapshot(log, base) == 1
    outcomes = publish_outcomes(log)
    v = M.run_cycle(spark, base, outcomes, NOW)
    assert v == 2 and latest_version(spark, base) == 2
    cur = read_latest(spark, base, S.EVENT_LOG)
    assert cur.count() == log.count()
    still = cur.where(F.col("status") == S.PROCESSING)
    # only rows touched within the last 5 minutes may still be PROCESSING
    assert still.where(F.col("updated_at") < F.lit("2024-01-30 23:55:00").cast("timestamp_ntz")).count() == 0
    pending_before = log.where(F.col("status") == S.PENDING).count()
    assert cur.where(F.col("status") == S.PENDING).count() >= pending_before - 100
