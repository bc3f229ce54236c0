from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline.operators import lifecycle as M
from ledgerline.session import scratch_path
from ledgerline.sources import log_store as L
from ledgerline.sources.derive import outbox_from_events, publish_outcomes
from ledgerline.sources.sinks import commit_snapshot, read_latest
from ledgerline.sources.tables import table

from .conftest import NOW, SF_SMALL
from .helpers import log_rows, ts


def rows(df):
    return sorted(tuple(r) for r in df.select(*M.LIFE_COLS).withColumn("updated_at", F.col("updated_at").cast("string"))
                  .na.fill("").withColumn("published_at", F.coalesce(F.col("published_at").cast("string"), F.lit("")))
                  .withColumn("next_retry_at", F.coalesce(F.col("next_retry_at").cast("string"), F.lit(""))).collect())


def test_cycles_equal_whole_snapshots_and_read_active_only(spark, tmp_path):
    log = outbox_from_events(table(spark, SF_SMALL, "events"))
    whole, parts = str(tmp_path / "whole"), scratch_path(spark, f"store-{tmp_path.name}")
    commit_snapshot(log, whole)
    assert L.create(log, parts) == 1
    outcomes = publish_outcomes(log)
    for k in range(3):
        now = f"2024-01-31 00:0{k * 3}:00"
        M.run_cycle(spark, whole, outcomes, now, limit=20)
        plan = M.cycle(L.read_active(spark, parts), outcomes, now, limit=20)
        read = [f for f in plan.inputFiles() if parts in f]
        assert read and all("status_group=active" in f for f in _scanned(plan, parts))
        assert M.run_store_cycle(spark, parts, outcomes, now, limit=20) == k + 2
    want = read_latest(spark, whole, S.EVENT_LOG)
    assert rows(L.read_log(spark, parts)) == rows(want)
    assert rows(L.read_done(spark, parts)) == rows(want.where("status = 'PUBLISHED'"))
    assert len(L.folders(spark, parts, "active")) == 1 and len(L.folders(spark, parts, "done")) == 4


def _scanned(plan, parts):
    """Partition directories that the scans of a plan keep after pruning."""
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status_group" in text and "(status_group" in text and "= active)" in text
    return [r.f for r in plan.sparkSession.read.parquet(*[f for f in plan.inputFiles() if "status_group=active" in f])
            .select(F.input_file_name().alias("f")).distinct().collect()]


def test_append_retention_and_compaction(spark, tmp_path):
    base = str(tmp_path / "log")
    assert L.read_log(spark, base).count() == 0 and L.version(spark, base) == 0
    old = ts("2024-01-01 00:00:00")
    L.create(log_rows(spark, [{"id": 1, "status": "PUBLISHED", "published_at": old}, {"id": 2, "status": "PENDING"}]), base)
    L.append(log_rows(spark, [{"id": 3}, {"id": 4, "status": "PUBLISHED", "published_at": ts("2024-01-30 12:00:00")}]), base)
    assert {r.id for r in L.read_active(spark, base).collect()} == {2, 3}
    assert {r.id for r in L.read_done(spark, base).collect()} == {1, 4}
    before = L.folders(spark, base, "active")
    L.purge_done(spark, base, NOW)
    assert {r.id for r in L.read_log(spark, base).collect()} == {2, 3, 4} and L.folders(spark, base, "active") == before
    L.compact(spark, base)
    assert {r.id for r in L.read_log(spark, base).collect()} == {2, 3, 4}
    assert len(L.folders(spark, base, "active")) == len(L.folders(spark, base, "done")) == 1
    L.commit_cycle(L.read_active(spark, base).withColumn("status", F.lit("PUBLISHED")), base)
    assert L.read_active(spark, base).count() == 0 and L.read_done(spark, base).count() == 3


def test_unfinished_commit_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "log")
    L.create(log_rows(spark, [{"id": 1}]), base)
    log_rows(spark, [{"id": 9}]).withColumn("status_group", F.lit("active")).write.partitionBy("status_group").parquet(f"{base}/log/commit=000000000002-dead")
    assert [r.id for r in L.read_log(spark, base).collect()] == [1] and L.version(spark, base) == 1
