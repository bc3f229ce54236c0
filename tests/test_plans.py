"""Plan-shape checks for scale: every registered batch query is free of
cartesian / nested-loop joins and Python evaluation; key folds aggregate
partially; top-k stays a bounded per-task top-k; scans are column-pruned."""

import pytest

from ledgerline.plans.catalog import all_queries

from .conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(spark, name):
    return all_queries()[name].fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


AGGREGATES = ("HashAggregate(", "SortAggregate(", "ObjectHashAggregate(")


def _single_task_inputs(plan: str) -> list:
    """Operators feeding one task: the child of every single-partition
    exchange, and windows without a partition key (other than the table of
    one row per range partition)."""
    lines = plan.split("\n")
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1].split("+- ", 1)[-1] if i + 1 < len(lines) else ""
            if not child.startswith(AGGREGATES):
                out.append(child[:100])
        if "Window [" in line and "windowspecdefinition(_pid" not in line \
                and "windowspecdefinition(" in line and "], [], [" in line:
            out.append(line.strip()[:100])
    return out


def test_no_cross_joins_or_python_in_batch_queries(spark):
    """Also: only aggregated rows (a partial aggregate or the per-partition
    offsets) ever move into a single task."""
    bad = []
    for name, q in sorted(all_queries().items()):
        if q.fn.__module__.endswith("q_streaming"):
            continue
        p = q.fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        bad += [(name, f) for f in FORBIDDEN if f in p]
        bad += [(name, f) for f in _single_task_inputs(p)]
    assert bad == []


@pytest.mark.parametrize("name", ["w01_projection_dedup", "w01_projection_as_delivered", "m11_upsert_snapshot"])
def test_projection_is_partial_aggregate_without_window(spark, name):
    p = _plan(spark, name)
    assert "partial_max_by" in p
    assert "Window [" not in p


def test_poll_is_bounded_top_k_with_pruned_scan(spark):
    p = _plan(spark, "t01_poll_batch")
    assert "TakeOrderedAndProject(limit=100" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in p
