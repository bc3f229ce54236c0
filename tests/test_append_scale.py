from ledgerline.operators import append as AP


def test_partitions_of_the_inbox_join_grow_with_the_rows(spark):
    """Before: as many as the session's shuffle partitions, so a task's rows grew with the input."""
    rows = [(None if k % 50 == 0 else f"e{k % 400}", k) for k in range(1000)]
    incoming = spark.createDataFrame(rows, "event_id string, n int")
    seen = spark.createDataFrame([("e7",)] * 300 + [(f"e{k}",) for k in range(100, 200)] + [(None,)], "event_id string")
    out = AP.unseen(incoming, seen, rows_a_task=50)
    gone = {"e7", *(f"e{k}" for k in range(100, 200))}
    assert sorted(r.n for r in out.collect()) == [k for e, k in rows if e not in gone]
    assert out.rdd.getNumPartitions() == 29  # 1,401 rows of both sides, 50 a task
    assert out.columns == incoming.columns and AP.unseen(incoming.where("n < 0"), seen).count() == 0
