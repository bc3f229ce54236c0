"""Chains of appends and reads as of many versions and times, against plain folds."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerline.operators import append as A
from ledgerline.operators import projection as P
from ledgerline.operators.ordering import running_max
from ledgerline.sources.derive import enrich_order_events, order_events_from_orders
from ledgerline.sources.tables import table

from .conftest import NOW, SF_SMALL


def test_a_chain_is_accepted_up_to_its_gap(spark):
    current = spark.createDataFrame([("a", 3), ("a", 2), ("b", 7)], "aggregate_id string, version long")
    asked = [("a", 3, 1), ("a", 4, 2), ("a", 5, 3), ("a", 7, 4), ("a", 8, 5), ("a", 2, 6), ("a", 4, 7), ("b", 8, 8), ("new", 0, 9), ("new", 1, 10),
             ("none", 1, 11), ("b", 7, 12), ("a", None, 13), (None, 0, 14)]
    got = A.append_chain(current, spark.createDataFrame(asked, "aggregate_id string, expected_version long, n int"), ["n"])
    assert got.columns == ["aggregate_id", "expected_version", "n", "current_version", "accepted"]
    assert {r.n: r.accepted for r in got.collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: True, 9: True, 10: True,
                                                         11: False, 12: True, 13: False, 14: True}


def test_chains_against_a_loop_with_a_hot_aggregate(spark):
    rng = random.Random(6)
    heads = {f"k{k}": rng.randrange(5) for k in range(30)}
    asked = [("hot", v, v) for v in range(400) if v != 333] + [("hot", rng.randrange(400), 1000 + k) for k in range(200)]
    asked += [(f"k{rng.randrange(40)}", rng.randrange(9), 2000 + k) for k in range(500)]
    current = spark.createDataFrame(list(heads.items()), "aggregate_id string, version long")
    got = {r.n for r in A.append_chain(current, spark.createDataFrame(asked, "aggregate_id string, expected_version long, n int").repartition(6), ["n"])
           .where("accepted").collect()}
    want, at = set(), dict(heads)
    for key, expected, n in sorted(asked, key=lambda r: (r[0], r[1], r[2])):
        if expected == at.get(key, 0):
            want.add(n)
            at[key] = expected + 1
    assert got == want


def test_running_max_with_keys_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), k, rng.choice([None, rng.randrange(50)])) for k in range(400)]
    got = running_max(spark.createDataFrame(rows, "k string, t int, v int").repartition(7), ["k"], ["t"], ["v"])
    best, want = {}, set()
    for k, t, v in rows:
        best[k] = max((x for x in (best.get(k), v) if x is not None), default=None)
        want.add((k, t, v, best[k]))
    assert {tuple(r) for r in got.collect()} == want


def test_states_equal_the_fold_of_each_request(spark):
    ev = enrich_order_events(order_events_from_orders(table(spark, SF_SMALL, "orders")), table(spark, SF_SMALL, "lineitem"))
    keys = [r.order_id for r in ev.select("order_id").distinct().orderBy("order_id").limit(60).collect()]
    ev = ev.where(F.col("order_id").isin(keys)).cache()
    times = [dt.datetime(1992, 1, 1), dt.datetime(1995, 6, 1, 12), dt.datetime(2030, 1, 1)]
    cols = [c for c in P.READ_MODEL_COLS]
    for by, points in (("version", [0, 1, 2, 4]), ("time", times)):
        asked = [(f"{k}-{n}", k, p) for k in [*keys, 10 ** 9] for n, p in enumerate(points)]
        requests = spark.createDataFrame(asked, f"request_id string, order_id long, as_of {'long' if by == 'version' else 'timestamp_ntz'}")
        for mode in P.MODES:
            got = P.states_as_of(ev, requests, NOW, by, mode).cache()
            assert got.count() == len(asked)
            for n, p in enumerate(points):
                one = P.state_as_of(ev, NOW, max_seq=p if by == "version" else None, at=p if by == "time" else None, mode=mode)
                mine = got.where(F.col("request_id").endswith(f"-{n}") & F.col("found")).select(cols)
                assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, one.select(cols).collect()))
            got.unpersist()
    since = P.events_since(ev, spark.createDataFrame([("r", keys[0], 1)], "request_id string, order_id long, since long"))
    assert {r.seq for r in since.collect()} == {r.seq for r in ev.where(f"order_id = {keys[0]} AND seq > 1").collect()}
