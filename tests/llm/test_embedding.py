"""Embedding near-dedup against brute force in double precision."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerline.llm import embedding_dedup as E

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("label", T.IntegerType())]
                      + [T.StructField(c, T.StringType()) for c in ("key", "nid", "node", "copies", "dim", "vec", "cell", "root", "links", "a")])


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept); every row is a vertex."""
    good = [usable(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.ldexp(np.array(rows[k][1]), -int(np.frexp(max(map(abs, rows[k][1])))[1])) for k in (a, b))
                link[a, b] = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold
    joined = link.copy()
    for a in range(n):
        for b in range(n):
            joined[a, b] |= a == b
    seen = [None] * n
    for a in range(n):
        todo, group = [a], {a}
        while todo:
            for b in np.flatnonzero(joined[todo.pop()]).tolist():
                if b not in group:
                    group.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in group if rows[b][0] is not None]
        seen[a] = min(ids) if ids else None
    return [(rows[a][0], int(link[a].sum()), seen[a], rows[a][0] == seen[a]) for a in range(n)]


def cloud(seed, n, dim, centres, noise):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dim))
    return (base[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dim))).tolist()


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0, *["x"] * 10) for i, v in rows], SCHEMA).repartition(3)
    got = E.near_vectors(frame, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return order([tuple(r) for r in got.collect()])


@pytest.mark.parametrize("noise, strip", [(0.15, 8192), (0.25, 64), (0.33, 64)])
def test_links_of_clouds(spark, noise, strip):
    rows = list(enumerate(cloud(3, 260, 12, 25, noise)))
    want = order(brute(rows))
    assert run(spark, rows, strip=strip) == want
    assert any(r[1] for r in want) and not all(r[1] for r in want)


def test_awkward_vectors(spark):
    v = cloud(5, 12, 8, 3, 0.1)
    rows = [(k, x) for k, x in enumerate(v)] + [(k + 50, x) for k, x in enumerate(v[:4])] * 2
    rows += [(100, None), (101, []), (102, [0.0] * 8), (103, [None] + v[0][1:]), (104, [float("nan")] * 8), (105, [float("inf")] + v[0][1:]),
             (106, [1e300 * x for x in v[1]]), (107, [1e-290 * x for x in v[1]]), (108, [-x for x in v[1]]), (109, v[2][:7]), (110, v[2] + [0.0]),
             (111, [-0.0, 1.0]), (112, [0.0, 1.0]), (113, [0.95, (1 - 0.95 ** 2) ** 0.5 - 1e-9]), (114, [1.0, 0.0]),
             (None, v[3]), (None, [5.0, -1.0, 2.0]), (None, [5.0, -1.0, 2.0]), (None, None), (7, v[0]), (-3, v[4]), (120, [3.0]), (121, [-2.0])]
    assert run(spark, rows) == order(brute(rows))


def test_empty_table_and_copies(spark):
    assert run(spark, []) == []
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(40)] + [(k, [1.0, -2.0, 0.5 + k]) for k in range(40, 60)]
    assert run(spark, rows, strip=64) == order(brute(rows))


def test_codes_never_hide_a_link():
    """The bound holds for every pair, also for vectors with one large component."""
    rng = np.random.default_rng(1)
    for dim in (1, 2, 7, 64, 1100):
        x = rng.normal(size=(120, dim)) * rng.choice([1, 1, 1, 40], size=(120, dim))
        x[60:] = x[:60] + rng.normal(size=(60, dim)) * rng.uniform(0, 1.2, size=(60, 1)) * np.abs(x[:60]).mean(axis=1, keepdims=True)
        coded = E.Coded(x)
        i, j = (z.ravel() for z in np.meshgrid(np.arange(120), np.arange(120), indexing="ij"))
        exact = E.cosines(coded, coded, i, j)
        for threshold in (0.5, 0.8, 0.95, 0.999):
            kept = set(zip(*(z.tolist() for z in E.possible(coded, coded, threshold))))
            need = {(a, b) for a, b, c in zip(i.tolist(), j.tolist(), exact.tolist()) if c >= threshold}
            assert need <= kept
            got = set(zip(*(z.tolist() for z in E.linked(coded, coded, threshold))))
            assert got == need


def test_keep_one(spark):
    random.seed(1)
    v = cloud(9, 30, 6, 5, 0.05)
    rows = [(k, x) for k, x in enumerate(v)] + [(None, v[0]), (300, None)]
    frame = spark.createDataFrame([(i, x, 0, *["x"] * 10) for i, x in rows], SCHEMA)
    kept = E.keep_one(frame)
    want = {r[0] for r in brute(rows) if r[3]} | {None}
    assert {r.vec_id for r in kept.collect()} == want and kept.columns == frame.columns
