"""Substring dedup, SimHash and quality rules against brute force and SQL."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash

from ledgerline.llm import quality_rules, simhash, substring_dedup

from ..conftest import SF_SMALL
from .conftest import texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall((text or "").encode())


def some(x):
    return tuple((v is None, v) for v in x)


def brute_windows(rows, size=35):
    every = [split(t) for _, t in rows]
    count = collections.Counter(tuple(w[k:k + size]) for w in every for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, every):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k:k + size])] > 1:
                gone[k:k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [1, 4096, 1 << 20])
def test_windows_equal_brute_force(awkward, block_bytes):
    got = [tuple(r) for r in substring_dedup.repeated_words(awkward, block_bytes=block_bytes).collect()]
    assert sorted(got, key=some) == sorted(brute_windows(texts()), key=some)


def test_removed_texts_keep_rows_and_columns(awkward, nothing):
    got = substring_dedup.remove_repeats(awkward)
    assert got.columns == awkward.columns and got.count() == awkward.count()
    want = {i: x for (i, t), x in zip(texts(), brute_windows(texts())) if i is not None}
    for r in got.where("doc_id is not null").collect():
        if want[r.doc_id][2]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3]
        else:
            assert r.text in [t for i, t in texts() if i == r.doc_id]
    assert substring_dedup.remove_repeats(nothing).collect() == []
    assert substring_dedup.repeated_words(nothing).collect() == []


def brute_groups(rows, shingle=4, bits=4):
    prints = []
    for _, t in rows:
        w = [x.lower() for x in split(t)]
        h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + shingle]), 42) for k in range(max(1, len(w) - shingle + 1))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [(i, f"{p:016x}", least.get(top(k))) for k, ((i, _), p) in enumerate(zip(rows, prints))]


def test_groups_equal_brute_force(awkward, nothing):
    got = [tuple(r) for r in simhash.near_groups(awkward).collect()]
    want = brute_groups(texts())
    assert sorted(got, key=some) == sorted(want, key=some)
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for i, _, c in want if i == c and c is not None})
    assert kept.where("doc_id is null").count() == sum(i is None for i, _ in texts())
    assert simhash.near_groups(nothing).collect() == [] and simhash.keep_one(nothing).collect() == []


@pytest.mark.parametrize("tile", [16, 1024])
def test_links_lose_nothing_in_dense_groups(spark, tile):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2 ** 63, 4, dtype=np.uint64)
    x = set(rng.integers(0, 2 ** 63, 200, dtype=np.uint64).tolist())
    for c in centre.tolist():  # dense balls: chains of single-bit steps and spread points
        for _ in range(60):
            y = c
            for b in rng.integers(0, 64, int(rng.integers(0, 6))).tolist():
                y ^= 1 << b
            x.add(y)
    x = np.array(sorted(x), np.uint64)
    nodes = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint")
    tied = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4, tile=tile)).collect()}
    label = np.arange(len(x))
    for a in range(len(x)):
        for b in np.flatnonzero(np.bitwise_count(x ^ x[a]) <= 4).tolist():
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
    signed = x.view(np.int64).tolist()
    got = [tied.get(v, v) for v in signed]
    pairs = lambda z: {(a, b) for a in range(len(z)) for b in range(a) if z[a] == z[b]}
    assert pairs(got) == pairs(label.tolist())


def test_bands_cover_every_close_pair():
    for nodes in (10, 10 ** 6, 10 ** 9, 10 ** 12):
        bands = simhash.bands_for(nodes, 4)
        masks = [m % (1 << 64) for m in simhash.band_masks(bands, 4)]
        rng = np.random.default_rng(bands)
        for _ in range(200):
            flips = sum(1 << b for b in rng.choice(64, 4, replace=False).tolist())
            assert any(flips & m == 0 for m in masks)


def test_rules_equal_sql(spark, awkward, nothing):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    got = quality_rules.quality_report(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(quality_rules.ORACLE).fetchall())
    report = {r.doc_id: r for r in quality_rules.quality_report(awkward).where("doc_id is not null and doc_id <> 7").collect()}
    for i, t in texts():
        if i not in report:
            continue
        w = split(t)
        tri = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        r = report[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(hit)), i
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines))), i
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept), i
    assert not report[45].kept and not report[30].kept and report[40].kept
    assert quality_rules.quality_report(nothing).collect() == [] and quality_rules.keep_good(nothing).collect() == []


def test_cascade_order_changes_work_not_verdict(awkward):
    from pyspark.sql import functions as F

    text = quality_rules.clean(awkward["text"])
    forth = quality_rules.first_failed(text, list(quality_rules.RULES)).isNull()
    back = quality_rules.first_failed(text, list(reversed(quality_rules.RULES))).isNull()
    assert awkward.where(forth != back).count() == 0
    kept = quality_rules.keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.where(forth).count()
    marked = quality_rules.apply_rules(awkward).groupBy("failed_rule").agg(F.count("*")).collect()
    assert len(marked) > 2


def test_repeats_by_words_and_by_hash_agree(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, "a b c a b c d e f a b " + "z y " * k) for k in range(6)], "k int, t string")
    found = rows.select(quality_rules.n_repeat_words(quality_rules.words_of(F.col("t")), 2).alias("n"), "t").collect()
    for r in found:
        w = r.t.split()
        two = collections.Counter(zip(w, w[1:]))
        assert r.n == len({k + j for k in range(len(w) - 1) if two[w[k], w[k + 1]] > 1 for j in (0, 1)})


def thue_morse(n, flip):
    """Words of 2**n letters whose polynomial hashes modulo 2**64 are equal for both flips from n = 10 on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word.translate(str.maketrans("ab", "ba")) if flip else word


def test_words_of_low_structure_are_told_apart(spark):
    shared = words_of(34)
    rows = [(1, shared + " " + thue_morse(11, False)), (2, shared + " " + thue_morse(11, True)), (3, shared + " " + thue_morse(11, True) + " tail")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in substring_dedup.repeated_words(frame).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == sorted(brute_windows(rows)) and [r[2] for r in got] == [0, 35, 35]


def words_of(n):
    return " ".join(f"w{k}" for k in range(n))


def test_hashes_of_a_word_do_not_depend_on_where_it_stands():
    from ledgerline.llm.common import exact_word_hashes, spans
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 200)).astype(np.uint8)) for _ in range(300)] + [thue_morse(10, f).encode() for f in (0, 1)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]))
    for seed in (0, 1):
        got = exact_word_hashes(data, starts, ends, seed)
        alone = [exact_word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), seed)[0] for w in words]
        assert got.tolist() == [int(a) for a in alone] and len(set(got.tolist())) == len(set(words))
    assert (exact_word_hashes(data, starts, ends, 0) != exact_word_hashes(data, starts, ends, 1)).all()


def test_one_row_of_every_group_stays(spark):
    """An id with texts of two groups leads one of them and follows in the other."""
    a, b = " ".join(f"alpha{k}" for k in range(60)), " ".join(f"beta{k}" for k in range(60))
    rows = [(3, b, "x"), (7, a, "x"), (7, b, "x"), (9, a, "x"), (None, a, "x"), (7, a, "y"), (11, a.upper(), "x"), (3, b.upper(), "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, more string")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text.lower() == a) for r in kept.collect()))
    assert got == [(False, 3, False), (False, 7, True), (True, 0, True)]
