"""SimHash near-duplicates with pivot distance tables.

Fingerprints: lower-cased A-Z, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``shingle`` words joined by one space (a shorter text is one shingle, no words:
fingerprint zero), XXH64 with seed 42; a bit is set if over half of the
shingles' hashes have it.

Links: equal fingerprints become one node first, so copies cost nothing.  Two
nodes at most ``max_bits`` apart agree in at least ``bands - max_bits`` of
``bands`` bit bands, so every such choice of bands is a group key and no link
is lost; ``bands`` grows with the number of nodes to keep groups small.  A group
larger than ``TILE`` is cut into chunks that meet tile by tile.  Inside a tile,
each node has a row of Hamming distances to ``PIVOTS`` reference fingerprints:
a pair is discarded if one coordinate differs by more than ``max_bits`` (the
triangle inequality), and survivors are verified bit by bit.  A tile returns a
spanning forest of its links, never all pairs.

Components: alternating large-star and small-star steps, each written to the
shared folder.

Defined results: a null text counts as empty; rows without an id have their
fingerprint's component, and ``keep_one`` keeps them all; repeated rows of one
id and text are one document to ``keep_one``; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, mix, pin, spans, utf8

SHINGLE = 4
MAX_BITS = 4
SEED = 42
PIVOTS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
TILE = 1024
SMALL_GROUP = 24


# --- fingerprints ----------------------------------------------------------------

def _fingerprints(data: np.ndarray, at: np.ndarray, shingle: int) -> np.ndarray:
    out = np.zeros(len(at) - 1, np.uint64)
    starts, ends, first = spans(data, at)
    if not len(starts):
        return out
    # Words of a document with one space between: each word, and one byte before all but the first.
    leads = np.ones(len(starts), np.int64)
    leads[first[:-1][first[:-1] < first[1:]]] = 0
    sizes = ends - starts
    new_end = np.cumsum(sizes + leads)
    new_start = new_end - sizes
    joined = np.full(int(new_end[-1]), 32, np.uint8)
    joined[np.arange(int(sizes.sum())) + np.repeat(new_start - (np.cumsum(sizes) - sizes), sizes)] = \
        LOWER[data[np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]]
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(words)), count)
    begin = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    end = np.minimum(begin + shingle, first[owner + 1]) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(new_start[begin].tolist(), new_end[end].tolist())], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(count)
    sums = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * sums > count[some, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _digest(text: F.Column) -> F.Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, digest) of every row; fp holds the 64 bits as a signed long, digest is the text's SHA-256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            found = [_fingerprints(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], shingle) for lo, hi in chunks(at)]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "digest"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"), _digest(docs[text_col]).alias("digest")) \
        .mapInArrow(run, "doc_id bigint, fp bigint, digest string")


# --- links -------------------------------------------------------------------------

def band_masks(bands: int, max_bits: int) -> list[int]:
    """Signed 64-bit masks of every choice of ``bands - max_bits`` bands."""
    cuts = [round(64 * k / bands) for k in range(bands + 1)]
    band = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(x) for x in itertools.combinations(band, bands - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bands_for(nodes: int, max_bits: int) -> int:
    """Bands such that a group of unrelated fingerprints has about one member."""
    return next((b for b in range(max_bits + 2, max_bits + 6) if 2 ** (64 * (b - max_bits) / b) >= nodes), max_bits + 6)


def _near(x: np.ndarray, table: np.ndarray, one: int, others: np.ndarray, max_bits: int) -> np.ndarray:
    close = others[np.abs(table[others] - table[one]).max(axis=1, initial=0) <= max_bits]
    return close[np.bitwise_count(x[close] ^ x[one]) <= max_bits]


def _forest(x: np.ndarray, table: np.ndarray, members: np.ndarray, max_bits: int, label: np.ndarray, edges: list) -> None:
    """Labels of the components among ``members``, and a spanning forest."""
    left = members
    while len(left):
        queue, left = [int(left[0])], left[1:]
        label[queue[0]] = seed = queue[0]
        while queue and len(left):
            one = queue.pop()
            near = _near(x, table, one, left, max_bits)
            if len(near):
                edges.append((np.full(len(near), one), near))
                label[near] = seed
                left = left[label[left] < 0]
                queue.extend(near.tolist())


def _tile(x: np.ndarray, side: np.ndarray, max_bits: int, table: np.ndarray) -> list:
    """Edges of one tile: a chunk with itself, or only those that join two chunks."""
    label, edges = np.full(len(x), -1, np.int64), []
    if not side.any():
        _forest(x, table, np.arange(len(x)), max_bits, label, edges)
        return edges
    a, b = np.flatnonzero(~side), np.flatnonzero(side)
    for part in (a, b):
        _forest(x, table, part, max_bits, label, [])
    for one in a.tolist():
        others = b[label[b] != label[one]]
        if not len(others):
            continue
        near = _near(x, table, one, others, max_bits)
        if len(near):
            labels, at = np.unique(label[near], return_index=True)
            edges.append((np.full(len(labels), one), near[at]))
            label[np.isin(label, labels)] = label[one]
    return edges


def _edges(key: np.ndarray, side: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal ``key`` (rows of a run are neighbours)."""
    x = fp.view(np.uint64)
    table = np.bitwise_count(x[:, None] ^ PIVOTS).astype(np.int8)
    cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
    size = np.diff(cut)
    mine = np.where(np.repeat(size <= SMALL_GROUP, size), np.repeat(np.arange(len(size)), size), -np.arange(1, len(x) + 1))
    found = []
    for lag in range(1, min(SMALL_GROUP, int(size.max()))):
        i = np.flatnonzero(mine[:-lag] == mine[lag:])
        i = i[np.abs(table[i] - table[i + lag]).max(axis=1, initial=0) <= max_bits]
        i = i[np.bitwise_count(x[i] ^ x[i + lag]) <= max_bits]
        found.append((i, i + lag))
    for lo, n in zip(cut[:-1][size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist()):
        part = slice(lo, lo + n)
        found += [(u + lo, v + lo) for u, v in _tile(x[part], side[part], max_bits, table[part])]
    u = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    v = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return fp[u], fp[v]


def links(nodes: DataFrame, max_bits: int = MAX_BITS, fp_col: str = "fp", tile: int = TILE) -> DataFrame:
    """(a, b) with a < b: links that connect all nodes at most ``max_bits`` apart.

    ``nodes`` has one row per different fingerprint and is read twice."""
    masks = band_masks(bands_for(nodes.count(), max_bits), max_bits)
    fp = nodes[fp_col]
    keyed = nodes.select(fp.alias("fp"), F.explode(F.array(*[
        F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])).alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile) \
        .select(F.col("key").alias("hot_key"), F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    cut = keyed.join(hot, F.col("key") == F.col("hot_key"), "left").select(
        "key", "fp", F.coalesce("parts", F.lit(1)).alias("parts"))
    chunk = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts")).cast("int")
    tiles = cut.withColumn("mine", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
        (F.col("mine") > F.col("other")).alias("side"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
                rows = (np.stack(cols[:3], axis=1).astype(np.int64), cols[3].astype(bool), cols[4].astype(np.int64))
                if held is not None:
                    rows = tuple(np.concatenate(p) for p in zip(held, rows))
                if not len(rows[2]):
                    continue
                last = len(rows[2]) - int(np.argmax((rows[0][::-1] != rows[0][-1]).any(axis=1))) if (rows[0] != rows[0][-1]).any() else 0
                rows, held = tuple(p[:last] for p in rows), tuple(p[last:] for p in rows)
            else:
                rows = held
            if rows is None or not len(rows[2]):
                continue
            u, v = _edges(*rows, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    return tiles.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "fp") \
        .mapInArrow(run, "a bigint, b bigint").distinct()


# --- components ----------------------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node reachable."""
    now = pin(edges.select(edges[a].alias("u"), edges[b].alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        # Large star: every larger neighbour of u is tied to the smallest neighbour.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        large = pin(large, "large-star")
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").where("u <> v").distinct()
        now = pin(small, "small-star")
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == mark:
            break
        mark = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    return _grouped(docs, id_col, text_col, shingle, max_bits).drop("digest")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    marked = pin(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tied = components(links(pin(nodes.select("fp"), "nodes"), max_bits))
    named = nodes.join(tied, nodes["fp"] == tied["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    classes = named.join(roots, named["root"] == roots["r"]).select(F.col("fp").alias("f"), "component_id")
    return marked.join(classes, marked["fp"] == classes["f"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per near-duplicate group: the smallest id's (of its rows in
    the group, that with the least digest).

    Rows are told apart by id and text, so an id that occurs with texts of several
    groups loses only the rows that do not lead their group.  Rows without an id
    stay.  Equal rows of a kept id and text become one."""
    groups = pin(_grouped(docs, id_col, text_col, SHINGLE, MAX_BITS).where("doc_id is not null").select("doc_id", "digest", "component_id"), "near-groups")
    # The row that leads a group has its component's id, which is the least in it.
    own = groups.where("doc_id = component_id").groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    leads = own.groupBy("doc_id").agg(F.min("digest").alias("lead")).withColumnRenamed("doc_id", "lead_id")
    follows = groups.where("doc_id <> component_id").select("doc_id", "digest").distinct()
    # Ids that lead no group go as a whole; of the others single texts go, and equal rows become one.
    gone = pin(follows.join(leads, F.col("doc_id") == F.col("lead_id"), "left_anti").select(F.col("doc_id").alias("gone_id")).distinct(), "gone-ids")
    one = own.join(leads, F.col("doc_id") == F.col("lead_id")).select("doc_id", "digest", "n", (F.col("digest") == F.col("lead")).alias("leads"))
    texts = pin(follows.join(leads, F.col("doc_id") == F.col("lead_id"), "left_semi").select("doc_id", "digest", F.lit(False).alias("again"))
                .union(one.where("not leads or n > 1").select("doc_id", "digest", F.col("leads").alias("again")))
                .select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_text"), "again"), "gone-texts")
    key = F.col(f"`{id_col}`").cast("bigint")
    left = docs.join(gone, key == F.col("gone_id"), "left_anti").withColumn("__text", _digest(docs[text_col]))
    same = (key == F.col("gone_id")) & (F.col("__text") == F.col("gone_text"))
    rest = left.join(texts.select("gone_id", "gone_text"), same, "left_anti")
    several = left.join(texts.where("again").select("gone_id", "gone_text"), same, "left_semi").dropDuplicates([id_col, "__text"])
    return rest.unionByName(several).drop("__text")
