"""Embedding near-dedup: int8 tile products with per-vector error bounds.

Equal vectors become one node first (copies cost nothing).  A node's unit vector
u is coded as ``scale * q`` with int8 ``q``, and ``error = |u - scale * q|`` is kept.
For two nodes

    | u.v - scale_u * scale_v * (q_u . q_v) |  <=  error_u * (1 + error_v) + error_v,

so a pair whose coded product stays below ``threshold`` by more than that bound
cannot link.  Only the other pairs are computed again, in double precision.

How the pairs meet: each node lives in the cell of its nearest pivot (at most
``PIVOTS`` nodes chosen by their hash); a cell of more than ``STRIP`` nodes is cut
into strips.  A node visits the strips of every cell whose cap it can reach: if
y links to x, then angle(y, pivot) <= angle(x, pivot) + angle(threshold), so cells
whose farthest member is nearer than that are left out and no link is lost.  A
task holds one strip at a time and streams its visitors past it in tiles.  It
returns one count for each of its nodes and a spanning forest of the links, never
pairs.  The work is one int8 product for each node and each strip that it must
visit: all strips where vectors point everywhere, few where they are clustered.

Defined results: a vector that is null, empty, zero, or holds a null or
non-finite component links with nothing and is its own component; vectors of
different lengths do not link; every row counts, so copies of a row are links of
each other; rows that share an id but not a vector are vertices of their own; rows
without an id take part and have a null component if no id is reached; an empty
table gives an empty table.  Ids are integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import pin
from .simhash import components

THRESHOLD = 0.95
PIVOTS = 256
STRIP = 8192
TILE = 512
#: Most bytes of coded vectors in a strip.
STRIP_BYTES = 32 << 20
#: Sums of products of int8 codes are whole numbers that a float32 holds exactly up to this length.
EXACT_FLOAT32 = (1 << 24) // (127 * 127)
#: For the roundings of float32 scales and of double precision sums.
SLACK = 2e-6
#: Orders nodes by their least id, nodes without one last.
NODE = "struct<no_id: boolean, least: bigint, nid: bigint>"
NODE_ARROW = pa.struct([("no_id", pa.bool_()), ("least", pa.int64()), ("nid", pa.int64())])
HOT_NODES = 10_000


# --- vectors -----------------------------------------------------------------------

def _doubles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components one after the other, where each vector begins, and which vectors count."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size, there = np.diff(at), ~column.is_null().to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    some = np.concatenate(([0], np.cumsum(values != 0)))
    return values, at, there & (size > 0) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])


def _marked(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, key, dim, vec): key and vec are null for vectors that link with nothing."""
    narrow = isinstance(getattr(rows.schema[vector_col].dataType, "elementType", None), FloatType)
    kind = np.dtype(np.float32 if narrow else np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at, good = _doubles(batch.column(1))
            values = (values + 0.0).astype(kind)  # one zero
            raws = [values[a:b].tobytes() if ok else None for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), good.tolist())]
            keys = [None if raw is None else hashlib.blake2b(raw, digest_size=16).digest() for raw in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(at).astype(np.int32)), pa.array(raws, pa.binary())],
                names=["vec_id", "key", "dim", "vec"])

    element = "float" if narrow else "double"
    return rows.select(rows[id_col].cast("bigint").alias("vec_id"), rows[vector_col].cast(f"array<{element}>").alias("v")) \
        .mapInArrow(run, "vec_id bigint, key binary, dim int, vec binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length, each scaled by a power of two so that no sum overflows."""
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(column) else np.float64).astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


class Coded:
    """Vectors in double precision beside their int8 codes, scales and errors."""

    def __init__(self, x: np.ndarray):
        self.x, self.norm = x, np.sqrt(np.einsum("ij,ij->i", x, x))
        unit = x / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1, initial=0) / 127
        codes = np.rint(unit / self.scale[:, None])
        rest = unit - codes * self.scale[:, None]
        self.error = np.sqrt(np.einsum("ij,ij->i", rest, rest)) * (1 + 1e-9) + 1e-12
        self.codes = codes.astype(np.int8)

    def __len__(self) -> int:
        return len(self.x)

    def part(self, lo: int, hi: int) -> Coded:
        out = object.__new__(Coded)
        for name in ("x", "norm", "scale", "error", "codes"):
            setattr(out, name, getattr(self, name)[lo:hi])
        return out


def _wide(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float32 if codes.shape[1] <= EXACT_FLOAT32 else np.float64)


def possible(a: Coded, b: Coded, threshold: float, wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``a``, row of ``b``) whose coded product does not rule out a link."""
    product = (_wide(a.codes) if wide is None else wide) @ _wide(b.codes).T
    product *= b.scale.astype(product.dtype)
    worst = b.error.max(initial=0)
    least = (threshold - SLACK - a.error * (1 + worst) - worst) / a.scale
    return np.nonzero(product >= least.astype(product.dtype)[:, None])


def cosines(a: Coded, b: Coded, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine of each pair in double precision."""
    out = np.empty(len(i))
    step = max(1, (4 << 20) // max(1, a.x.shape[1]))
    for lo in range(0, len(i), step):
        p, q = i[lo:lo + step], j[lo:lo + step]
        out[lo:lo + step] = np.einsum("ij,ij->i", a.x[p], b.x[q]) / (a.norm[p] * b.norm[q])
    return out


def linked(a: Coded, b: Coded, threshold: float, wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with a cosine of at least ``threshold``."""
    i, j = possible(a, b, threshold, wide)
    if len(i) * 16 < len(a) * len(b):
        keep = cosines(a, b, i, j) >= threshold
        return i[keep], j[keep]
    # Most of the tile is left: one product in double precision, near ties as above.
    rows, cols = np.unique(i), np.unique(j)
    value = (a.x[rows] @ b.x[cols].T) / (a.norm[rows, None] * b.norm[cols])
    value = value[np.searchsorted(rows, i), np.searchsorted(cols, j)]
    tie = np.flatnonzero(np.abs(value - threshold) < 1e-9)
    value[tie] = cosines(a, b, i[tie], j[tie])
    keep = value >= threshold
    return i[keep], j[keep]


# --- strips ------------------------------------------------------------------------

class _Strip:
    """Nodes that live here, their links so far, and labels of what is joined already."""

    def __init__(self, strip: tuple, nid: np.ndarray, node: pa.Array, coded: Coded, threshold: float):
        self.strip, self.nid, self.node, self.coded, self.threshold = strip, nid, node, coded, threshold
        self.wide = _wide(coded.codes)
        self.count, self.label = np.zeros(len(nid), np.int64), np.arange(len(nid))

    def meet(self, nid: np.ndarray, copies: np.ndarray, earlier: np.ndarray, coded: Coded) -> tuple[np.ndarray, np.ndarray]:
        """Count the links of some visitors; edges (visitor, own node) that join what is not joined yet."""
        from_, to = [], []
        for lo in range(0, len(nid), TILE):
            i, j = linked(self.coded, coded.part(lo, lo + TILE), self.threshold, self.wide)
            j = j + lo
            other = self.nid[i] != nid[j]
            i, j = i[other], j[other]
            np.add.at(self.count, i, copies[j])
            i, j = i[earlier[j]], j[earlier[j]]
            order = np.argsort(j, kind="stable")
            i, j = i[order], j[order]
            cut = np.flatnonzero(np.diff(j, prepend=-1, append=-1))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                labels = np.unique(self.label[i[a:b]])
                from_.append(np.full(len(labels), j[a]))
                to.append(labels)
                if len(labels) > 1:
                    self.label[np.isin(self.label, labels)] = labels[0]
        return (np.concatenate(from_), np.concatenate(to)) if from_ else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
    cut = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True])))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield batch.slice(lo, hi - lo)


FOUND = f"nid bigint, links bigint, a {NODE}, b {NODE}"


def _scan(threshold: float):
    """Strips one after the other (own nodes first, then visitors): counts and edges."""
    def counts(strip: _Strip) -> pa.RecordBatch:
        some = np.flatnonzero(strip.count)
        return pa.RecordBatch.from_arrays([pa.array(strip.nid[some]), pa.array(strip.count[some]),
                                           pa.nulls(len(some), NODE_ARROW), pa.nulls(len(some), NODE_ARROW)], names=["nid", "links", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, held = None, []
        for batch in batches:
            for rows in _runs(batch, ["dim", "cell", "part", "visits"]) if batch.num_rows else ():
                own = tuple(rows.column(c)[0].as_py() for c in ("dim", "cell", "part"))
                if not rows.column("visits")[0].as_py():
                    if strip is not None:
                        yield counts(strip)
                        strip = None
                    if held and held[0][0] != own:
                        held = []
                    held.append((own, rows))
                    continue
                if held:
                    table = pa.Table.from_batches([h[1] for h in held]).combine_chunks()
                    strip = _Strip(held[0][0], table["nid"].to_numpy(), table["node"].combine_chunks(),
                                   Coded(_matrix(table["vec"], own[0])), threshold)
                    held = []
                home = (rows.column("home").to_numpy(), rows.column("home_part").to_numpy())
                earlier = (home[0] < own[1]) | ((home[0] == own[1]) & (home[1] <= own[2]))
                v, r = strip.meet(rows.column("nid").to_numpy(), rows.column("copies").to_numpy(), earlier,
                                  Coded(_matrix(rows.column("vec"), own[0])))
                if len(v):
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.int64()),
                         rows.column("node").take(pa.array(v)).cast(NODE_ARROW), strip.node.take(pa.array(r)).cast(NODE_ARROW)],
                        names=["nid", "links", "a", "b"])
        if strip is not None:
            yield counts(strip)

    return run


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles to all pivots, and the nearest pivot of each vector."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    angle = np.arccos(np.clip(unit @ pivots.T, -1, 1))
    return angle, angle.argmin(axis=1)


def _pivots(nodes: DataFrame, per_dim: dict[int, int], strip: int) -> dict[int, np.ndarray]:
    """Unit vectors of at most ``PIVOTS`` nodes for each length that needs more than one strip."""
    wanted = {d: min(PIVOTS, math.ceil(n / strip)) for d, n in per_dim.items()}
    out = {d: np.zeros((1, d)) for d in wanted}
    for d, k in wanted.items():
        if k > 1:
            chosen = nodes.where(F.col("dim") == d).select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(k).collect()
            x = _matrix(pa.array([bytes(r.vec) for r in chosen], pa.binary()), d)
            out[d] = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return out


def found_links(nodes: DataFrame, threshold: float = THRESHOLD, strip: int = STRIP) -> DataFrame:
    """Rows (nid, links) with the number of linked rows of other nodes, and rows (a, b)
    whose edges connect what is linked.  ``nodes``: (key, nid, node, copies, dim, vec), written."""
    per_dim = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    size = {d: max(64, min(strip, STRIP_BYTES // (4 * d))) for d in per_dim}
    pivots = _pivots(nodes, per_dim, strip)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column("dim").to_numpy(), kind="stable")
            for rows in _runs(batch.take(pa.array(order)), ["dim"]) if batch.num_rows else ():
                d = rows.column("dim")[0].as_py()
                angle, cell = _nearest(_matrix(rows.column("vec"), d), pivots[d])
                yield pa.RecordBatch.from_arrays([rows.column("dim"), pa.array(cell.astype(np.int32)), pa.array(angle.min(axis=1))],
                                                 names=["dim", "cell", "angle"])

    caps: dict[int, dict[int, tuple[float, int]]] = {}
    for r in nodes.select("dim", "vec").mapInArrow(cells, "dim int, cell int, angle double") \
            .groupBy("dim", "cell").agg(F.max("angle").alias("far"), F.count("*").alias("n")).collect():
        caps.setdefault(r.dim, {})[r.cell] = (r.far, math.ceil(r.n / size[r.dim]))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    names = ["dim", "cell", "part", "visits", "home", "home_part", "nid", "node", "copies", "vec"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column("dim").to_numpy(), kind="stable")
            for rows in _runs(batch.take(pa.array(order)), ["dim"]) if batch.num_rows else ():
                d = rows.column("dim")[0].as_py()
                own = caps[d]
                angle, home = _nearest(_matrix(rows.column("vec"), d), pivots[d])
                parts = np.array([own.get(c, (0, 1))[1] for c in range(len(pivots[d]))], np.int64)
                home_part = rows.column("nid").to_numpy() % parts[home]

                def send(who: np.ndarray, cell: np.ndarray, part: np.ndarray, visits: bool) -> pa.RecordBatch:
                    at = pa.array(who)
                    whole = [np.full(len(who), d), cell, part, np.full(len(who), visits), home[who], home_part[who]]
                    return pa.RecordBatch.from_arrays(
                        [pa.array(w.astype(bool if k == 3 else np.int32)) for k, w in enumerate(whole)]
                        + [rows.column(c).take(at) for c in names[6:]], names=names)

                yield send(np.arange(rows.num_rows), home, home_part, False)
                for cell, (far, n) in sorted(own.items()):
                    who = np.flatnonzero(angle[:, cell] <= far + reach)
                    for part in range(n if len(who) else 0):
                        yield send(who, np.full(len(who), cell), np.full(len(who), part), True)

    dealt = nodes.select("dim", "nid", "node", "copies", "vec").mapInArrow(
        deal, f"dim int, cell int, part int, visits boolean, home int, home_part int, nid bigint, node {NODE}, copies bigint, vec binary")
    return dealt.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "visits") \
        .mapInArrow(_scan(threshold), FOUND)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                 strip: int = STRIP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows``."""
    marked = pin(_marked(rows, id_col, vector_col), "vectors")
    grouped = marked.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    nodes = pin(grouped.withColumn("nid", F.monotonically_increasing_id()).withColumn(
        "node", F.struct(F.isnull("least").alias("no_id"), F.coalesce("least", F.lit(0)).alias("least"), F.col("nid").alias("nid"))), "nodes")
    found = pin(found_links(nodes, threshold, strip), "links")
    tied = components(found.where("a is not null"))
    counts = found.where("nid is not null").select(F.col("nid").alias("of"), "links")
    named = nodes.select("key", "nid", "node", "copies").join(counts, F.col("nid") == F.col("of"), "left") \
        .join(tied.withColumnRenamed("node", "tied_node"), F.col("node") == F.col("tied_node"), "left")
    root = F.coalesce("root", "node")
    classes = pin(named.select(
        F.col("key").alias("node_key"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(~root["no_id"], root["least"]).alias("component_id")), "classes")
    # A node with more than 1/HOT_NODES of the rows: fewer than HOT_NODES of them, so they are broadcast.
    most = marked.count() // HOT_NODES + 1
    hot, rest = F.broadcast(classes.where(F.col("copies") > most)), classes.where(F.col("copies") <= most)
    own = marked.select("vec_id", "key")
    same = F.col("key") == F.col("node_key")
    out = own.join(hot, same).select("vec_id", "n_links", "component_id") \
        .unionByName(own.where("key is not null").join(hot, same, "left_anti").join(rest, same).select("vec_id", "n_links", "component_id")) \
        .unionByName(own.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def keep_one(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``rows`` without those whose id is not its component's; rows without an id stay."""
    gone = near_vectors(rows, id_col, vector_col, threshold).where("not kept and vec_id is not null").select(F.col("vec_id").alias("gone_id"))
    return rows.join(gone.distinct(), rows[id_col] == F.col("gone_id"), "left_anti")
