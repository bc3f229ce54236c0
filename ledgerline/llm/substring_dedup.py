"""Substring dedup: remove words covered by a window that occurs elsewhere too.

A window is ``size`` consecutive words of one document.  Three passes over
packed document blocks, each block being one row of a written table:

1. Every block sends its count-min sketch: per depth row the sorted cells of
   its windows and whether a cell was hit twice, cut by cell range.  One group
   per range adds the sketches of all blocks and tells each block which of its
   cells have a merged count of two or more.  The merged count is never below
   the true count, so no repeated window is lost.
2. Each block sends the 128-bit fingerprints of the windows that all depth rows
   estimate as repeated, cut by fingerprint range; one group per range counts
   them exactly and tells each block which are repeated.
3. Each block marks the words of repeated windows.

The sketch's width is ``WIDTH`` cells per window of the corpus, so its error
does not grow with the corpus.  A block asks for a cell or window once however
often it holds it, so a hot window costs one entry per block.

Defined results: a null text counts as empty (no words, nothing removed); a
document shorter than a window keeps all words; repeated rows repeat each
other's windows, like any two documents; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import (BLOCK_BYTES, CHUNK_BYTES, chunks, exact_word_hashes, give_back, open_block, open_rest, pack_blocks, pin, planes, spans, squeeze, unplanes, unsqueeze,
                     window_hashes)

WINDOW = 35
DEPTH = 2
WIDTH = 4  #: cells of a depth row per window
RANGE_BITS = 22  #: cells (log2) that one group of the sketch merge holds
EXACT_WINDOWS = 1 << 22  #: windows of the corpus per group of the exact count


def _windows(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of the fingerprint of every window of a block, document by document."""
    halves = ([], [])
    for lo, hi in chunks(at, CHUNK_BYTES):
        starts, ends, first = spans(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
        whole = _inside(first, size)
        for k, half in enumerate(halves):
            words = exact_word_hashes(data[at[lo]:at[hi]], starts, ends, k)
            half.append(window_hashes(words, size, k + 1)[whole])
    return tuple(np.concatenate(h) if h else np.zeros(0, np.uint64) for h in halves)


def _inside(first: np.ndarray, size: int) -> np.ndarray:
    """Word positions at which a window of one document starts."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    return np.arange(int(count.sum())) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)


def _cell(half: np.ndarray, cells: int) -> np.ndarray:
    return half % np.uint64(cells)


def _sketch(data: np.ndarray, at: np.ndarray, size: int, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, cells within it, hit twice) of a block, for every depth row."""
    width = 1 << RANGE_BITS
    for depth, half in enumerate(_windows(data, at, size)):
        cells, count = np.unique(_cell(half, ranges * width), return_counts=True)
        cut = np.searchsorted(cells, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
        for r in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(cut[r], cut[r + 1])
            yield (depth * ranges + r, planes((cells[part] - np.uint64(r * width)).astype(np.uint32)),
                   squeeze(np.packbits(count[part] > 1)))


def _candidates(data: np.ndarray, at: np.ndarray, size: int, ranges: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that every depth row estimates as repeated: mask over the block's windows, and the halves."""
    width = 1 << RANGE_BITS
    halves = _windows(data, at, size)
    repeated = np.ones(len(halves[0]), bool)
    for depth, half in enumerate(halves):
        cells, back = np.unique(_cell(half, ranges * width), return_inverse=True)
        cut = np.searchsorted(cells, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
        hit = np.zeros(len(cells), bool)
        for r in np.flatnonzero(np.diff(cut)).tolist():
            n = int(cut[r + 1] - cut[r])
            hit[cut[r]:cut[r + 1]] = np.unpackbits(np.frombuffer(unsqueeze(answers[depth * ranges + r]), np.uint8), count=n)
        repeated &= hit[back]
    return repeated, halves[0], halves[1]


_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (a, b), sorted; where each input row is among them; how often each occurs."""
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    pairs = np.empty(int(new.sum()), _PAIR)
    pairs["a"], pairs["b"] = sa[new], sb[new]
    return pairs, back, np.bincount(back, minlength=len(pairs)) if len(a) else np.zeros(0, np.int64)


def _range_cuts(pairs: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a fingerprint is given by its leading bits, so sorted pairs fall into runs."""
    edges = np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)
    return np.append(np.searchsorted(pairs["a"], edges), len(pairs))


def _answers(list_of_structs) -> dict[int, bytes]:
    return {x["r"]: x["answer"] for x in list_of_structs or ()}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
            give_back()


def _ask(blocks: DataFrame, keys, answer, schema: str) -> DataFrame:
    """(block, answers): ``keys`` runs over blocks and yields (r, block, ...); ``answer`` runs over each r."""
    asked = blocks.mapInArrow(keys, f"r int, block string, {schema}")
    told = asked.groupBy("r").applyInArrow(answer, "r int, block string, answer binary")
    return pin(told.groupBy("block").agg(F.collect_list(F.struct("r", "answer")).alias("answers")), "answers")


def _marked(docs: DataFrame, text_col: str, columns: list[str], size: int, block_bytes: int, finish, schema) -> DataFrame:
    """``finish(rest, raw, edges, first, gone, lost)`` over runs of whole documents:
    their kept columns, bytes, byte offsets, first words, which words go and
    the running count of those before each document."""
    blocks = pack_blocks(docs, text_col, columns, block_bytes)
    letters = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    windows = max(1, letters // 5)  # an estimate: it sets the sketch's width, not what is found
    ranges = max(1, -(-windows * WIDTH >> RANGE_BITS))
    exact = max(1, -(-windows // EXACT_WINDOWS))

    def sketches(batches):
        for row in _rows(batches):
            data, at = open_block(row["sizes"].values.to_numpy(), row["data"].as_py())
            found = list(_sketch(data, at, size, ranges))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), pa.array([row["block"].as_py()] * len(found), pa.string()),
                 pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())],
                names=["r", "block", "cells", "twice"])

    def merge(table: pa.Table) -> pa.Table:
        count = np.zeros(1 << RANGE_BITS, np.uint8)  # saturates at two: each block adds one or two, capped
        cells = [unplanes(x.as_py(), np.uint32) for x in table["cells"]]
        for own, twice in zip(cells, table["twice"]):
            add = np.unpackbits(np.frombuffer(unsqueeze(twice.as_py()), np.uint8), count=len(own)) + np.uint8(1)
            count[own] = np.minimum(count[own] + add, 2)
        return pa.table({"r": table["r"], "block": table["block"],
                         "answer": pa.array([squeeze(np.packbits(count[own] > 1)) for own in cells], pa.binary())})

    estimated = blocks.join(_ask(blocks.select("block", "sizes", "data"), sketches, merge, "cells binary, twice binary"), "block", "left")

    def candidates(batches):
        for row in _rows(batches):
            data, at = open_block(row["sizes"].values.to_numpy(), row["data"].as_py())
            repeated, a, b = _candidates(data, at, size, ranges, _answers(row["answers"].as_py()))
            pairs, _, count = _distinct_pairs(a[repeated], b[repeated])
            cut = _range_cuts(pairs, exact)
            found = [(r, pairs[cut[r]:cut[r + 1]], count[cut[r]:cut[r + 1]]) for r in np.flatnonzero(np.diff(cut)).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), pa.array([row["block"].as_py()] * len(found), pa.string()),
                 pa.array([f[1].tobytes() for f in found], pa.binary()),
                 pa.array([squeeze(np.packbits(f[2] > 1)) for f in found], pa.binary())],
                names=["r", "block", "pairs", "twice"])

    def count_exactly(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), _PAIR) for x in table["pairs"]]
        twice = [np.unpackbits(np.frombuffer(unsqueeze(x.as_py()), np.uint8), count=len(p)).astype(bool)
                 for x, p in zip(table["twice"], parts)]
        every = np.concatenate(parts)
        pairs, back, count = _distinct_pairs(every["a"], every["b"])
        hit = count > 1
        hit[back[np.concatenate(twice)]] = True
        own = np.split(hit[back], np.cumsum([len(p) for p in parts])[:-1])
        return pa.table({"r": table["r"], "block": table["block"],
                         "answer": pa.array([squeeze(np.packbits(x)) for x in own], pa.binary())})

    counted = _ask(estimated.select("block", "sizes", "data", "answers"), candidates, count_exactly, "pairs binary, twice binary")
    ready = estimated.join(counted.withColumnRenamed("answers", "counted"), "block", "left")

    def remove(batches):
        for row in _rows(batches):
            data, at = open_block(row["sizes"].values.to_numpy(), row["data"].as_py())
            repeated, a, b = _candidates(data, at, size, ranges, _answers(row["answers"].as_py()))
            pairs, back, _ = _distinct_pairs(a[repeated], b[repeated])
            cut, told = _range_cuts(pairs, exact), _answers(row["counted"].as_py())
            hit = np.zeros(len(pairs), bool)
            for r in np.flatnonzero(np.diff(cut)).tolist():
                hit[cut[r]:cut[r + 1]] = np.unpackbits(np.frombuffer(unsqueeze(told[r]), np.uint8), count=int(cut[r + 1] - cut[r]))
            repeated[repeated] = hit[back]
            rest, done = open_rest(row["rest"].as_py()), 0
            for lo, hi in chunks(at, CHUNK_BYTES):
                part, edges = data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
                starts, _, first = spans(part, edges)
                begin = _inside(first, size)
                whole = len(begin)
                begin = begin[repeated[done:done + whole]]
                done += whole
                step = np.zeros(len(starts) + 1, np.int64)
                step[begin] += 1
                step[begin + size] -= 1
                gone = np.cumsum(step[:-1]) > 0
                lost = np.concatenate(([0], np.cumsum(gone)))[first]
                yield pa.RecordBatch.from_arrays(finish(rest.slice(lo, hi - lo), part.tobytes(), edges, first, gone, lost),
                                                 schema=arrow)

    arrow = to_arrow_schema(schema)
    return ready.select("sizes", "data", "rest", "answers", "counted").mapInArrow(remove, schema)


def _kept(raw: bytes, edges, first, gone, lost, k: int) -> bytes:
    words = raw[edges[k]:edges[k + 1]].split()
    if lost[k + 1] > lost[k]:
        words = [w for w, g in zip(words, gone[first[k]:first[k + 1]].tolist()) if not g]
    return b" ".join(words)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    def finish(rest, raw, edges, first, gone, lost):
        kept = [hashlib.sha256(_kept(raw, edges, first, gone, lost, k)).hexdigest() for k in range(len(rest))]
        return [rest["c0"].combine_chunks(), pa.array(np.diff(first)), pa.array(np.diff(lost)), pa.array(kept, pa.string())]

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return _marked(docs, text_col, [id_col], size, block_bytes, finish, schema)


def remove_repeats(docs: DataFrame, text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs``, the words of repeated windows taken out.

    A text that loses words becomes its kept words joined by one space; every
    other text, null included, stays as it is."""
    others = [c for c in docs.columns if c != text_col]

    def finish(rest, raw, edges, first, gone, lost):
        texts = [None if no else _kept(raw, edges, first, gone, lost, k) if lost[k + 1] > lost[k] else raw[edges[k]:edges[k + 1]]
                 for k, no in enumerate(rest["no_text"].to_pylist())]
        own = {text_col: pa.array(texts, pa.binary()).cast(pa.string())} | {
            c: rest[f"c{k}"].combine_chunks() for k, c in enumerate(others)}
        return [own[c] for c in docs_columns]

    docs_columns = docs.columns
    return _marked(docs, text_col, others, size, block_bytes, finish, T.StructType([
        T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields]))
