"""Shared pieces of the training-data operators.

* ``pin`` writes an intermediate table to the shared folder named by
  ``spark.checkpoint.dir`` and reads it again, so lineage is cut and a lost
  executor only costs its own tasks.
* ``spans``, ``word_hashes`` and ``window_hashes`` work on whole Arrow string
  columns with numpy: words are ``[^\\x20\\x09-\\x0D]+``, and all six separators
  are single bytes in UTF-8, so byte positions are enough.
* ``pack_blocks`` gathers documents into compressed blocks of bounded size.  A
  block is the unit in which corpus-wide questions are asked ("how often does
  this window occur?"): each block sends its distinct keys by key range, one
  group per range answers for all blocks, and the answers go back to the block.
  No group grows with a hot key, because a block asks for each key once.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and every byte beyond ASCII: words without ASCII punctuation.
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Lower case of A-Z only; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks,
    and what one stage's arrays leave in the allocator adds to the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sample_texts(rows: DataFrame, column: str, limit: int, max_chars: int) -> list[str]:
    """At most ``limit`` different texts of at most ``max_chars`` characters, chosen
    by their hash.  The tasks send hashes first, then only the chosen texts."""
    own = rows.select(rows[column].cast("string").alias("text")).where(F.char_length("text").between(1, max_chars)) \
        .withColumn("h", F.xxhash64("text"))
    last = own.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if last is None:
        return []
    chosen = own.where(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text")).collect()
    return [r.text for r in sorted(chosen, key=lambda r: r.h)]


# --- words of an Arrow column ------------------------------------------------

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``limit`` bytes (one document at least)."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray = _NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each document's first
    word.  ``inside`` says of each byte value whether it belongs to a word."""
    word = inside[data]
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edge = at[(at > 0) & (at < len(data))]
        first[edge] = word[edge]
        last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 (the bases are odd, so inverses exist)."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS[base] = (both[0], both[1])
    up, down = _POWERS[base]
    return up[:n], down[:n]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    up, _ = _powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``which`` (0 to 2) gives independent ones."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = _sums(mix(_BYTE + np.uint64(which))[data] if which else _BYTE[data], _BASES[which])
    _, down = _powers(_BASES[which], len(data))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_PLACES = 64
_TABLES: dict[int, np.ndarray] = {}


def _at_place(place: np.ndarray, byte: np.ndarray, seed: int) -> np.ndarray:
    return mix(place.astype(np.uint64) * np.uint64(256) + byte + np.uint64(1) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))


def exact_word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes that stands for the word: the sum of a mixed value
    of each byte and its place.  Unlike a polynomial modulo 2**64 it has no words of low
    structure that always collide; two seeds give independent hashes."""
    return _exact(data, starts, ends, (seed,))[0]


def exact_word_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``exact_word_hashes`` of seeds 0 and 1, in one walk over the bytes."""
    return _exact(data, starts, ends, (0, 1))


def _exact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    if not len(starts):
        return tuple(np.zeros(0, np.uint64) for _ in seeds)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    byte = data[place + np.repeat(starts, sizes)]
    cell = np.minimum(place, _PLACES - 1) * 256 + byte
    far, found = np.flatnonzero(place >= _PLACES), []
    for seed in seeds:
        if seed not in _TABLES:
            grid = np.arange(_PLACES * 256)
            _TABLES[seed] = _at_place(grid // 256, (grid % 256).astype(np.uint8), seed)
        values = _TABLES[seed][cell]
        if len(far):
            values[far] = _at_place(place[far], byte[far], seed)
        found.append(mix(np.add.reduceat(values, first) + sizes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    return tuple(found)


def window_hashes(words: np.ndarray, size: int, which: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words; ``which`` (1 or 2) gives independent ones."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    base = _BASES[which]
    total = _sums(words if which == 1 else mix(words ^ np.uint64(0x5851F42D4C957F2D)), base)
    n = len(words) - size + 1
    _, down = _powers(base, n)
    return mix((total[size:] - total[:-size]) * down)


# --- blocks of documents -------------------------------------------------------

_CODEC = "zstd"


def squeeze(raw: bytes | np.ndarray) -> bytes:
    """Compressed bytes, with their length before."""
    raw = bytes(memoryview(raw).cast("B")) if isinstance(raw, np.ndarray) else raw
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=n, codec=_CODEC, asbytes=True) if n else b""


BLOCK_SCHEMA = "block string, sizes array<int>, data binary, rest binary"


def pack_blocks(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole documents of about ``block_bytes`` (a longer document has
    its own block), written to the shared folder.  No shuffle: a block holds
    documents that one task read.  ``rest`` keeps ``columns`` of the same rows
    (all but the text by default) as an Arrow stream.  Null texts count as empty."""
    columns = [c for c in docs.columns if c != text_col] if columns is None else columns
    rows = docs.select(docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"c{k}") for k, c in enumerate(columns)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, parts, rest, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest[0].schema) as out:
                for r in rest:
                    out.write_batch(r)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([np.concatenate(sizes)], pa.list_(pa.int32())),
                 pa.array([squeeze(np.concatenate(parts))], pa.binary()),
                 pa.array([squeeze(sink.getvalue().to_pybytes())], pa.binary())],
                names=["block", "sizes", "data", "rest"])

        for batch in batches:
            data, at = utf8(batch.column(0))
            other = pa.RecordBatch.from_arrays([batch.column(0).is_null(), *batch.columns[1:]],
                                               names=["no_text", *batch.schema.names[1:]])
            for lo, hi in chunks(at, max(1, block_bytes // 8)):
                sizes.append(np.diff(at[lo:hi + 1]).astype(np.int32))
                parts.append(data[at[lo]:at[hi]])
                rest.append(other.slice(lo, hi - lo))
                held += int(at[hi] - at[lo])
                if held >= block_bytes:
                    yield block()
                    sizes, parts, rest, held = [], [], [], 0
        if sizes:
            yield block()

    return pin(rows.mapInArrow(pack, BLOCK_SCHEMA), "blocks")


def open_rest(blob: bytes) -> pa.Table:
    """``no_text`` and the kept columns (c0, c1, ...) of a block's rows."""
    return pa.ipc.open_stream(unsqueeze(blob)).read_all().combine_chunks()


def open_block(sizes: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a packed block."""
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return np.frombuffer(unsqueeze(data), np.uint8), at


def planes(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed differences, byte plane by byte plane."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    return squeeze(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, values.itemsize).T))


def unplanes(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(unsqueeze(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    gaps = np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)
    return np.cumsum(gaps, dtype=dtype)
