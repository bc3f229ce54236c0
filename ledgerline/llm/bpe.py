"""Byte-level BPE encoding and decoding with DuckDB recursive queries per partition.

A text is split by the tokenizer's pattern; each piece is encoded on its own.
Per partition, the pieces not met before become token-position rows (piece,
position, token and its neighbour).  A recursive query joins each row's pair with
the merge table, contracts each piece's leftmost pair of least rank, and goes on
until no piece has a pair left.  Decoding joins a document's tokens with the vocabulary
and concatenates their bytes in one ordered aggregation.

A piece that is a token itself is that token at once, and a pair is mergeable
if its bytes are a token, both as the public rank-file library does.  A piece
of more than ``LONG_PIECE`` bytes would need a pass over all its rows for each
merge; such pieces are contracted by the same rule with a heap.

The vocabulary is a file of ranks (base64 bytes, rank), read by the driver and
sent to the tasks; its size is that of the file and does not grow with the data.

Defined results: a null text counts as empty; the empty text has no tokens and
decodes to no bytes; repeated rows are encoded alike; an empty table gives an
empty table.  Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunks, give_back, utf8

LONG_PIECE = 200
BATCH_BYTES = 8 << 20  #: text split at once; its new pieces are contracted together
DECODE_BYTES = 2 << 20  #: text encoded and decoded at once
QUERY_ROWS = 1_500_000  #: rows that one recursive query makes at most in all its rounds
KNOWN_BYTES = 160 << 20  #: pieces and tokens that a worker remembers; all are forgotten beyond
PIECE_COST = 220  #: bytes that a remembered piece takes beside its text and tokens
_BITS = 12  #: of a position


@dataclass
class Vocabulary:
    """Token bytes by rank, and which two neighbouring tokens become which."""

    pattern: str
    tokens: list[bytes]
    ranks: np.ndarray
    merges: np.ndarray  # rows (left, right, merged)


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as lines:
        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    merges = [(rank[t[:k]], rank[t[k:]], r) for t, r in rank.items() for k in range(1, len(t))
              if t[:k] in rank and t[k:] in rank]
    return Vocabulary(pattern, list(rank), np.array(list(rank.values()), np.int64), np.array(merges, np.int64).reshape(-1, 3))


_AT = (1 << _BITS) - 1
#: A row is a token of a piece: where it starts, where the next one starts, the
#: token and the next token (-1: none).  One round looks the pairs up and finds the
#: least (merged rank, position) of each piece.
_LOOK = """(
  WITH pairs AS MATERIALIZED (
    SELECT piece, pos, nxt, l, r, (merged << {two}) | (pos << {bits}) | nxt AS pair
    FROM {rows} LEFT JOIN merges ON lr = ((l << 32) | r))
  SELECT piece, pos, nxt, l, r, best
  FROM pairs LEFT JOIN (SELECT piece, min(pair) AS best FROM pairs GROUP BY piece) USING (piece))"""
#: The right row of the best pair takes its place and the merged token, the left row
#: goes, and the row before sees the new neighbour; a piece without a pair keeps its
#: rows as they are and leaves the recursion.
ENCODE = f"""
WITH RECURSIVE state(piece, pos, nxt, l, r, best) AS ({_LOOK.format(two=2 * _BITS, bits=_BITS, rows="start")}
  UNION ALL {_LOOK.format(two=2 * _BITS, bits=_BITS, rows=f"""(
    SELECT piece, CASE WHEN pos = (best & {_AT}) THEN (best >> {_BITS}) & {_AT} ELSE pos END AS pos, nxt,
           CASE WHEN pos = (best & {_AT}) THEN best >> {2 * _BITS} ELSE l END AS l,
           CASE WHEN nxt = ((best >> {_BITS}) & {_AT}) THEN best >> {2 * _BITS} ELSE r END AS r
    FROM state WHERE best IS NOT NULL AND pos <> ((best >> {_BITS}) & {_AT}))""")}
)
SELECT piece, l AS token FROM state WHERE best IS NULL ORDER BY piece, pos
"""

DECODE = """
SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM ids JOIN vocabulary USING (token) GROUP BY doc ORDER BY doc
"""


class _Numbers(dict):
    """Numbers for pieces, in the order in which they are met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Coder:
    """One task's DuckDB session with the merge table and the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb

        self.v = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        self.rank = dict(zip(vocabulary.tokens, vocabulary.ranks.tolist()))
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.number, self.known, self.held = _Numbers(), [], 0  # pieces, their tokens, bytes of both
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self.con.execute("SET preserve_insertion_order = false")
        self._table("merges", lr=(vocabulary.merges[:, 0] << 32) | vocabulary.merges[:, 1], merged=vocabulary.merges[:, 2])
        self._table("vocabulary", token=vocabulary.ranks, hex=[t.hex() for t in vocabulary.tokens])

    def _table(self, name: str, **columns) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Tokens of each piece, by the recursive query."""
        if not pieces:
            return []
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        pos, token = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size), self.byte[raw]
        following = np.append(token[1:], -1)
        following[np.cumsum(size) - 1] = -1
        self._table("start", piece=np.repeat(np.arange(len(pieces)), size), pos=pos, nxt=pos + 1, l=token, r=following)
        found = self.con.execute(ENCODE).fetchnumpy()
        piece, token = np.asarray(found["piece"]), np.asarray(found["token"])
        return np.split(token, np.flatnonzero(np.diff(piece)) + 1)

    def _contract_long(self, piece: bytes) -> np.ndarray:
        """The same contraction with a heap of (rank, position)."""
        token = list(self.byte[np.frombuffer(piece, np.uint8)].tolist())
        end = list(range(1, len(piece) + 1))  # where the token that starts here ends
        before = list(range(-1, len(piece) - 1))
        alive = [True] * len(piece)
        rank, heap = self.rank.get, []

        def offer(at: int) -> None:
            if at >= 0 and end[at] < len(piece):
                r = rank(piece[at:end[end[at]]])
                if r is not None:
                    heapq.heappush(heap, (r, at, end[at], end[end[at]]))

        for at in range(len(piece)):
            offer(at)
        while heap:
            r, at, mid, stop = heapq.heappop(heap)
            if not alive[at] or end[at] != mid or mid >= len(piece) or not alive[mid] or end[mid] != stop:
                continue
            alive[mid], end[at], token[at] = False, stop, r
            if stop < len(piece):
                before[stop] = at
            offer(before[at])
            offer(at)
        return np.array([t for t, a in zip(token, alive) if a], np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Remember the tokens of ``pieces``, which have the next numbers, as little-endian 32-bit numbers."""
        raw = [p.encode() for p in pieces]
        tokens: list[bytes] = [b""] * len(raw)
        short = []
        for k, r in enumerate(raw):
            if r in self.rank:
                tokens[k] = self.rank[r].to_bytes(4, "little")
            elif len(r) > LONG_PIECE:
                tokens[k] = self._contract_long(r).astype("<u4").tobytes()
            else:
                short.append(k)
        size = np.array([len(raw[k]) for k in short], np.int64)
        query = np.cumsum(size * (size + 1) // 2) // QUERY_ROWS  # a piece of n bytes makes at most 1 + ... + n rows
        for part in np.split(np.array(short, np.int64), np.flatnonzero(np.diff(query)) + 1):
            for k, found in zip(part.tolist(), self._contract([raw[k] for k in part.tolist()])):
                tokens[k] = found.astype("<u4").tobytes()
        self.known += tokens
        self.held += sum(map(len, raw)) + sum(map(len, tokens)) + PIECE_COST * len(raw)

    def split_all(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's pieces; the tokens of all of them are known then."""
        if self.held > KNOWN_BYTES:
            self.number, self.known, self.held = _Numbers(), [], 0
        number, split = self.number.__getitem__, self.split
        found = [list(map(number, split(t))) for t in texts]
        if len(self.number) > len(self.known):
            self._learn(list(islice(self.number, len(self.known), None)))
        return found

    def join(self, pieces: list[list[int]]) -> list[bytes]:
        """Token ids of each list of piece numbers, as little-endian unsigned 32-bit numbers."""
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit numbers."""
        return self.join(self.split_all(texts))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        size = np.array([len(x) // 4 for x in ids])
        token = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        out = [b""] * len(ids)
        if len(token):
            self._table("ids", doc=np.repeat(np.arange(len(ids)), size),
                        pos=np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size), token=token)
            for doc, raw in self.con.execute(DECODE).fetchall():
                out[doc] = bytes(raw)
        return out


_CODERS: dict[int, Coder] = {}


def coder_of(shared) -> Coder:
    """This worker's session for a broadcast vocabulary; tasks after the first find it ready."""
    if id(shared.value) not in _CODERS:
        _CODERS.clear()
        _CODERS[id(shared.value)] = Coder(shared.value)
    return _CODERS[id(shared.value)]


def _coded(docs: DataFrame, path: str, pattern: str, text_col: str, columns: list[str], finish, extra: list[T.StructField]) -> DataFrame:
    """``columns`` of each row, then what ``finish(texts, ids, decoded)`` gives."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path, pattern))
    schema = T.StructType([docs.schema[c] for c in columns] + extra)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = coder_of(shared)
            at = utf8(batch.column(0))[1]
            for lo, hi in chunks(at, BATCH_BYTES):
                pieces = coder.split_all([t or "" for t in batch.column(0).slice(lo, hi - lo).to_pylist()])
                for a, b in chunks(at[lo:hi + 1] - at[lo], DECODE_BYTES):
                    ids = coder.join(pieces[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [c.slice(lo + a, b - a) for c in batch.columns[1:]] + finish(ids, coder.decode(ids)), schema=arrow)
        give_back()

    rows = docs.select(docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"c{k}") for k, c in enumerate(columns)])
    return rows.mapInArrow(run, schema)


def tokenize(docs: DataFrame, path: str, pattern: str, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The other columns of ``docs``, then n_tokens, tokens (array<int>) and
    decoded (the text that they give), which take the place of columns of these names."""
    columns = [c for c in docs.columns if c != text_col] if columns is None else columns
    columns = [c for c in columns if c.lower() not in ("n_tokens", "tokens", "decoded")]

    def finish(ids, decoded):
        size = np.array([len(x) // 4 for x in ids], np.int64)
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()),
                                          pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
        return [pa.array(size), tokens, pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())]

    return _coded(docs, path, pattern, text_col, columns, finish, [
        T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType())])


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    def finish(ids, decoded):
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]

    found = _coded(docs, path, pattern, text_col, [id_col], finish, [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())])
    return found.withColumnRenamed(id_col, "doc_id")
