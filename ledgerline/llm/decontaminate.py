"""Benchmark decontamination: BM25 index of the test items, block-max WAND queries.

The inverted index is over the items; every training passage is a query against
it.  A passage is two neighbouring cells of a document, each cell ``CELL`` words
(half the longest item if that is more), so an item of any length and position
has more than half of its words in one passage.  Scores are divided by the
item's score for itself, so one threshold fits short and long items.

Per batch of documents, upper bounds come first: terms too weak to matter count
with their largest impact, the others with their largest impact per block of
``BLOCK`` items.  Only passages with a block at or above the threshold run the
block-max WAND search, which retrieves all items at or above it.  Each is
verified on the words around the passage: shared word n-grams of the item's
question (all but the last sentence) and answer (the last sentence), within a
span of at most twice the item's own words, however long other items are.  An item
of fewer than ``LEAST_WORDS`` words says nothing by itself ("yes"): only a document
that is the item, word for word, holds it.

The index goes to the tasks as a broadcast of at most ``PART_BYTES`` of item
text; more items are cut into parts and the documents are read once per part.

Defined results: null texts count as empty; items without a word match nothing;
repeated items are found under each of their ids; repeated documents are judged
row by row; an empty table on either side gives no pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, LOWER, chunks, spans, utf8, word_hashes

CELL = 32
BLOCK = 4
WEAK = 0.8  #: a term in more than this share of the blocks counts with its largest impact
THRESHOLD = 0.5
GRAM = 3
K1, B = 1.2, 0.75
PART_BYTES = 4 << 20
#: A pair counts if the question is there and the answer too, or nearly all of the question.
QUESTION, ANSWER, QUESTION_ALONE = 0.5, 0.5, 0.8
LEAST_WORDS = 8
#: Cells of the table of bounds (passages by blocks of items) that a task holds at once.
BOUNDS = 1 << 22

_PLAIN = bytes(LOWER[b] if LETTERS[b] else 32 for b in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII bytes."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_PLAIN).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of all but the last sentence, and of the last one; a single
    sentence is cut at three quarters."""
    parts = [p for p in (terms_of(x) for x in re.split(r"(?<=[.!?])\s+", text)) if p]
    if len(parts) > 1:
        return sum(parts[:-1], []), parts[-1]
    words = parts[0] if parts else []
    cut = max(1, len(words) * 3 // 4)
    return words[:cut], words[cut:]


def grams(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def overlap(part: list[bytes], seen: list[bytes]) -> float:
    """Share of the part's n-grams that ``seen`` has."""
    if not part:
        return 1.0
    size = min(GRAM, len(part))
    own = grams(part, size)
    return len(own & grams(seen, size)) / len(own)


def enough(q: float, a: float) -> bool:
    return q >= QUESTION and (a >= ANSWER or q >= QUESTION_ALONE)


def best_span(question: list[bytes], answer: list[bytes], seen: list[bytes]) -> tuple[float, float]:
    """Question and answer overlap in the best run of ``seen`` of at most twice the item's words."""
    longest = 2 * (len(question) + len(answer))
    if len(seen) <= longest:
        return overlap(question, seen), overlap(answer, seen)
    sizes = [min(GRAM, len(p)) for p in (question, answer)]
    own = [grams(p, n) if p else set() for p, n in zip((question, answer), sizes)]
    at = sorted((k, part, g) for part in (0, 1) for n in [sizes[part]] if n
                for k in range(len(seen) - n + 1) if (g := tuple(seen[k:k + n])) in own[part])
    held: tuple[Counter, Counter] = (Counter(), Counter())
    best, lo = (False, 0.0, 0.0, 0.0), 0
    for k, part, g in at:
        held[part][g] += 1
        while at[lo][0] < k + sizes[part] - longest:
            _, old, gone = at[lo]
            held[old][gone] -= 1
            if not held[old][gone]:
                del held[old][gone]
            lo += 1
        q, a = (len(h) / len(o) if o else 1.0 for h, o in zip(held, own))
        best = max(best, (enough(q, a), q + a, q, a))
    return best[2], best[3]


@dataclass
class Index:
    """Postings of one part of the items; impacts are shares of the item's own score."""

    items: list  # (id, question, answer)
    hashes: np.ndarray  # sorted hashes of the terms; a term's number is its place
    postings: list  # of each term: items, impacts, first posting of each block, block numbers, block maxima
    most: np.ndarray  # largest impact of each term
    weak: np.ndarray  # terms that count with ``most`` in the bounds
    bound_at: np.ndarray  # runs of the strong terms in the two arrays below
    bound_block: np.ndarray
    bound: np.ndarray
    cell: int


def hash_terms(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(size + 1) - size - 1
    return word_hashes(data, starts, starts + size)


def build_index(rows: list[tuple], df: dict[bytes, int], n_items: int, mean_words: float, longest: int) -> Index:
    """Index of ``rows`` (id, text); the statistics are those of all items."""
    kept = [(i, text, Counter(terms_of(text))) for i, text in rows]
    kept = [x for x in kept if x[2]]
    terms = sorted({t for x in kept for t in x[2]})
    hashes = hash_terms(terms)
    order = np.argsort(hashes)
    number = {terms[k]: place for place, k in enumerate(order.tolist())}
    found: list[list] = [[] for _ in terms]
    for place, (_, _, tf) in enumerate(kept):
        length = sum(tf.values())
        impact = {t: np.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean_words))
                  for t, n in tf.items()}
        own = sum(impact.values())
        for t, x in impact.items():
            found[number[t]].append((place, x / own))
    postings, most, runs = [], np.zeros(len(terms)), []
    for k, entries in enumerate(found):
        place = np.array([e[0] for e in entries])
        share = np.array([e[1] for e in entries])
        block, at = np.unique(place // BLOCK, return_index=True)
        postings.append((place, share, at, block, np.maximum.reduceat(share, at)))
        most[k] = share.max()
        runs.append(len(block))
    weak = np.array(runs, np.int64) > WEAK * -(-len(kept) // BLOCK) if runs else np.zeros(0, bool)
    strong = [p for p, w in zip(postings, weak) if not w]
    return Index([(i, *question_answer(text)) for i, text, _ in kept], hashes[order], postings, most, weak,
                 np.concatenate(([0], np.cumsum(np.where(weak, 0, runs)))).astype(np.int64),
                 np.concatenate([p[3] for p in strong]) if strong else np.zeros(0, np.int64),
                 np.concatenate([p[4] for p in strong]) if strong else np.zeros(0),
                 max(CELL, -(-longest // 2)))


class _Cursor:
    """One term's place in its postings."""

    __slots__ = ("items", "shares", "blocks", "maxima", "most", "at")

    def __init__(self, posting, most):
        self.items, self.shares, _, self.blocks, self.maxima = posting
        self.most, self.at = most, 0

    def item(self) -> int:
        return int(self.items[self.at]) if self.at < len(self.items) else 1 << 62

    def seek(self, item: int) -> None:
        self.at += int(np.searchsorted(self.items[self.at:], item))

    def block_most(self, block: int) -> float:
        k = int(np.searchsorted(self.blocks, block))
        return float(self.maxima[k]) if k < len(self.blocks) and self.blocks[k] == block else 0.0


def block_max_wand(index: Index, terms: np.ndarray, threshold: float = THRESHOLD, blocks: list[int] | None = None) -> list[tuple[int, float]]:
    """All items whose score for the query ``terms`` is at least ``threshold``.

    ``blocks`` names the blocks whose bound reaches it, if known already."""
    every = [_Cursor(index.postings[t], float(index.most[t])) for t in terms.tolist()]
    slack = threshold - 1e-9
    if blocks is None:
        most: Counter = Counter()
        for c in every:
            most.update(dict(zip(c.blocks.tolist(), c.maxima.tolist())))
        blocks = sorted(k for k, x in most.items() if x >= slack)
    found = []
    for block in blocks:
        for c in every:
            c.seek(block * BLOCK)
        inside = [c for c in every if c.item() < (block + 1) * BLOCK]
        limit = {id(c): c.block_most(block) for c in inside}
        while True:
            cursors = sorted((c for c in inside if c.item() < (block + 1) * BLOCK), key=_Cursor.item)
            reach, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                reach += limit[id(c)]
                if reach >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot].item()
            if cursors[0].item() < item:
                for c in cursors[:pivot]:
                    c.seek(item)
                continue
            at_item = [c for c in cursors if c.item() == item]
            score = sum(float(c.shares[c.at]) for c in at_item)
            if score >= slack:
                found.append((item, score))
            for c in at_item:
                c.at += 1
    return found


def _search(index: Index, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    """(document, item, score, question overlap, answer overlap) of verified pairs."""
    if not len(index.items):
        return
    data = LOWER[data]
    starts, ends, first = spans(data, at, LETTERS)
    hashes = word_hashes(data, starts, ends)
    term = np.searchsorted(index.hashes, hashes)
    term[term == len(index.hashes)] = 0
    known = np.flatnonzero(index.hashes[term] == hashes) if len(hashes) else np.zeros(0, np.int64)
    term = term[known]
    # Cells: runs of ``cell`` words of one document.
    words = np.diff(first)
    cells = -(-words // index.cell)
    cell_at = np.concatenate(([0], np.cumsum(cells)))
    doc = np.repeat(np.arange(len(words)), words)[known]
    cell = cell_at[doc] + (known - first[doc]) // index.cell
    blocks = -(-len(index.items) // BLOCK)
    n = int(cell_at[-1])
    if not n:
        return
    once = np.unique(cell * len(index.most) + term)  # a term counts once in a cell
    own, strong = once // len(index.most), once % len(index.most)
    weak = index.weak[strong]
    base = np.bincount(own[weak], index.most[strong[weak]], n)
    strong, own = strong[~weak], own[~weak]
    # A passage is a cell and the next of the same document.
    owner = np.repeat(np.arange(len(words)), cells)
    pair = np.append(owner[1:] == owner[:-1], False)
    hot: list[tuple[int, list[int]]] = []
    step = max(1, BOUNDS // blocks - 1)
    for s in range(0, n, step):
        # A slice of passages: their cells, and the cell after the last one.
        e = min(n, s + step + 1)
        mine = slice(*np.searchsorted(own, [s, e]))
        runs = index.bound_at[strong[mine] + 1] - index.bound_at[strong[mine]]
        spot = np.arange(int(runs.sum())) + np.repeat(index.bound_at[strong[mine]] - (np.cumsum(runs) - runs), runs)
        bound = np.bincount(np.repeat(own[mine] - s, runs) * blocks + index.bound_block[spot], index.bound[spot], (e - s) * blocks).reshape(e - s, blocks)
        bound = bound + base[s:e, None]
        total, also = bound[:min(step, n - s)].copy(), np.flatnonzero(pair[s:min(n, s + step)])
        total[also] += bound[also + 1]
        for c in np.flatnonzero(total.max(axis=1) >= THRESHOLD - 1e-9).tolist():
            hot.append((s + c, np.flatnonzero(total[c] >= THRESHOLD - 1e-9).tolist()))
    raw, best = None, {}
    edge = np.searchsorted(cell, np.arange(n + 1))
    for c, near in hot:
        d = int(owner[c])
        last = c + 1 if pair[c] else c
        hits = block_max_wand(index, np.unique(term[edge[c]:edge[last + 1]]), blocks=near)
        if not hits:
            continue
        raw = data.tobytes() if raw is None else raw
        lo = first[d] + max(0, (c - cell_at[d] - 1) * index.cell)
        hi = min(first[d + 1], first[d] + (last - cell_at[d] + 2) * index.cell)
        seen = [raw[a:b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
        for item, score in hits:
            _, question, answer = index.items[item]
            if len(question) + len(answer) < LEAST_WORDS:
                same = words[d] == len(question) + len(answer) and seen == question + answer
                q, a = (1.0, 1.0) if same else (0.0, 0.0)
            else:
                q, a = best_span(question, answer, seen)
            if enough(q, a):
                old = best.get((d, item), (0.0, 0.0, 0.0))
                best[d, item] = (max(old[0], score), max(old[1], q), max(old[2], a))
    for (d, item), values in sorted(best.items()):
        yield d, item, *values


def index_parts(items: DataFrame, id_col: str = "item_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> Iterator[Index]:
    """The index in parts of about ``part_bytes`` of text, one at a time; document
    frequencies, mean length and longest item are taken over all items."""
    rows = items.select(items[id_col].alias("id"), F.coalesce(items[text_col].cast("string"), F.lit("")).alias("text"))

    def count(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = terms_of(text)
                own = sorted(set(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None, *own], pa.binary()), pa.array([len(words)] + [1] * len(own), pa.int64())], names=["term", "n"])

    counted = rows.select("text").mapInArrow(count, "term binary, n bigint")
    whole = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    size = counted.where("term is null and n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.max("n").alias("m")).first()
    if not size.k:
        return
    parts = -(-whole // part_bytes)
    df = counted.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        mine = own.select("text").mapInArrow(count, "term binary, n bigint").where("term is not null").select("term").distinct()
        known = {bytes(r.term): r.df for r in df.join(mine, "term", "left_semi").collect()}
        held = sorted(((r.id, r.text) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield build_index(held, known, size.k, size.s / size.k, size.m)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified pair."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for part in index_parts(items, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(part)

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                data, at = utf8(batch.column(1))
                for lo, hi in chunks(at):
                    hits = list(_search(index, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]))
                    ids = batch.column(0).take(pa.array([lo + h[0] for h in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([index.items[h[1]][0] for h in hits], pa.int64() if item_type == "bigint" else None),
                         *[pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4)]],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.union(rows.mapInArrow(search, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text",
                      item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a verified pair, with their columns."""
    spark = docs.sparkSession
    at_text = docs.columns.index(text_col)
    for part in index_parts(items, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(part)

        def clean(batches, shared=shared):
            for batch in batches:
                data, at = utf8(batch.column(at_text).cast(pa.string()))
                bad = np.zeros(batch.num_rows, bool)
                for lo, hi in chunks(at):
                    bad[[lo + h[0] for h in _search(shared.value, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])]] = True
                yield batch.filter(pa.array(~bad))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
