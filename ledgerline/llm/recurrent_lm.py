"""Language-model scoring with a gated recurrent network in numpy.

Tokens are lower-cased (A-Z) words and one end per document.  Corpus counts come
first: each document block sends its different words with their counts in
training documents, cut by word-hash range; one group per range adds them and
tells each block the totals.  From these follow the unigram ``base_score`` and
the classes of the output:

* words with at least 1/``HEAD_SHARE`` of the training tokens (so at most
  ``HEAD_SHARE``) and the end are head words, in classes of ``CLASS_WORDS``;
* all other words are in classes by the binary logarithm of their count, unseen
  words in a class of their own.

P(token) = P(class | state) * P(token | class): a softmax over classes, then a
softmax over the class's words for head classes, and the word's share of the
class's counts for the others.  The state is a GRU's; it is carried from window
to window, so a document's score is the likelihood of its whole text.

Training is truncated back-propagation with Adam; a training document's own
occurrence of a word is left out of its count, so the class of unseen words is
learnt from words that only that document has.  Every task trains a copy on all
of its training documents, starting from the unigram model, and the copies are
averaged by the tokens they saw, so the model learns from the whole corpus and
nothing but weights of a fixed size is gathered.

Defined results: a null text counts as empty (its only token is the end); a null
id counts as the empty id when training documents are chosen; repeated rows are
counted and scored like any others; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, exact_word_pairs, give_back, open_block, open_rest, pack_blocks, pin, spans, squeeze, unsqueeze

FOLDS, HELD_OUT = 5, 1
HEAD_SHARE, CLASS_WORDS = 20_000, 32
BINS = 48  #: classes by the logarithm of the count; 0: unseen
HIDDEN = 24
WINDOW, LANES, TRAIN_LANES = 32, 256, 32
TRAIN_GROUP, SCORE_GROUP = 4, 6  #: blocks laid out together, at most
HASH_BYTES = 1 << 18  #: text hashed at once, so that its arrays stay in cache
GROUP_TOKENS = 1 << 20  #: a group ends with as many tokens for each of its blocks
RATE = 0.01
PIECE = 1 << 14  #: weights that a step of training changes at once
SEED = 5
RANGE_BYTES = 1 << 25  #: text per group of the word count
AVERAGED = 64  #: weight rows that one group averages

_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])
END = np.array([(0, 0)], _PAIR)  # stands for the end of a document among the words


def fold(doc_id) -> int:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of every document's tokens, ends included, and where documents begin."""
    parts, count = [], []
    for lo, hi in chunks(at, HASH_BYTES):
        own = LOWER[data[at[lo]:at[hi]]]
        starts, ends, first = spans(own, at[lo:hi + 1] - at[lo])
        pairs = np.zeros(len(starts) + hi - lo, _PAIR)
        spot = np.arange(len(starts)) + np.repeat(np.arange(hi - lo), np.diff(first))
        pairs["a"][spot], pairs["b"][spot] = exact_word_pairs(own, starts, ends)
        parts.append(pairs)
        count.append(np.diff(first) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, _PAIR),
            np.concatenate(([0], np.cumsum(np.concatenate(count)))) if count else np.zeros(1, np.int64))


def _vocabulary(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different fingerprints, sorted, and the place of each token among them."""
    a, b = (np.ascontiguousarray(tokens[k]) for k in "ab")
    order = np.argsort(a)
    new_a, new_b = np.diff(a[order]) != 0, np.diff(b[order]) != 0
    if (new_b & ~new_a).any():  # words that share a first half are told apart by the second
        order = np.lexsort((b, a))
        new_a, new_b = np.diff(a[order]) != 0, np.diff(b[order]) != 0
    new = np.concatenate((np.ones(min(1, len(a)), bool), new_a | new_b))
    back = np.empty(len(tokens), np.int64)
    back[order] = np.cumsum(new) - 1
    return tokens[order[new]], back


def _cuts(pairs: np.ndarray, ranges: int) -> np.ndarray:
    edges = np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)
    return np.append(np.searchsorted(pairs["a"], edges), len(pairs))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
            give_back()


def bin_of(counts: np.ndarray) -> np.ndarray:
    """Class of a word by its count: 0 unseen, then 1 + floor(log2(count))."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64), 0).clip(0, BINS - 1)


# --- counts ------------------------------------------------------------------------

def count_words(blocks: DataFrame, ranges: int) -> DataFrame:
    """Rows with a block: the counts of its words in range r.  Rows without: of
    range r the numbers of seen words and tokens by bin, and the words that may be head words."""
    def ask(batches):
        for row in _rows(batches):
            data, at = open_block(row["sizes"].values.to_numpy(), row["data"].as_py())
            tokens, first = _words(data, at)
            learn = np.array([fold(i) != HELD_OUT for i in open_rest(row["rest"].as_py())["c0"].to_pylist()])
            words, back = _vocabulary(tokens)
            count = np.bincount(back, np.repeat(learn, np.diff(first)), len(words)).astype(np.int64)
            cut = _cuts(words, ranges)
            some = np.flatnonzero(np.diff(cut)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([row["block"].as_py()] * len(some), pa.string()),
                 pa.array([words[cut[r]:cut[r + 1]].tobytes() for r in some], pa.binary()),
                 pa.array([squeeze(count[cut[r]:cut[r + 1]]) for r in some], pa.binary())], names=["r", "block", "words", "counts"])

    def add(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x.as_py(), _PAIR) for x in table["words"]]
        counts = np.concatenate([np.frombuffer(unsqueeze(x.as_py()), np.int64) for x in table["counts"]])
        own, back = _vocabulary(np.concatenate(words))
        total = np.bincount(back, counts, len(own)).astype(np.int64)
        told = np.split(total[back], np.cumsum([len(w) for w in words])[:-1])
        bins = np.bincount(bin_of(total), minlength=BINS), np.bincount(bin_of(total), total, BINS).astype(np.int64)
        # At most HEAD_SHARE words have that share of the tokens of all blocks, and no more of this range's.
        often = np.flatnonzero((total * HEAD_SHARE >= total.sum()) & (total > 0))
        often = often[np.argsort(-total[often], kind="stable")]
        n = len(table)
        return pa.table({
            "r": pa.array([*table["r"].to_pylist(), table["r"][0].as_py()], pa.int32()),
            "block": pa.array([*table["block"].to_pylist(), None], pa.string()),
            "answer": pa.array([*[squeeze(t) for t in told], None], pa.binary()),
            "types": pa.array([None] * n + [bins[0].tolist()], pa.list_(pa.int64())),
            "tokens": pa.array([None] * n + [bins[1].tolist()], pa.list_(pa.int64())),
            "heads": pa.array([None] * n + [[{"a": int(own["a"][k].view(np.int64)), "b": int(own["b"][k].view(np.int64)), "n": int(total[k])}
                                             for k in often]], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])))})

    asked = blocks.select("block", "sizes", "data", "rest").mapInArrow(ask, "r int, block string, words binary, counts binary")
    return pin(asked.groupBy("r").applyInArrow(
        add, "r int, block string, answer binary, types array<bigint>, tokens array<bigint>, heads array<struct<a:bigint,b:bigint,n:bigint>>"), "counts")


class Symbols:
    """What the model tells apart: head words (the end first), then the bins of other words."""

    def __init__(self, heads: list[tuple[int, int, int]], types: np.ndarray, tokens: np.ndarray):
        pairs = np.zeros(len(heads), _PAIR)
        for k, (a, b, _) in enumerate(heads):
            pairs[k] = (np.int64(a).view(np.uint64), np.int64(b).view(np.uint64))
        self.head_count = np.array([h[2] for h in heads], np.float64)
        order = np.lexsort((pairs["b"], pairs["a"]))
        self.sorted, self.order = pairs[order], order
        self.n_tokens, self.n_types = int(tokens.sum()), int(types[1:].sum())
        heads_in = bin_of(self.head_count.astype(np.int64)) if len(heads) else np.zeros(0, np.int64)
        left_types = types - np.bincount(heads_in, minlength=BINS)
        left_tokens = tokens - np.bincount(heads_in, self.head_count, BINS)
        left_types[0] = 1  # one place for all unseen words, as in the base score
        self.mass = left_tokens + 0.5 * np.maximum(left_types, 1)
        self.classes = -(-len(heads) // CLASS_WORDS)
        # What classes hold when a word's own occurrence is left out: once-seen words are then unseen.
        self.left_out = self.mass.copy()
        self.left_out[:2] = max(0.5, left_tokens[1]), max(0.5, left_tokens[2] / 2)
        # No word falls into a class above the most frequent of the other words'.
        self.left_out = self.left_out[:1 + int(np.flatnonzero(left_types)[-1])]

    def place(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each different word, and log10 of its share of its class (0 for head words)."""
        symbol = len(self.order) + bin_of(counts)
        fixed = np.log10((counts + 0.5) / self.mass[bin_of(counts)])
        fixed[counts == 0] = 0.0
        if len(self.sorted):
            at = np.searchsorted(self.sorted["a"], words["a"])  # different words share no first half among the heads
            at[at == len(self.sorted)] = 0
            hit = self.sorted[at] == words
            symbol[hit], fixed[hit] = self.order[at[hit]], 0.0
        return symbol, fixed


# --- the network -----------------------------------------------------------------------

def _near(weights: np.ndarray) -> bool:
    """Whether states (each value within -1 and 1) move sums less than float32's exp can bear."""
    return bool(np.abs(weights).max(axis=-1).sum(axis=-1).max() < 80)


def _softmax(z: np.ndarray, at: np.ndarray, hit: np.ndarray, weight: np.ndarray | None, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log of the softmax of each row of ``z`` (overwritten) at its place ``hit``; with ``weight``, also the
    gradient of its negative.  ``near``: z holds sums about a bias of 0 at most, so needs no shift by row."""
    if not near:
        z -= z.max(axis=1, keepdims=True)
    found = z[at, hit]
    exp = np.exp(z, out=z)
    total = exp @ np.ones(exp.shape[1], exp.dtype)
    found -= np.log(total)
    if weight is not None:
        exp *= (weight / total)[:, None]
        exp[at, hit] -= weight
    return found, exp


class Network:
    """GRU over symbols with the class-factored output.

    ``e``: what each symbol adds to the gates (update, reset, new state);
    ``u``, ``c``: the state's part of them; ``k``, ``kb``: class output;
    ``w``, ``wb``: word output of the head classes (class, state, word)."""

    def __init__(self, symbols: Symbols, hidden: int = HIDDEN, seed: int = SEED):
        rng, s = np.random.default_rng(seed), symbols
        heads, classes, bins = len(s.order), s.classes, len(s.left_out)
        self.hidden, self.heads, self.classes = hidden, heads, classes
        word = np.full((classes, CLASS_WORDS), -30.0)
        word.reshape(-1)[:heads] = np.log(s.head_count + 0.5) if heads else 0
        top = word.max(axis=1, keepdims=True) if classes else word[:, :1]
        total = (top + np.log(np.exp(word - top).sum(axis=1, keepdims=True)))
        group = np.concatenate([total[:, 0], np.log(np.maximum(s.left_out, 0.5))])
        self.p = {
            "e": rng.normal(0, 0.1, (heads + BINS, 3 * hidden))[:heads + bins], "u": rng.normal(0, 0.15, (hidden, 3 * hidden)),
            "c": np.concatenate([np.full(hidden, -1.0), np.zeros(2 * hidden)]),
            "k": np.zeros((hidden, classes + bins)), "kb": group - group.max(),
            "w": np.zeros((classes, hidden, CLASS_WORDS)), "wb": word - total}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pack(self) -> bytes:
        return b"".join(v.tobytes() for v in self.p.values())

    def unpack(self, raw: bytes) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = np.frombuffer(raw, np.float32, v.size, at).reshape(v.shape).copy()
            at += v.nbytes
        return self

    def window(self, symbols: np.ndarray, begins: np.ndarray, state: np.ndarray, keep: bool):
        """States before each symbol of a window (time, lane), and the state after it; with ``keep``
        also gates and new states (time, 3 x hidden, lane) and the states that the reset gate let through.

        Inside, lanes are the last axis, so that a gate is one run of memory; gates are halved
        tangents (sigmoid(x) = (1 + tanh(x / 2)) / 2) written over what the symbols add."""
        h, u, (steps, lanes) = self.hidden, self.p["u"], symbols.shape
        gates, new = np.ascontiguousarray(u[:, :2 * h].T) * 0.5, np.ascontiguousarray(u[:, 2 * h:].T)
        tape = np.ascontiguousarray(self.p["e"][symbols].transpose(0, 2, 1))
        tape += self.p["c"][:, None]
        tape[:, :2 * h] *= 0.5
        before, gated = np.empty((steps + 1, h, lanes), u.dtype), np.empty((steps if keep else 1, h, lanes), u.dtype)
        before[0] = state.T
        step, fresh = np.empty((h, lanes), u.dtype), begins.any(axis=1).tolist()
        for t in range(steps):
            s, z_r, n, rs = before[t], tape[t, :2 * h], tape[t, 2 * h:], gated[t if keep else 0]
            if fresh[t]:
                s[:, begins[t]] = 0
            z_r += gates @ s
            np.tanh(z_r, out=z_r)
            z_r *= 0.5
            z_r += 0.5
            np.multiply(z_r[h:], s, out=rs)
            n += new @ rs
            np.tanh(n, out=n)
            np.subtract(n, s, out=step)
            step *= z_r[:h]
            np.add(s, step, out=before[t + 1])
        return before[:steps].transpose(0, 2, 1), before[steps].T, (tape, gated) if keep else None

    def output(self, before: np.ndarray, symbols: np.ndarray, grads: dict | None = None, weight: np.ndarray | None = None):
        """Natural log probability of each symbol; with ``grads``, also sets their gradients and returns the states'."""
        h, y = self.hidden, symbols.reshape(-1)
        x = np.ones((len(y), h + 1), before.dtype)  # the last column meets the biases
        x[:, :h] = before.reshape(-1, h)
        group = np.where(y < self.heads, y // CLASS_WORDS, y - self.heads + self.classes)
        at, d_x = np.arange(len(y)), None
        weight = None if grads is None else weight.reshape(-1)
        z = x @ np.concatenate([self.p["k"], (self.p["kb"] - self.p["kb"].max())[None]])
        out, exp = _softmax(z, at, group, weight, _near(self.p["k"]))
        if grads is not None:
            both = x.T @ exp
            grads["k"][:], grads["kb"][:] = both[:h], both[h]
            d_x = exp @ self.p["k"].T
        # Tokens of head classes by class: one product for each class, everything else at once.
        order = np.argsort(group.astype(np.uint16), kind="stable")
        cut = np.searchsorted(group[order], np.arange(self.classes + 1))
        order = order[:cut[-1]]
        held = np.flatnonzero(np.diff(cut))
        if not len(held):
            return out.reshape(symbols.shape), d_x
        words, runs = self.p["w"][held], [slice(cut[c], cut[c + 1]) for c in held.tolist()]
        x, bias = x[order], self.p["wb"][held]
        z, both = np.empty((len(order), CLASS_WORDS), x.dtype), np.concatenate([words, (bias - bias.max(axis=1, keepdims=True))[:, None]], axis=1)
        for k, run in enumerate(runs):
            np.matmul(x[run], both[k], out=z[run])
        found, exp = _softmax(z, at[:len(order)], y[order] - group[order] * CLASS_WORDS, None if grads is None else weight[order], _near(words))
        out[order] += found
        if grads is not None:
            back, turned = np.empty((len(order), h), x.dtype), words.transpose(0, 2, 1)
            for k, run in enumerate(runs):
                np.matmul(x[run].T, exp[run], out=both[k])
                np.matmul(exp[run], turned[k], out=back[run])
            grads["w"][held], grads["wb"][held] = both[:, :h], both[:, h]
            d_x[order] += back
        return out.reshape(symbols.shape), d_x

    def gradients(self, symbols: np.ndarray, begins: np.ndarray, live: np.ndarray, state: np.ndarray, g: dict | None = None):
        """Gradients of the mean loss of one window (no further back), in ``g`` (zeros) if given, and the state after it."""
        h, u = self.hidden, self.p["u"]
        g = {k: np.zeros_like(v) for k, v in self.p.items()} if g is None else g
        before, after, (tape, gated) = self.window(symbols, begins, state, True)
        rows = before.reshape(-1, h)
        _, d_x = self.output(rows, symbols, g, (live / max(1, live.sum())).astype(u.dtype))
        d_x = np.ascontiguousarray(d_x.reshape(before.shape).transpose(0, 2, 1))
        s, z, r, n = before.transpose(0, 2, 1), tape[:, :h], tape[:, h:2 * h], tape[:, 2 * h:]
        stay = 1 - z
        to_n, to_z, to_r = z * (1 - n * n), (n - s) * z * stay, gated * (1 - r)
        gates, new = np.ascontiguousarray(u[:, :2 * h]), np.ascontiguousarray(u[:, 2 * h:])
        d_add, d_state, fresh = np.empty_like(tape), np.zeros_like(d_x[0]), begins.any(axis=1).tolist()
        for t in range(len(symbols) - 1, -1, -1):
            own = d_add[t]
            np.multiply(d_state, to_z[t], out=own[:h])
            np.multiply(d_state, to_n[t], out=own[2 * h:])
            back = new @ own[2 * h:]
            np.multiply(back, to_r[t], out=own[h:2 * h])
            back *= r[t]
            d_state *= stay[t]
            d_state += back
            d_state += gates @ own[:2 * h]
            d_state += d_x[t]
            if fresh[t]:
                d_state[:, begins[t]] = 0
        flat = d_add.transpose(0, 2, 1).reshape(-1, 3 * h)
        g["u"][:, :2 * h] = rows.T @ flat[:, :2 * h]
        g["u"][:, 2 * h:] = gated.transpose(0, 2, 1).reshape(-1, h).T @ flat[:, 2 * h:]
        order = np.argsort(symbols.reshape(-1).astype(np.uint16), kind="stable")
        held = symbols.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
        added = np.add.reduceat(flat[order], first, axis=0)
        g["e"][held[first]], g["c"][:] = added, added.sum(axis=0)
        return g, after


def grouped(blocks: Iterator[tuple], most: Iterator[int]) -> Iterator[tuple[np.ndarray, np.ndarray, list, int]]:
    """Symbols, sizes, other parts and room of runs of at most next(most) blocks (symbols, sizes, other).

    Blocks that are laid out together fill wide lanes to the end of their longest documents."""
    held, tokens, room = [], 0, 0
    for block in blocks:
        room = room or next(most)
        held.append(block)
        tokens += len(block[0])
        if len(held) == room or tokens >= room * GROUP_TOKENS:
            yield np.concatenate([b[0] for b in held]), np.concatenate([b[1] for b in held]), [b[2] for b in held], len(held)
            held, tokens, room = [], 0, 0
    if held:
        yield np.concatenate([b[0] for b in held]), np.concatenate([b[1] for b in held]), [b[2] for b in held], len(held)


def growing() -> Iterator[int]:
    """1, 2, 4, ... blocks: updates get wider as a copy has learnt more."""
    room = 1
    while True:
        yield room
        room = min(2 * room, TRAIN_GROUP)


def lay_out(sizes: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole documents on at most ``lanes`` lanes of like length, longest lane first.

    Returns for each place (time, lane) the document (-1: none) and the place in it."""
    lanes = max(1, min(lanes, len(sizes)))
    heap = [(0, k) for k in range(lanes)]
    held: list[list[int]] = [[] for _ in range(lanes)]
    for doc in np.argsort(-sizes, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        held[k].append(doc)
        heapq.heappush(heap, (n + int(sizes[doc]), k))
    length = np.zeros(lanes, np.int64)
    for n, k in heap:
        length[k] = n
    order = np.argsort(-length, kind="stable")
    steps = int(length.max(initial=0))
    doc, place = np.full((steps, lanes), -1, np.int32), np.zeros((steps, lanes), np.int32)
    for lane, k in enumerate(order.tolist()):
        at = 0
        for d in held[k]:
            n = int(sizes[d])
            doc[at:at + n, lane], place[at:at + n, lane] = d, np.arange(n)
            at += n
    return doc, place


def _windows(symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray, lanes: int):
    """Windows (documents, symbols, begins, live) in the order of time; lanes that ended fall away."""
    if not len(sizes):
        return
    doc, place = lay_out(sizes, lanes)
    for t in range(0, len(doc), WINDOW):
        live = doc[t:t + WINDOW] >= 0
        n = int(live[0].sum())
        own, live = doc[t:t + WINDOW, :n], live[:, :n]
        at = np.where(live, first[own] + place[t:t + WINDOW, :n], 0)
        yield own, np.where(live, symbols[at], 0).astype(np.int64), (place[t:t + WINDOW, :n] == 0) & live, live


def score_block(net: Network, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each document's symbols; the state runs through whole documents."""
    first = np.cumsum(sizes) - sizes
    out, state = np.zeros(len(sizes)), None
    for doc, own, begins, live in _windows(symbols, first, sizes, LANES):
        state = np.zeros((own.shape[1], net.hidden), np.float32) if state is None else state[:own.shape[1]]
        before, state, _ = net.window(own, begins, state, False)
        found, _ = net.output(before, own)
        out += np.bincount(doc[live], found[live], len(sizes))
    return out / np.log(10)


class Trainer:
    """Adam over windows; the state is carried, gradients stop at the window's start.
    Weights and gradients are views of one vector each, so that a step is a few passes."""

    def __init__(self, net: Network):
        self.net, self.step, self.seen = net, 0, 0
        self.flat = np.concatenate([v.reshape(-1) for v in net.p.values()])
        self.grad, self.first, self.second = (np.zeros_like(self.flat) for _ in range(3))
        self.work = np.zeros(PIECE, self.flat.dtype)
        at, self.g = 0, {}
        for k, v in net.p.items():
            net.p[k], self.g[k] = (x[at:at + v.size].reshape(v.shape) for x in (self.flat, self.grad))
            at += v.size

    def block(self, symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray, lanes: int = TRAIN_LANES) -> None:
        state = None
        for _, own, begins, live in _windows(symbols, first, sizes, lanes):
            state = np.zeros((own.shape[1], self.net.hidden), np.float32) if state is None else state[:own.shape[1]]
            _, state = self.net.gradients(own, begins, live, state, self.g)
            self.seen += int(live.sum())
            self.update()

    def update(self) -> None:
        """A step of Adam, in pieces that stay in cache; the gradients are zero afterwards."""
        self.step += 1
        scale = min(1, 1 / (np.sqrt(float(self.grad @ self.grad)) + 1e-9))
        even = np.sqrt(1 - 0.999 ** self.step)
        rate = even * RATE / (1 + self.step / 2000) / (1 - 0.9 ** self.step)
        for lo in range(0, len(self.flat), PIECE):
            x, first, second, flat = (v[lo:lo + PIECE] for v in (self.grad, self.first, self.second, self.flat))
            work = self.work[:len(x)]
            np.multiply(x, np.float32(0.1 * scale), out=work)
            first *= np.float32(0.9)
            first += work
            x *= np.float32(scale)
            x *= x
            x *= np.float32(0.001)
            second *= np.float32(0.999)
            second += x
            np.sqrt(second, out=work)
            work += np.float32(1e-6 * even)
            np.divide(first, work, out=work)
            work *= np.float32(rate)
            flat -= work
            x.fill(0)


# --- on Spark -----------------------------------------------------------------------------

def _averaged(copies: DataFrame) -> bytes | None:
    """Mean of the copies by tokens seen, in groups of at most about ``AVERAGED`` rows."""
    def mean(table: pa.Table) -> pa.Table:
        seen = table["seen"].to_pylist()
        total = sum(np.frombuffer(unsqueeze(w.as_py()), np.float32).astype(np.float64) * n for w, n in zip(table["weights"], seen))
        return pa.table({"id": pa.array([table["id"][0].as_py()], pa.string()), "seen": pa.array([sum(seen)], pa.int64()),
                         "weights": pa.array([squeeze((total / sum(seen)).astype(np.float32))], pa.binary())})

    while (n := copies.count()) > 1:
        parts = -(-n // AVERAGED)
        copies = pin(copies.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("g")
                     .applyInArrow(mean, "id string, seen bigint, weights binary"), "mean-weights")
    rows = copies.collect()
    return unsqueeze(rows[0].weights) if rows else None


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    blocks = pack_blocks(docs, text_col, [id_col])
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0]
    if size is None:
        return spark.createDataFrame([], out)
    ranges = max(1, -(-size // RANGE_BYTES))
    counted = count_words(blocks, ranges)
    whole = counted.where("block is null")
    bins = {r.pos: (r.types, r.tokens) for r in whole.select(F.posexplode(F.arrays_zip("types", "tokens")).alias("pos", "x"))
            .groupBy("pos").agg(F.sum("x.types").alias("types"), F.sum("x.tokens").alias("tokens")).collect()}
    types, tokens = (np.array([bins[k][j] for k in range(BINS)], np.int64) for j in (0, 1))
    n_tokens = int(tokens.sum())
    heads = whole.select(F.explode("heads").alias("x")).select("x.*").where(F.col("n") * HEAD_SHARE >= n_tokens)
    chosen = [(r.a, r.b, r.n) for r in heads.where("a <> 0 or b <> 0").orderBy(F.desc("n"), "a", "b").collect()]
    end = heads.where("a = 0 and b = 0").collect()
    table = Symbols([(0, 0, r.n) for r in end] + chosen, types, tokens)
    shared = spark.sparkContext.broadcast(table)
    told = counted.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("r", "answer")).alias("answers"))

    def symbols(batches):
        for row in _rows(batches):
            s = shared.value
            data, at = open_block(row["sizes"].values.to_numpy(), row["data"].as_py())
            own, first = _words(data, at)
            words, back = _vocabulary(own)
            cut, answers = _cuts(words, ranges), {x["r"]: x["answer"] for x in row["answers"].as_py()}
            counts = np.zeros(len(words), np.int64)
            for r in np.flatnonzero(np.diff(cut)).tolist():
                counts[cut[r]:cut[r + 1]] = np.frombuffer(unsqueeze(answers[r]), np.int64)
            symbol, fixed = s.place(words, counts)
            base = np.log10((counts + 0.5) / (s.n_tokens + 0.5 * (s.n_types + 1)))
            starts = first[:-1]
            ids = open_rest(row["rest"].as_py())["c0"].to_pylist()
            chosen = np.array([fold(i) != HELD_OUT for i in ids], bool)
            learn = s.place(words, np.maximum(counts - 1, 0))[0][back[np.repeat(chosen, np.diff(first))]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["rest"].as_py()], pa.binary()), pa.array([squeeze(symbol[back].astype(np.uint16))], pa.binary()),
                 pa.array([np.diff(first)], pa.list_(pa.int64())), pa.array([np.add.reduceat(counts[back] > 0, starts, dtype=np.int64)], pa.list_(pa.int64())),
                 pa.array([np.add.reduceat(base[back], starts)], pa.list_(pa.float64())),
                 pa.array([np.add.reduceat(fixed[back], starts)], pa.list_(pa.float64())),
                 pa.array([squeeze(learn.astype(np.uint16))], pa.binary()), pa.array([np.diff(first)[chosen]], pa.list_(pa.int64()))],
                names=["rest", "symbols", "sizes", "known", "base", "fixed", "learn", "learn_sizes"])

    placed = pin(blocks.join(told, "block").select("sizes", "data", "rest", "answers").mapInArrow(
        symbols, "rest binary, symbols binary, sizes array<bigint>, known array<bigint>, base array<double>, fixed array<double>, "
        "learn binary, learn_sizes array<bigint>"), "symbols")

    def learn(batches):
        import uuid

        trainer = None
        blocks = ((np.frombuffer(unsqueeze(row["learn"].as_py()), np.uint16), row["learn_sizes"].values.to_numpy(), None) for row in _rows(batches))
        for own, sizes, _, n in grouped(blocks, growing()):
            trainer = trainer or Trainer(Network(shared.value))
            trainer.block(own, np.cumsum(sizes) - sizes, sizes, n * TRAIN_LANES)
        if trainer and trainer.seen:
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([trainer.seen], pa.int64()),
                                              pa.array([squeeze(trainer.net.pack())], pa.binary())], names=["id", "seen", "weights"])

    weights = _averaged(pin(placed.select("learn", "learn_sizes").mapInArrow(learn, "id string, seen bigint, weights binary"), "weights"))
    model = spark.sparkContext.broadcast(weights)

    def likelihood(batches):
        net, blocks = None, ((np.frombuffer(unsqueeze(row["symbols"].as_py()), np.uint16), row["sizes"].values.to_numpy(),
                              [open_rest(row["rest"].as_py())["c0"].combine_chunks(), *(row[k].values for k in ("known", "base", "fixed"))])
                             for row in _rows(batches))
        for own, sizes, other, _ in grouped(blocks, itertools.repeat(SCORE_GROUP)):
            if net is None:
                net = Network(shared.value)
                net = net.unpack(model.value) if model.value else net
            ids, known, base, fixed = (pa.concat_arrays(x) for x in zip(*other))
            found = score_block(net, own, sizes)
            held = [fold(i) == HELD_OUT for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held), pa.array(sizes), known, pa.array([shared.value.n_tokens] * len(ids), pa.int64()),
                 base, pa.array(found + fixed.to_numpy())], names=[x.split()[0] for x in out.split(", ")])

    return placed.select("rest", "symbols", "sizes", "known", "base", "fixed").mapInArrow(likelihood, out)
