"""Quality classifier: cumulative-link (ordinal) regression on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds
t1 < t2 < ... cut the score: P(grade >= k) = sigmoid(score - tk).  Scoring gives
the expected grade and the tail probability of the top grade; a document is
kept if the latter is at least a cut that held-out ratings set.

Features (present or not, hashed to ``2**BITS``): lower-cased words, the first
and the last bytes of the words, and binned measures of the whole text (length,
repeated words, repeated lines, capitals, short words).

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of
the id; every document is scored on its whole text.

Defined results: a null text counts as empty; rows with a null rating are not
trained on, and without any rating all grades are equally likely; repeated rows
are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, mix, spans, utf8, word_hashes

BITS = 18
TRAIN_ROWS = 8000
HELD_OUT = 5  #: one of so many training rows only sets the least tail probability
CLEAN_LOST = 0.005  #: share of top-graded held-out rows that may fall below it
MIN_DOCS = 3  #: a feature counts if so many training documents have it
EPOCHS = 40
RATE = 1.0
HEADS = (4, 6)  #: leading bytes of words that are features too
RIDGE = 1e-6
SEED = 3


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once."""
    docs, mask = len(at) - 1, np.uint64((1 << BITS) - 1)
    starts, ends, first = spans(data, at)
    count = np.diff(first)
    owner = np.repeat(np.arange(docs), count) << BITS
    low = LOWER[data]

    def once(hashes: np.ndarray) -> np.ndarray:
        key = np.sort(owner | (hashes & mask).astype(np.int64))
        return key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key

    keys = [once(word_hashes(low, starts, ends)), once(mix(word_hashes(data, np.maximum(starts, ends - 3), ends) + np.uint64(1)))]
    keys += [once(mix(word_hashes(low, starts, np.minimum(ends, starts + k)) + np.uint64(k))) for k in HEADS]
    # Measures of the text, in bins.
    n = np.maximum(count, 1)
    different = np.bincount(keys[0] >> BITS, minlength=docs)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    upper = (upper[at[1:]] - upper[at[:-1]]) / np.maximum(1, np.diff(at))
    short = np.bincount(owner >> BITS, (ends - starts) <= 2, docs)
    line = np.concatenate(([0], np.cumsum(data == 10)))
    bins = [np.minimum(12, np.log2(n)).astype(np.int64), (8 * different / n).astype(np.int64), np.minimum(9, 20 * upper).astype(np.int64),
            (10 * short / n).astype(np.int64), np.minimum(12, np.log2(1 + line[at[1:]] - line[at[:-1]])).astype(np.int64)]
    keys += [(np.arange(docs) << BITS) | (mix(np.uint64(1000 * (k + 1)) + b.astype(np.uint64)) & mask).astype(np.int64)
             for k, b in enumerate(bins)]
    key = np.concatenate(keys)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    least: float = 0.5  # tail probability of the top grade from which a document is kept

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... (rows: documents)."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def _score(weights: np.ndarray, owner: np.ndarray, idx: np.ndarray, docs: int) -> np.ndarray:
    n = np.bincount(owner, minlength=docs)
    return np.bincount(owner, weights[idx], docs) / np.sqrt(np.maximum(1, n))


def fit(rows: list[np.ndarray], grades: np.ndarray, top: int, seed: int = SEED) -> Ordinal:
    """Weights and thresholds by AdaGrad on the ordinal log-likelihood.

    Thresholds are a first value and exponentials of steps, so they stay ordered."""
    if not len(rows):
        return Ordinal(np.zeros(1 << BITS, np.float32), np.log(np.arange(1, top + 1) / np.arange(top, 0, -1)))
    seen = np.bincount(np.concatenate(rows), minlength=1 << BITS) >= MIN_DOCS
    rows = [r[seen[r]] for r in rows]
    share = np.clip([(grades >= k).mean() for k in range(1, top + 1)], 0.01, 0.99)
    cut = -np.log(share / (1 - share))
    free = np.concatenate((cut[:1], np.log(np.maximum(0.05, np.diff(cut)))))
    w, seen_w, seen_free = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), np.full(top, 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            own = order[lo:lo + 64]
            size = np.array([len(rows[k]) for k in own])
            idx = np.concatenate([rows[k] for k in own])
            scale = 1 / np.sqrt(np.maximum(1, size))
            score = np.bincount(np.repeat(np.arange(len(own)), size), w[idx], len(own)) * scale
            steps = np.exp(free[1:])
            theta = free[0] + np.concatenate(([0.0], np.cumsum(steps)))
            tail = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -40, 40)))
            # P(grade = k) = tail[k - 1] - tail[k], with tails 1 and 0 at the ends.
            full = np.concatenate([np.ones((len(own), 1)), tail, np.zeros((len(own), 1))], axis=1)
            slope = full * (1 - full)
            g = grades[own]
            at = np.arange(len(own))
            p = np.maximum(full[at, g] - full[at, g + 1], 1e-9)
            d_score = -(slope[at, g] - slope[at, g + 1]) / p
            d_theta = np.zeros((len(own), top + 2))
            d_theta[at, g] += slope[at, g] / p
            d_theta[at, g + 1] -= slope[at, g + 1] / p
            d_theta = d_theta[:, 1:-1].sum(0)
            d_free = np.concatenate(([d_theta.sum()], [d_theta[k + 1:].sum() * steps[k] for k in range(top - 1)])) / len(own)
            near, back = np.unique(idx, return_inverse=True)
            d_w = np.bincount(back, np.repeat(d_score * scale, size), len(near)) / len(own) + RIDGE * w[near]
            seen_w[near] += d_w ** 2
            w[near] -= RATE * d_w / np.sqrt(seen_w[near])
            seen_free += d_free ** 2
            free -= 0.1 * d_free / np.sqrt(seen_free)
    return Ordinal(w.astype(np.float32), free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:])))))


def fit_with_cut(rows: list[np.ndarray], grades: np.ndarray, top: int) -> Ordinal:
    """``fit`` on most rows; the others set the least tail probability that
    still keeps all but ``CLEAN_LOST`` of their top-graded rows."""
    held = np.arange(len(rows)) % HELD_OUT == HELD_OUT - 1
    model = fit([r for r, h in zip(rows, held) if not h], grades[~held], top)
    clean = [r for r, h, g in zip(rows, held, grades) if h and g == top]
    if clean:
        size = np.array([len(r) for r in clean])
        score = _score(model.weights, np.repeat(np.arange(len(clean)), size), np.concatenate(clean), len(clean))
        model.least = float(np.clip(np.quantile(model.tails(score)[:, -1], CLEAN_LOST), 0.05, 0.95))
    return model


def train(docs: DataFrame, ratings: DataFrame, grade: Column, top: int, id_col: str = "doc_id", text_col: str = "text",
          rating_id_col: str = "doc_id", limit: int = TRAIN_ROWS) -> Ordinal:
    """A model of ``grade`` (0 to ``top``), a column of ``ratings``."""
    chosen = ratings.select(ratings[rating_id_col].alias("rated"), grade.cast("int").alias("grade"),
                            F.xxhash64(ratings[rating_id_col]).alias("h")) \
        .where("rated is not null and grade is not null").orderBy("h", "rated", "grade").limit(limit).drop("h")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")) \
        .join(F.broadcast(chosen), F.col("id") == F.col("rated")).select("id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            for lo, hi in chunks(at):
                owner, idx = _features(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                order = np.argsort(owner, kind="stable")
                idx, cut = idx[order], np.searchsorted(owner[order], np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.string()), batch.column(1).slice(lo, hi - lo),
                     pa.array([idx[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["id", "grade", "idx"])

    # An id may occur in many documents: at most ``limit`` rows are kept of what the join gives.
    found = rows.mapInArrow(run, "id string, grade int, idx binary") \
        .orderBy(F.xxhash64("id"), "id", "grade", "idx").limit(limit).collect()
    found.sort(key=lambda r: (r.id, r.grade, bytes(r.idx)))
    return fit_with_cut([np.frombuffer(r.idx, "<u4").astype(np.int64) for r in found], np.array([r.grade for r in found], np.int64), top)


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_top, kept) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in chunks(at):
                tails = shared.value.tails(_score(shared.value.weights, *_features(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]), hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= shared.value.least)],
                    names=["doc_id", "expected_grade", "p_top", "kept"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, expected_grade double, p_top double, kept boolean")


def graded(labels: DataFrame) -> Column:
    """Ratings of the labels table: one point for quality, one for not being toxic."""
    return labels["quality"] + 1 - labels["toxic"]
