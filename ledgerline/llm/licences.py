"""Licence scan: a trained paragraph classifier, confirmed by templates.

Paragraphs are runs of lines with words, numbered by their first line, and read
in overlapping segments of the whole run and of each of its lines.  A sparse
softmax regression over hashed word 1- to 3-grams gives each segment a licence
family, ``unknown`` (a licence of no known family) or ordinary text.  It is
trained on copies of statement templates (words lost, changed case, ordinary
words around them), on made-up licence names for ``unknown``, and on lines of a
sample of at most ``SAMPLE_DOCS`` documents.  Held-out copies set a temperature,
so probabilities are calibrated; a family less likely than one half, or that no
template of it confirms, is reported as ``unknown``.  Of templates that differ
in few words the one that fits the segment and the words around it best counts,
and what remains of a segment without the confirmed statements must itself speak
of a licence to be reported.

Every segment of every paragraph is scored; nothing is chosen before.

Defined results: null and empty texts have no paragraph; one row for each
paragraph and reported family; repeated documents are scanned row by row; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LETTERS, LOWER, chunks, mix, sample_texts, spans, utf8, word_hashes

BITS = 16
SEGMENT, STRIDE = 40, 20
SCORED = 4096  #: segments scored at once
SAMPLE_DOCS = 200
SAMPLE_CHARS = 20_000  #: longer documents are not sampled (all are scanned)
COPIES = 60
EPOCHS = 6
CONFIRM = 0.6  #: share of a template's trigrams that a paragraph must have
SEED = 9

# Statements by which texts name their licence.
STATEMENTS = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the Apache License 2.0.",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3.",
                "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GNU GPL v2.",
                "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "lgpl": ["Licensed under the GNU Lesser General Public License.", "Released under the LGPL.",
             "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3."],
    "bsd": ["Released under the BSD License.", "Licensed under the 3-clause BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["Licensed under the Mozilla Public License, Version 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "isc": ["Released under the ISC License.",
            "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "epl-2.0": ["Licensed under the Eclipse Public License, Version 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission."],
}
# Names of the families in the tags of package files.
TAGS = {"mit": "MIT", "apache-2.0": "Apache-2.0", "gpl-3.0": "GPL-3.0", "gpl-2.0": "GPL-2.0", "lgpl": "LGPL", "agpl-3.0": "AGPL-3.0", "bsd": "BSD",
        "mpl-2.0": "MPL-2.0", "isc": "ISC", "epl-2.0": "EPL-2.0", "unlicense": "Unlicense", "cc0": "CC0-1.0", "cc-by-4.0": "CC-BY-4.0",
        "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc-by-nc-4.0": "CC-BY-NC-4.0", "cc-by-nd-4.0": "CC-BY-ND-4.0"}
for _family, _tag in TAGS.items():
    STATEMENTS[_family] += [f"SPDX-License-Identifier: {_tag}", f"License: {_tag}"]
# Statements with a place for any name.
ANY_LICENCE = ["Licensed under the {} License.", "Released under the {} License, Version {}.", "This work is licensed under {}.",
               "Distributed under the terms of the {} licence.", "You may use this under the {} agreement.",
               "Released under {}.", "Licensed under {}.", "Distributed under {}."]

# Words that keep a sampled line from being taken as ordinary text.
CUES = {b"license", b"licence", b"licensed", b"licenced", b"licenses", b"licences", b"copyright", b"gpl", b"lgpl", b"agpl", b"cc0"}

FAMILIES = [*STATEMENTS, "unknown"]
ORDINARY = len(FAMILIES)
_PLAIN = bytes(LOWER[b] if LETTERS[b] else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


def _hash_words(words: list[bytes]) -> np.ndarray:
    size = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(size + 1) - size - 1
    return word_hashes(np.frombuffer(b" ".join(words), np.uint8), starts, starts + size)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(3) + words[1:])


def _grams(words: list[bytes]) -> np.ndarray:
    """Different hashed 1- to 3-grams."""
    h = _hash_words(words)
    two = pair_hashes(h)
    three = mix(two[:-1] * np.uint64(5) + h[2:]) if len(h) > 2 else two[:0]
    return np.unique(np.concatenate([h, two, three]) & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Classifier:
    weights: np.ndarray  # (feature, class)
    bias: np.ndarray
    temperature: float
    templates: list  # (family, trigrams)

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        x = _grams(words)
        z = (self.weights[x].sum(axis=0) / np.sqrt(max(1, len(x))) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def similarity(self, family: str, words: list[bytes]) -> float:
        """Largest share of a template's n-grams among the words."""
        return max((_share(size, grams, words) for name, size, grams in self.templates if name == family), default=0.0)

    def variant(self, family: str, words: list[bytes]) -> str:
        """The family whose template, among those much like the family's best one, fits the words best."""
        own = max((t for t in self.templates if t[0] == family), key=lambda t: _share(*t[1:], words))
        like = [t for t in self.templates if t[1] == own[1] and len(t[2] & own[2]) >= CONFIRM * max(len(t[2]), len(own[2]))]
        return max([own, *like], key=lambda t: _share(*t[1:], words))[0]

    def spots(self, family: str, words: list[bytes]) -> list[int]:
        """Places of the words that are part of an n-gram of the family's templates."""
        return sorted({k + i for name, size, grams in self.templates if name == family
                       for k in range(len(words) - size + 1) if tuple(words[k:k + size]) in grams for i in range(size)})


def _share(size: int, grams: set, words: list[bytes]) -> float:
    return len(grams & {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}) / len(grams)


def _template(text: str) -> tuple[int, set]:
    words = words_of(text)
    size = min(3, len(words))
    return size, {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def train(lines: list[str], seed: int = SEED) -> Classifier:
    """A classifier trained on statements among words of ``lines``."""
    rng = np.random.default_rng(seed)
    templates = [(f, *_template(t)) for f, texts in STATEMENTS.items() for t in texts]
    plain = Classifier(np.zeros((0, 0)), np.zeros(0), 1.0, templates)
    ordinary = [w for w in (words_of(t)[:SEGMENT] for t in lines) if len(w) > 1]
    openings = [words_of(t.split("{}")[0]) for t in ANY_LICENCE]
    ordinary = [w for w in ordinary if not CUES & set(w) and all(w[:len(o)] != o for o in openings) and all(plain.similarity(f, w) < CONFIRM for f in STATEMENTS)]
    pool = [x for w in ordinary for x in w] or [b"text"]
    some = lambda n: [pool[k] for k in rng.integers(len(pool), size=n)]
    made_up = lambda n: [b"%x" % x for x in rng.integers(1 << 62, size=n)]
    samples: list[tuple[list[bytes], int]] = [(w, ORDINARY) for w in ordinary]
    for k, texts in enumerate(STATEMENTS.values()):
        for text in texts:
            words = words_of(text)
            for copy in range(COPIES):
                kept = [w for w in words if copy == 0 or rng.random() > 0.04] or words
                around = 0 if copy < 10 else int(rng.integers(0, max(1, SEGMENT - len(kept))))
                cut = int(rng.integers(0, around + 1))
                samples.append((some(cut) + kept + some(around - cut), k))
    for text in ANY_LICENCE:
        for copy in range(4 * COPIES):
            name = " ".join(x.decode("utf-8", "replace") for x in (some, made_up)[copy % 2](int(rng.integers(1, 4))))
            samples.append((words_of(text.format(name, rng.integers(1, 9))), FAMILIES.index("unknown")))
    for _ in range(20 * COPIES):
        samples.append((some(int(rng.integers(2, SEGMENT))), ORDINARY))
    # Words that no sample has, one word again and again, and a few words are ordinary text too.
    for _ in range(10 * COPIES):
        n = int(rng.integers(1, SEGMENT))
        samples += [(w, ORDINARY) for w in (made_up(n), made_up(1) * n, some(1) * n, some(1 + n % 4), some(1 + n % 4))]
    rng.shuffle(samples)
    x, y = [_grams(w) for w, _ in samples], np.array([k for _, k in samples])
    held = np.arange(len(x)) % 5 == 4
    w, b = np.zeros((1 << BITS, ORDINARY + 1)), np.zeros(ORDINARY + 1)
    seen_w, seen_b = np.full_like(w, 1e-6), np.full_like(b, 1e-6)

    def logits(own) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(x[k]) for k in own])
        idx = np.concatenate([x[k] for k in own])
        scale = 1 / np.sqrt(size)
        z = np.add.reduceat(w[idx], np.cumsum(size) - size, axis=0) * scale[:, None] + b
        return z - z.max(axis=1, keepdims=True), idx, size, scale

    for _ in range(EPOCHS):
        order = rng.permutation(np.flatnonzero(~held))
        for lo in range(0, len(order), 64):
            own = order[lo:lo + 64]
            z, idx, size, scale = logits(own)
            d = np.exp(z)
            d /= d.sum(axis=1, keepdims=True)
            d[np.arange(len(own)), y[own]] -= 1
            d /= len(own)
            near, back = np.unique(idx, return_inverse=True)
            g = np.zeros((len(near), w.shape[1]))
            np.add.at(g, back, np.repeat(d * scale[:, None], size, axis=0))
            seen_w[near] += g ** 2
            w[near] -= 0.5 * g / np.sqrt(seen_w[near])
            seen_b += d.sum(axis=0) ** 2
            b -= 0.1 * d.sum(axis=0) / np.sqrt(seen_b)
    own = np.flatnonzero(held)
    z, truth = logits(own)[0], y[own]

    def loss(t: float) -> float:
        p = z / t - np.log(np.exp(z / t).sum(axis=1, keepdims=True))
        return -p[np.arange(len(own)), truth].mean()

    temperature = min((float(t) for t in np.geomspace(0.1, 10, 41)), key=loss)
    return Classifier(w.astype(np.float32), b.astype(np.float32), temperature, templates)


def classify(model: Classifier, words: list[bytes], lines: list[tuple[int, int]] = []) -> list[tuple[str, str, float, float]]:
    """(family, predicted, probability, similarity) of each licence found in a paragraph.  ``lines``: its lines' first words and ends."""
    found = []
    for first, last in [(0, len(words)), *lines]:
        for lo in range(first, max(first + 1, last - SEGMENT + STRIDE), STRIDE):
            own = words[lo:min(lo + SEGMENT, last)]
            p = model.probabilities(own)
            k = int(p.argmax())
            if k != ORDINARY:
                found.append((lo, lo + len(own), FAMILIES[k], float(p[k]), model.similarity(FAMILIES[k], own)))
    sure: dict[str, tuple[float, float, str]] = {}
    best: dict[str, tuple[float, float]] = {}
    told = np.zeros(len(words), bool)
    for lo, hi, name, p, similar in found:
        if p >= 0.5 and similar >= CONFIRM:
            start = max(0, lo - STRIDE)
            near = words[start:hi + STRIDE]
            family = model.variant(name, near)
            told[[start + k for k in model.spots(family, near)]] = True
            sure[family] = max(sure.get(family, (0.0, 0.0, "")), (p, similar, name))
    for lo, hi, name, p, similar in found:
        left = [w for w, t in zip(words[lo:hi], told[lo:hi]) if not t]
        if name not in sure and not (p >= 0.5 and similar >= CONFIRM) \
                and (len(left) == hi - lo or left and int(model.probabilities(left).argmax()) != ORDINARY):
            best[name] = max(best.get(name, (0.0, 0.0)), (p, similar))
    return sorted([(f, name, p, s) for f, (p, s, name) in sure.items()] + [("unknown", name, p, s) for name, (p, s) in best.items()],
                  key=lambda x: (x[1], x[0]))


def _segments(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paragraph, first word and end of each segment of the paragraphs [first, last), as ``classify`` cuts them."""
    count = np.maximum(1, -(-(last - first - SEGMENT + STRIDE) // STRIDE))
    own = np.repeat(np.arange(len(first)), count)
    lo = first[own] + STRIDE * (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count))
    return own, lo, np.minimum(lo + SEGMENT, last[own])


def _speaking(model: Classifier, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of paragraphs of hashed words, those with a segment that is not predicted as ordinary text."""
    two = pair_hashes(hashes)
    three = mix(two[:-1] * np.uint64(5) + hashes[2:])
    low = [(x & np.uint64((1 << BITS) - 1)).astype(np.int64) for x in (hashes, two, three)]
    para, start, end = _segments(first, last)
    found = []
    for k in range(0, len(para), SCORED):
        lo, hi = start[k:k + SCORED], end[k:k + SCORED]
        parts = []
        for n, grams in enumerate(low):
            size = np.maximum(0, hi - lo - n)
            own = np.repeat(np.arange(len(lo)), size)
            at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + lo[own]
            parts.append((own << BITS) | grams[at])
        key = np.sort(np.concatenate(parts))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        cut = np.searchsorted(key, np.arange(len(lo) + 1) << BITS)
        z = np.add.reduceat(model.weights[key & ((1 << BITS) - 1)], cut[:-1], axis=0) / np.sqrt(np.diff(cut))[:, None] + model.bias
        found.append(para[k:k + SCORED][z.argmax(axis=1) != ORDINARY])
    return np.unique(np.concatenate(found))


def _candidates(model: Classifier, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list[bytes], list[tuple[int, int]]]]:
    """(document, paragraph, words, lines) of every paragraph that is not all ordinary text."""
    low = LOWER[data]
    starts, ends, first = spans(low, at, LETTERS)
    if not len(starts):
        return
    lines = np.cumsum(data == 10)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    line = lines[starts]  # a number over the whole run of documents
    other = doc[1:] != doc[:-1]
    begin = np.flatnonzero(np.concatenate(([True], other | (line[1:] > line[:-1] + 1))))
    begin_line = np.flatnonzero(np.concatenate(([True], other | (line[1:] != line[:-1]))))
    end, end_line = np.append(begin[1:], len(starts)), np.append(begin_line[1:], len(starts))
    run = np.searchsorted(begin, begin_line, side="right") - 1
    several = np.bincount(run, minlength=len(begin))[run] > 1
    begin_line, end_line, run = begin_line[several], end_line[several], run[several]
    raw = low.tobytes()
    before = np.concatenate(([0], lines))[at[:-1]]
    scored = _speaking(model, word_hashes(low, starts, ends), np.concatenate([begin, begin_line]), np.concatenate([end, end_line]))
    for k in np.unique(np.concatenate([np.arange(len(begin)), run])[scored]).tolist():
        lo, hi = int(begin[k]), int(end[k])
        d, (a, b) = int(doc[lo]), np.searchsorted(run, [k, k + 1])
        yield (d, int(line[lo] - before[d]), [raw[x:y] for x, y in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())],
               list(zip((begin_line[a:b] - lo).tolist(), (end_line[a:b] - lo).tolist())))


def sample_lines(docs: DataFrame, text_col: str = "text", limit: int = SAMPLE_DOCS) -> list[str]:
    """Lines of at most ``limit`` documents, chosen by a hash of the text."""
    return [line for text in sample_texts(docs, text_col, limit, SAMPLE_CHARS) for line in text.split("\n")]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Classifier | None = None) -> DataFrame:
    """(doc_id, paragraph, family, predicted, probability, similarity) of every licence paragraph."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(sample_lines(docs, text_col)))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in chunks(at):
                found = [(d, n, *x) for d, n, words, lines in _candidates(shared.value, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                         for x in classify(shared.value, words, lines)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([lo + f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()),
                     pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.string()),
                     pa.array([f[4] for f in found], pa.float64()), pa.array([f[5] for f in found], pa.float64())],
                    names=["doc_id", "paragraph", "family", "predicted", "probability", "similarity"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, paragraph bigint, family string, predicted string, "
                                "probability double, similarity double")
