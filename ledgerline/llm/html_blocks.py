"""Main-text extraction with a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level
tags, each with the path of open tags (names, classes, ids, and the words they
are made of).  A bidirectional LSTM in numpy reads, block after block, the
hashed path, the hashed words and a few measures of the text, and labels every
block as main text or not with the whole page as context.

Training: a sample of at most ``SAMPLE_PAGES`` pages, labelled by landmark tags
(``teacher``), plus copies of them in other layouts: the same blocks under other
containers, with menus, adverts, notices, forms and comments put between.  The
copies make the labeller read the path and the surroundings, not one layout.

Defined results: null or empty html gives an empty text; script, style and
other raw content is never a block; unclosed or stray tags are tolerated;
repeated pages get equal texts; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, sample_texts, spans, word_hashes

SAMPLE_PAGES = 240
SAMPLE_CHARS = 60_000  #: longer pages are not trained on (all are labelled)
COPIES = 3
EPOCHS = 8
BATCH_STEPS = 6_144  #: steps of all sequences that run side by side
HIDDEN = 16
PATH_SIZE, WORD_SIZE, MEASURES = 256, 64, 5
SEED = 11

# HTML elements.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
             "strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "template", "noscript", "svg", "iframe", "object"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
# Words of tag names, classes and ids that usually hold or do not hold the main text.
MAIN_WORDS = set("article main content post entry story body text page".split())
OTHER_WORDS = set("nav menu header footer aside sidebar ad ads advert advertisement sponsor promo banner cookie notice consent popup "
                  "modal form search login newsletter subscribe comment comments reply discussion share social related "
                  "breadcrumb breadcrumbs pagination pager widget toolbar copyright legal head title button label select".split())
# Layouts for the copies (paths of tag.class).
MAIN_PATHS = ["body main", "body article", "body main article", "body div.content", "body div.main-content", "body div.post div.entry-content",
              "body section.article-body", "body div.wrapper div.story", "body div.page div.text", "body div", "body table tr td.content",
              "body div.article", "body main section", "body div.container div.row div.post-content", "body article div.body"]
OTHER_PATHS = ["body nav ul li a", "body header", "body header div.banner", "body header nav a", "body footer", "body footer p", "body footer div.legal",
               "body aside", "body aside p", "body aside ul li a", "body div.sidebar p", "body div.sidebar ul li a", "body div.ad", "body div.ads p",
               "body div.advert p", "body div.advertisement", "body div.sponsored p", "body div.promo p", "body div.banner", "body div.cookie-notice p",
               "body div.notice", "body div.notice p", "body div.alert p", "body div.consent", "body div.popup p", "body form", "body form label", "body form p",
               "body form button", "body div.newsletter form p", "body div.search form", "body div.comments div.comment p", "body section.comments p",
               "body section.comments h2", "body div.comments h3", "body ol.comment-list li p", "body div.reply p", "body div.share a",
               "body div.related ul li a", "body div.related h3", "body div.breadcrumbs a", "body ul.menu li a", "body div.menu a", "body div.pagination a",
               "body div.widget p", "head title", "body div.footer p", "body div.header p", "body div.nav a", "body div.toolbar"]
INSIDE_PATHS = ["aside", "aside p", "div.ad", "div.advert p", "div.share a", "div.related li a", "div.comments p", "section.comments div.comment p",
                "form p", "form label", "footer", "footer p", "nav a", "div.newsletter p", "div.notice p", "header nav a", "div.promo"]


def _words_of(name: str) -> list[str]:
    parts = [p.lower() for p in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", name) if p]
    return parts


class _Reader(HTMLParser):
    """Collects (text, path, characters inside links) of every leaf block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, tuple, int]] = []
        self.stack: list[tuple[str, tuple]] = []
        self.open: Counter[str] = Counter()  # elements on the stack by tag
        self.tokens: Counter[str] = Counter()  # tokens of the open elements, outermost first
        self.path: tuple | None = ()  # of these; None after a change
        self.text: list[str] = []
        self.linked = self.raw = self.links = 0

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                if self.path is None:
                    self.path = tuple(self.tokens)
                self.blocks.append((text, self.path, self.linked))
            self.text, self.linked = [], 0

    def _pop(self) -> None:
        tag, tokens = self.stack.pop()
        for t in tokens:
            self.tokens[t] -= 1
            if not self.tokens[t]:
                del self.tokens[t]
                self.path = None
        self.open[tag] -= 1
        self.raw -= tag in RAW
        self.links -= tag == "a"

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        if tag in CLOSES and self.stack and self.stack[-1][0] in CLOSES[tag]:
            self._pop()
        tokens = [tag]
        for key, value in attrs:
            if value and key in ("class", "id", "role"):
                for name in value.split():
                    tokens += [f".{name.lower()}", *_words_of(name)]
        self.stack.append((tag, tuple(tokens)))
        for t in tokens:
            if t not in self.tokens:
                self.path = None
            self.tokens[t] += 1
        self.open[tag] += 1
        self.raw += tag in RAW
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._flush()
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self.raw:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def read_blocks(html: str | None) -> list[tuple[str, tuple, int]]:
    """Leaf blocks of a page, in page order."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._flush()
    return reader.blocks


def teacher(path: tuple, text: str) -> int:
    """1 main text, 0 not, by landmark words on the path."""
    own = set(path)
    if own & OTHER_WORDS or "body" not in own and "article" not in own:
        return 0
    return int(bool((own - {"body", "page", "text"}) & MAIN_WORDS) or ("p" in own and len(text.split()) >= 10))


# --- features ----------------------------------------------------------------------

_SLOTS: dict[str, tuple[int, int]] = {}


def _slots(token: str) -> tuple[int, int]:
    if token not in _SLOTS:
        if len(_SLOTS) > 100_000:
            _SLOTS.clear()
        h = crc32(token.encode())
        _SLOTS[token] = (h % PATH_SIZE, (h >> 12) % PATH_SIZE)
    return _SLOTS[token]


def text_features(blocks: list[tuple[str, tuple, int]], place: np.ndarray) -> np.ndarray:
    """Hashed words and measures of each block; ``place``: how far down its page it is."""
    raw = [text.encode("utf-8", "replace") for text, _, _ in blocks]
    data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    starts, ends, first = spans(data, at)
    hashes = word_hashes(data, starts, ends)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(blocks)), count)
    bag = np.bincount(owner * WORD_SIZE + (hashes % np.uint64(WORD_SIZE)).astype(np.int64), minlength=len(blocks) * WORD_SIZE)
    linked = np.array([b[2] / max(1, len(b[0])) for b in blocks])
    stop = np.array([b[0][-1:] in ".!?" for b in blocks])
    return np.concatenate([0.3 * bag.reshape(-1, WORD_SIZE) / np.sqrt(np.maximum(1, count))[:, None],
                           np.stack([np.log1p(count) / 5, linked, stop, place, count < 5], axis=1)], axis=1).astype(np.float32)


def path_features(paths: list[tuple]) -> np.ndarray:
    out = np.zeros((len(paths), PATH_SIZE), np.float32)
    for k, path in enumerate(paths):
        out[k, [s for t in path for s in _slots(t)]] = 1
    return out


def features(blocks: list[tuple[str, tuple, int]]) -> np.ndarray:
    """One row for each block of a page."""
    return np.concatenate([path_features([p for _, p, _ in blocks]), text_features(blocks, np.arange(len(blocks)) / len(blocks))], axis=1)


# --- the labeller ---------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over a batch of sequences (time, batch, feature)."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        rng, size = np.random.default_rng(seed), PATH_SIZE + WORD_SIZE + MEASURES
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.08, (size, 4 * hidden)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.15, (2 * hidden, 1)).astype(np.float32)
        self.p["ox"] = np.zeros((size, 1), np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What the input adds to both directions' gates and to the output."""
        p = self.p
        flat = x.reshape(-1, x.shape[-1]) @ np.concatenate([p["xf"], p["xb"], p["ox"]], axis=1)
        return flat.reshape(*x.shape[:-1], -1) + np.concatenate([p["cf"], p["cb"], p["ob"]])

    def _run(self, z_in: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        n, batch, h = len(z_in), z_in.shape[1], self.h
        z_in = z_in[:, :, :4 * h] if d == "f" else z_in[:, :, 4 * h:8 * h]
        state, cell, w = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32), self.p[f"h{d}"]
        out, tape = np.zeros((n, batch, h), np.float32), []
        for t in (range(n) if d == "f" else range(n - 1, -1, -1)):
            z = z_in[t] + state @ w
            gate = _sigmoid(z[:, :3 * h])
            i, f, o, g = gate[:, :h], gate[:, h:2 * h], gate[:, 2 * h:], np.tanh(z[:, 3 * h:])
            m = mask[t][:, None]
            new = f * cell + i * g
            if keep:
                tape.append((t, i, f, o, g, cell, new, state))
            cell = np.where(m, new, cell)
            state = np.where(m, o * np.tanh(new), state)
            out[t] = state
        return out, tape

    def score(self, z_in: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-odds of main text, (time, batch), from ``inputs``."""
        both = np.concatenate([self._run(z_in, mask, d, False)[0] for d in "fb"], axis=2)
        return (both @ self.p["o"])[..., 0] + z_in[..., -1]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h = self.h
        z_in = self.inputs(x)
        runs = {d: self._run(z_in, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        odds = (both @ self.p["o"])[..., 0] + z_in[..., -1]
        delta = ((_sigmoid(odds) - y) * mask / max(1, mask.sum()))[..., None].astype(np.float32)
        flat = x.reshape(-1, x.shape[2])
        g = {"o": both.reshape(-1, 2 * h).T @ delta.reshape(-1, 1), "ox": flat.T @ delta.reshape(-1, 1), "ob": delta.sum((0, 1))}
        d_both = delta @ self.p["o"].T
        for k, d in enumerate("fb"):
            w, d_z = self.p[f"h{d}"], np.zeros((len(x), x.shape[1], 4 * h), np.float32)
            d_state, d_cell, g_w = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32), np.zeros_like(w)
            for t, i, f, o, gg, cell, new, state in reversed(runs[d][1]):
                m = mask[t][:, None]
                ds = d_state + d_both[t][:, k * h:(k + 1) * h]
                squash = np.tanh(new)
                dc = (d_cell + ds * o * (1 - squash ** 2)) * m
                z = np.concatenate([dc * gg * i * (1 - i), dc * cell * f * (1 - f), ds * m * squash * o * (1 - o), dc * i * (1 - gg ** 2)], axis=1)
                d_z[t] = z
                g_w += state.T @ z
                d_state = np.where(m, z @ w.T, ds)
                d_cell = np.where(m, dc * f, d_cell)
            g[f"h{d}"], g[f"x{d}"], g[f"c{d}"] = g_w, flat.T @ d_z.reshape(-1, 4 * h), d_z.sum((0, 1))
        return g


def _batches(sequences: list[np.ndarray], size: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sequences of like length side by side, at most ``size`` of them and, where there
    are several, at most ``BATCH_STEPS`` steps: their numbers, features and mask."""
    order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < size and (hi - lo + 1) * len(sequences[order[hi]]) <= BATCH_STEPS:
            hi += 1
        own, lo = order[lo:hi], hi
        n = max(len(sequences[k]) for k in own)
        if not n:
            continue
        x = np.zeros((n, len(own), sequences[own[0]].shape[1]), np.float32)
        mask = np.zeros((n, len(own)), bool)
        for b, k in enumerate(own):
            x[:len(sequences[k]), b], mask[:len(sequences[k]), b] = sequences[k], True
        yield own, x, mask


def _path(layout: str) -> tuple:
    tokens = ["html"]
    for step in layout.split():
        tag, _, name = step.partition(".")
        tokens += [tag, *([f".{name}", *_words_of(name)] if name else [])]
    return tuple(dict.fromkeys(tokens))


def relaid(blocks: list[tuple[str, tuple, int]], labels: list[int], rng: np.random.Generator) -> tuple[list, list[int]]:
    """The page's blocks in another layout, with other blocks put between."""
    main, out, found = _path(MAIN_PATHS[rng.integers(len(MAIN_PATHS))]), [], []
    inside = [k for k, y in enumerate(labels) if y]
    words = " ".join(t for t, _, _ in blocks).split() or ["a"]

    def other(paths: list[str], base: tuple) -> None:
        start, n = int(rng.integers(len(words))), int(rng.choice([2, 5, 12, 30, 60]))
        path = tuple(dict.fromkeys(base + _path(paths[rng.integers(len(paths))])))
        text = " ".join(words[start:start + n])
        out.append((text, path, len(text) * ("a" in path)))
        found.append(0)

    for _ in range(int(rng.integers(2, 7))):
        other(OTHER_PATHS, ())
    for k in inside:
        text, path, linked = blocks[k]
        leaf = next((t for t in reversed(path) if t in ("p", "li", "td", "blockquote", "pre", "h1", "h2", "h3")), "p")
        if rng.random() < 0.08:
            other(INSIDE_PATHS, main)
        out.append((text, tuple(dict.fromkeys(main + (leaf,))), linked))
        found.append(1)
    if rng.random() < 0.3:
        for _ in range(int(rng.integers(1, 4))):
            other(INSIDE_PATHS, main)
    for _ in range(int(rng.integers(1, 7))):
        other(OTHER_PATHS, ())
    return out, found


def train(htmls: list[str], seed: int = SEED) -> Labeller:
    """A labeller trained on sample pages and their copies in other layouts (Adam)."""
    rng, x, y = np.random.default_rng(seed), [], []
    for html in htmls:
        blocks = read_blocks(html)
        if not blocks:
            continue
        labels = [teacher(path, text) for text, path, _ in blocks]
        for own, marks in [(blocks, labels), *[relaid(blocks, labels, rng) for _ in range(COPIES)]]:
            x.append(features(own))
            y.append(np.array(marks, np.float32))
    model = Labeller(seed)
    first, second, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for _ in range(EPOCHS):
        groups = list(_batches(x, 48))
        for k in rng.permutation(len(groups)):
            own, xs, mask = groups[k]
            ys = np.zeros(mask.shape, np.float32)
            for b, s in enumerate(own):
                ys[:len(y[s]), b] = y[s]
            step += 1
            for name, g in model.gradients(xs, mask, ys).items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.p[name] -= (0.01 * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def label_pages(model: Labeller, pages: list[list[tuple[str, tuple, int]]]) -> list[np.ndarray]:
    """For each page, which of its blocks are main text.

    Blocks share few different paths, so each path meets the weights once."""
    out = [np.zeros(len(p), bool) for p in pages]
    blocks = [b for p in pages for b in p]
    if not blocks:
        return out
    size = np.array([len(p) for p in pages])
    place = (np.arange(len(blocks)) - np.repeat(np.cumsum(size) - size, size)) / np.repeat(size, size)
    paths: dict[tuple, int] = {}
    which = np.array([paths.setdefault(p, len(paths)) for _, p, _ in blocks])
    p = model.p
    weights = np.concatenate([p["xf"], p["xb"], p["ox"]], axis=1)
    z = (path_features(list(paths)) @ weights[:PATH_SIZE])[which] + text_features(blocks, place) @ weights[PATH_SIZE:] \
        + np.concatenate([p["cf"], p["cb"], p["ob"]])
    for own, z_in, mask in _batches(np.split(z, np.cumsum(size)[:-1]), 64):
        odds = model.score(z_in, mask)
        for b, k in enumerate(own):
            out[k] = odds[:size[k], b] > 0
    return out


def sample_pages(pages: DataFrame, html_col: str = "html", limit: int = SAMPLE_PAGES) -> list[str]:
    """At most ``limit`` pages, chosen by a hash of their html."""
    return sample_texts(pages, html_col, limit, SAMPLE_CHARS)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model or train(sample_pages(pages, html_col)))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                own = batch.slice(lo, 128)
                read = [read_blocks(html) for html in own.column(2).to_pylist()]
                texts = [" ".join(b[0] for b, y in zip(blocks, keep.tolist()) if y)
                         for blocks, keep in zip(read, label_pages(shared.value, read))]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")
