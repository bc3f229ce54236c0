"""Tokenizer, language model, classifiers, extraction, sharding, decontamination."""

import base64
import collections
import hashlib
import itertools
import math
import re
import time
from types import SimpleNamespace
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerline.llm import bpe, decontaminate, hilbert, html_blocks, licences, ordinal_quality, recurrent_lm
from ledgerline.llm.common import exact_word_hashes, exact_word_pairs

from .conftest import CLASHING, texts, words

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def some(x):
    return tuple((v is None, v) for v in x)


def encoder():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_public_library(awkward, nothing):
    enc, want = encoder(), []
    for i, t in texts():
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.token_digests(awkward, VOCABULARY, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=some) == sorted(want, key=some)
    whole = bpe.tokenize(awkward, VOCABULARY, public_tokenizers.PATTERN)
    assert set(CLASHING) <= set(whole.columns)
    own = awkward.select(F.col("doc_id").alias("i"), "text").where("i <> 7")
    for r in whole.select("doc_id", "n_tokens", "tokens", "decoded").join(own, F.col("i") == F.col("doc_id")).collect():
        assert r.decoded == (r.text or "") == enc.decode(r.tokens) and r.n_tokens == len(r.tokens)
    assert bpe.token_digests(nothing, VOCABULARY, public_tokenizers.PATTERN).collect() == []


def test_long_pieces_and_the_recursive_query_agree():
    coder, enc = bpe.Coder(bpe.read_vocabulary(VOCABULARY, public_tokenizers.PATTERN)), encoder()
    rng = np.random.default_rng(0)
    for _ in range(200):
        piece = "".join(rng.choice(list("abcdeéß漢"), rng.integers(2, 60)))
        raw = piece.encode()
        if raw not in coder.rank:
            assert coder._contract([raw])[0].tolist() == coder._contract_long(raw).tolist()
    text = "aaaa" * 400 + "\n" * 90 + "0" * 700 + "'s'll ünïcødé"
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == enc.encode_ordinary(text)


def test_many_long_pieces_and_a_worker_that_forgets(monkeypatch):
    """Runs without spaces are long pieces: several queries of bounded rows; a full memory is given up between batches."""
    coder, enc = bpe.Coder(bpe.read_vocabulary(VOCABULARY, public_tokenizers.PATTERN)), encoder()
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("漢字仮名交文章例abc"), rng.integers(1, 65))) for _ in range(400)] + ["", " ", "a"]
    for t, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 1)
    for t in texts[:5]:
        assert np.frombuffer(coder.encode([t])[0], "<u4").tolist() == enc.encode_ordinary(t)
        assert len(coder.known) == len(coder.number) == len(set(coder.split(t)))


def small_network():
    s = SimpleNamespace(order=np.arange(70), classes=3, head_count=np.arange(70, 0, -1.0), mass=np.ones(recurrent_lm.BINS),
                        left_out=np.ones(recurrent_lm.BINS))
    net, rng = recurrent_lm.Network(s, hidden=6), np.random.default_rng(0)
    for k, v in net.p.items():
        net.p[k] = (v + rng.normal(0, 0.1, v.shape)).astype(np.float64)
    net.p["wb"].reshape(-1)[70:] = -40
    return net, rng


def test_network_gradients_and_total_probability():
    net, rng = small_network()
    own, begins = rng.integers(0, 70 + recurrent_lm.BINS, (5, 4)), rng.random((5, 4)) < 0.2
    state = rng.normal(0, 0.5, (4, 6))
    g, _ = net.gradients(own, begins, np.ones((5, 4), bool), state)

    def loss():
        before, _, _ = net.window(own, begins, state, False)
        return -net.output(before.astype(np.float64), own)[0].mean()

    for k, v in net.p.items():
        flat = v.reshape(-1)
        at = int(np.abs(g[k].reshape(-1)).argmax())
        old, side = flat[at], []
        for d in (1e-3, -1e-3):
            flat[at] = old + d
            side.append(loss())
        flat[at] = old
        assert g[k].reshape(-1)[at] == pytest.approx((side[0] - side[1]) / 2e-3, rel=1e-3), k
    one = rng.normal(0, 1, (1, 1, 6))
    assert sum(math.exp(net.output(one, np.array([[y]]))[0][0, 0]) for y in range(70 + recurrent_lm.BINS)) == pytest.approx(1)


def test_state_is_carried_through_whole_documents():
    net, rng = small_network()
    sizes = np.array([1, 130, 7, 64, 33])
    own = rng.integers(0, 70 + recurrent_lm.BINS, int(sizes.sum()))
    got, at = recurrent_lm.score_block(net, own, sizes), 0
    for k, n in enumerate(sizes.tolist()):
        before, _, _ = net.window(own[at:at + n, None], np.arange(n)[:, None] == 0, np.zeros((1, 6)), False)
        assert got[k] == pytest.approx(net.output(before, own[at:at + n, None])[0].sum() / math.log(10), rel=1e-5)
        at += n


def test_scores_count_like_brute_force(awkward, nothing):
    rows = [(i, [w.lower() for w in WORD.findall((t or "").encode())] + [None]) for i, t in texts()]
    held = lambda i: crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5))
                   for i, ws in rows), key=some)
    got = recurrent_lm.score(awkward).collect()
    assert sorted(((*r[:5], round(r.base_score, 5)) for r in got), key=some) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert recurrent_lm.score(nothing).collect() == []


def test_every_training_document_is_learnt_from(spark, monkeypatch):
    docs, seen, mean = spark.createDataFrame([(k, words(k, 20)) for k in range(80)], "doc_id bigint, text string"), [], recurrent_lm._averaged
    monkeypatch.setattr(recurrent_lm, "_averaged", lambda copies: (seen.append(copies.agg(F.sum("seen")).first()[0]), mean(copies))[1])
    assert recurrent_lm.score(docs).first().train_tokens == seen[0] == sum(21 for k in range(80) if recurrent_lm.fold(k) != 1)


def test_every_frequent_word_is_a_head_word(spark, monkeypatch):
    text, heads, plain = " ".join(f"w{k}" for k in range(1500)), [], recurrent_lm.Symbols.__init__
    monkeypatch.setattr(recurrent_lm.Symbols, "__init__", lambda self, own, *a: (heads.append(own), plain(self, own, *a))[1])
    recurrent_lm.score(spark.createDataFrame([(k, text) for k in range(4)], "doc_id bigint, text string"))
    assert len(heads[0]) == 1501


def test_blocks_with_a_long_document_share_wide_lanes():
    sizes = np.concatenate(([4000], np.full(300, 40)))
    blocks, steps = [(np.zeros(int(sizes.sum()), np.uint16), sizes, k) for k in range(9)], []
    for own, held, names, n in recurrent_lm.grouped(iter(blocks), recurrent_lm.growing()):
        assert len(own) == held.sum() and len(names) == n
        windows = list(recurrent_lm._windows(own, np.cumsum(held) - held, held, n * recurrent_lm.TRAIN_LANES))
        assert sum(int(live.sum()) for *_, live in windows) == len(own)
        steps += [(names, len(windows))]
    assert steps == [([0], 125), ([1, 2], 125), ([3, 4, 5, 6], 125), ([7, 8], 125)]  # 9 x 125 one by one


def test_no_class_above_the_counts_of_the_corpus():
    types, tokens = np.zeros(recurrent_lm.BINS, np.int64), np.zeros(recurrent_lm.BINS, np.int64)
    types[[0, 1, 3, 12]], tokens[[1, 3, 12]] = (4, 10, 5, 1), (10, 25, 3000)
    net = recurrent_lm.Network(recurrent_lm.Symbols([(0, 0, 3000)], types, tokens))
    assert net.p["k"].shape[1] == 1 + 4  # the end's class, unseen words and counts up to 7


def test_state_and_softmax_equal_the_plain_formulas():
    net, rng = small_network()
    own, begins, state = rng.integers(0, 70, (6, 5)), rng.random((6, 5)) < 0.3, rng.normal(0, 0.3, (5, 6))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for scale in (1, 300):  # with large weights the row's own shift is needed
        net.p["k"] *= scale
        got, after, _ = net.window(own, begins, state, False)
        found, s = net.output(got, own)[0], state
        for t in range(6):
            s = np.where(begins[t][:, None], 0, s)
            assert np.allclose(got[t], s)
            for lane, y in enumerate(own[t].tolist()):
                z, w = s[lane] @ net.p["k"] + net.p["kb"], s[lane] @ net.p["w"][y // 32] + net.p["wb"][y // 32]
                assert found[t, lane] == pytest.approx(z[y // 32] - np.logaddexp.reduce(z) + w[y % 32] - np.logaddexp.reduce(w))
            add = net.p["e"][own[t]] + net.p["c"]
            z, r = np.split(sigmoid(add[:, :12] + s @ net.p["u"][:, :12]), 2, axis=1)
            s = s + z * (np.tanh(add[:, 12:] + (r * s) @ net.p["u"][:, 12:]) - s)
        assert np.allclose(after, s)


def test_words_that_share_half_a_fingerprint_are_told_apart():
    pairs = np.array([(5, 2), (5, 1), (9, 1), (5, 2), (0, 0)], recurrent_lm._PAIR)
    words, back = recurrent_lm._vocabulary(pairs)
    assert words.tolist() == [(0, 0), (5, 1), (5, 2), (9, 1)] and back.tolist() == [2, 1, 3, 2, 0]
    data, starts, ends = np.frombuffer(b"one two " + b"x" * 90, np.uint8), np.array([0, 4, 8]), np.array([3, 7, 98])
    for seed, own in enumerate(exact_word_pairs(data, starts, ends)):
        assert own.tolist() == exact_word_hashes(data, starts, ends, seed).tolist()


def test_held_out_text_is_scored_better_than_by_counts(spark):
    got = recurrent_lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(
        F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_hilbert_shards_prune_every_dimension(spark, tmp_path):
    """By the least and greatest value of each shard, a filter on one value of any dimension skips half of the shards or more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        "doc_id", "text", "lang", "source", (F.col("doc_id") * 0.37 % 1).alias("share"))
    for dimensions in (("lang", "source", "size"), ("lang", "share", "size")):
        path = str(tmp_path / dimensions[1])
        hilbert.write_shards(docs, path, dimensions=dimensions)
        own = spark.read.parquet(path).withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))) + 1).toPandas()
        assert sorted(own.shard.unique()) == list(range(16)) and len(own) == docs.count()
        for d in dimensions:
            span = own.dropna(subset=[d]).groupby("shard")[d].agg(["min", "max"])
            values = own[d].dropna().drop_duplicates()
            read = [int(((span["min"] <= v) & (v <= span["max"])).sum()) for v in values]
            assert np.mean(read) <= 9, (dimensions, d, np.mean(read))


def test_hilbert_curve_steps_to_a_neighbour():
    for d, b in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(2 ** b), repeat=d)))
        place = hilbert.hilbert_index(cells, b)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_obey_their_law(awkward, nothing, law):
    got = hilbert.shard_report(awkward, law=law, shards=4).collect()
    want = [(i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in texts()]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=some) == sorted(want, key=some)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 4
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert hilbert.shard_report(nothing, law=law).collect() == []


def test_strings_with_a_common_prefix_are_told_apart(spark):
    rows = [(k, "x" * 9, f"https://host{k % 8}.example/") for k in range(160)]
    docs = spark.createDataFrame(rows + [(200, "x", None)], "doc_id bigint, text string, source string")
    got = hilbert.shard_report(docs, dimensions=["source"], shards=8).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.curve].add(None if r.doc_id == 200 else r.doc_id % 8)
    assert sorted(map(list, by.values()), key=str) == sorted([[None], *[[h] for h in range(8)]], key=str)
    order = [(dict((i, h) for i, _, h in rows).get(r.doc_id) or "") for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id != 200]
    assert order == sorted(order)


def test_shard_files_hold_whole_rows_and_prune(spark, awkward, tmp_path):
    path = str(tmp_path / "shards")
    hilbert.write_shards(awkward, path, shards=4)
    back = spark.read.parquet(path)
    assert back.drop("shard").columns == awkward.columns and back.count() == awkward.count()
    assert back.drop("shard").exceptAll(awkward).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T {k}</title><style>p{{x}}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">menu one</a></li><li>menu two</li></ul></nav><div class="ad">Buy now {k}</div><article><h1>Head &amp; {k}</h1>
<p>First  para{k} has <b>bold</b>text and more words to read here.<br>after break<p>Second paragraph {k} &lt;tag&gt; is also long enough to read.</p></article>
<div class="comments"><p>Nice one {k}</p></div><form><label>Mail</label></form><footer>&copy; foot {k}</footer></body></html>"""


def test_pages_give_their_article(spark):
    rows = [(k, f"http://x/{k}", PAGE.format(k=k)) for k in range(40)] + [(None, None, None), (90, "u", ""), (91, "u", "<p"), (92, "u", "</div></b>"),
                                                                          (93, "u", "<nav>" * 300 + "x" + "<article><p>" * 50)]
    pages = spark.createDataFrame([(*r, "z", "y") for r in rows], "page_id bigint, url string, html string, text string, h string")
    got = {r.page_id: r for r in html_blocks.main_text(pages).collect()}
    for k in range(40):
        want = f"Head & {k} First para{k} has boldtext and more words to read here. after break Second paragraph {k} <tag> is also long enough to read."
        assert (got[k].text, got[k].n_chars) == (want, len(want))
    assert got[None].text == "" and got[90].n_chars == 0 and got[92].text == ""
    assert html_blocks.main_text(pages.limit(0)).collect() == []


def test_deep_end_tags_and_all_class_names_are_read():
    page = "<body><nav>" + "<i>x" * 100 + "</nav><article><p>the text</p></article><div class='a b c d e f g h comments'>nice</div></body>"
    paths = {text: path for text, path, _ in html_blocks.read_blocks(page)}
    assert "nav" not in paths["the text"] and "article" in paths["the text"]
    assert "nav" not in paths["nice"] and ".comments" in paths["nice"]


def test_stray_tags_cost_linear_time_and_paths_are_those_of_the_open_elements():
    page = "<body><nav class=menu>a</nav><div class='menu x'><p class=x>b</p>c<p>d</p></div>" + "<i>x<br>" * 16_000
    began = time.process_time()
    blocks = html_blocks.read_blocks(page)
    assert time.process_time() - began < 2 and len(blocks) == 16_004
    paths = {text: path for text, path, _ in blocks}
    assert paths["a"] == ("body", "nav", ".menu", "menu") and paths["d"] == ("body", "div", ".menu", "menu", ".x", "x", "p")
    assert paths["b"] == paths["d"] and paths["c"] == paths["d"][:-1] and paths["x"] == ("body", "i")


def test_labeller_reads_other_layouts(spark):
    htmls = [PAGE.format(k=k) for k in range(60)]
    model, rng, wrong, total = html_blocks.train(htmls), np.random.default_rng(77), 0, 0
    for html in htmls[:40]:
        blocks = html_blocks.read_blocks(html)
        own, labels = html_blocks.relaid(blocks, [html_blocks.teacher(p, t) for t, p, _ in blocks], rng)
        wrong += int((html_blocks.label_pages(model, [own])[0] != np.array(labels, bool)).sum())
        total += len(own)
    assert wrong <= 0.03 * total


def test_licences_are_found_and_others_left(spark, awkward, nothing):
    planted = [("mit", "Released under the MIT License."), ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
               ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."), ("apache-2.0", "licensed under the apache license version 2.0"),
               ("unknown", "Released under the Quux Frob License, Version 7.")]
    rows = [(k, words(k, 30) + "\n\n" + planted[k % 5][1] + "\n" + words(k + 100, 20)) for k in range(50)] + [(200 + k, words(k + 500, 90)) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.paragraph): r.family for r in licences.scan(docs).collect()}
    assert got == {(k, 2): planted[k % 5][0] for k in range(50)}
    assert licences.scan(awkward).count() == 0 and licences.scan(nothing).collect() == []


def test_every_paragraph_is_classified(spark):
    prose = "the film was released under a bridge and distributed under the stars all rights of way reserved for walkers"
    planted = [("mit", "SPDX-License-Identifier: MIT"), ("gpl-3.0", "License: GPL-3.0-or-later"), ("unknown", "Released under WTFPL")]
    docs = spark.createDataFrame([(k, prose + " " + words(k, 12) + "\n\n" + planted[k % 3][1] + "\n\n" + words(k + 100, 20)) for k in range(60)],
                                 "doc_id bigint, text string")
    got = {(r.doc_id, r.paragraph): r.family for r in licences.scan(docs).collect()}
    assert got == {(k, 2): planted[k % 3][0] for k in range(60)}


def test_wrapped_notices_are_found(spark):
    planted = [("gpl-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
                           "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
               ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
                              "You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0"),
               ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
               ("all-rights-reserved", "All rights reserved.")]
    docs = spark.createDataFrame([(k, words(k, 30) + "\n\n" + planted[k % 4][1] + "\n\n" + words(k + 100, 20)) for k in range(60)],
                                 "doc_id bigint, text string")
    got = {(r.doc_id, r.paragraph, r.family) for r in licences.scan(docs).collect()}
    assert {x for x in got if x[2] != "unknown"} == {(k, 2, planted[k % 4][0]) for k in range(60)}
    assert {x[1] for x in got} == {2}


def test_grades_are_ordered_and_held_out_rows_agree(spark, awkward, nothing, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learn = labels.where("doc_id % 4 <> 0")
    model = ordinal_quality.train(docs, learn, ordinal_quality.graded(learn), top=2)
    assert model.thresholds[0] < model.thresholds[1]
    got = ordinal_quality.score(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    grade = got.quality + 1 - got.toxic
    assert got[grade == 2].kept.mean() > 0.97 and got[(got.quality == 0)].kept.mean() < 0.1
    assert got[grade == 2].expected_grade.mean() > got[grade == 1].expected_grade.mean()
    assert (got.p_top <= got.expected_grade + 1e-9).all() and got.expected_grade.between(0, 2).all()
    assert ordinal_quality.score(awkward, model).count() == len(texts())
    many = docs.withColumn("doc_id", F.lit(1).cast("bigint"))  # one rated id in every row: the sample's bound holds
    monkeypatch.setattr(ordinal_quality, "fit_with_cut", lambda rows, grades, top: len(rows))
    one = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert ordinal_quality.train(many, one, ordinal_quality.graded(one), top=2, limit=20) == 20
    monkeypatch.undo()
    nobody = ordinal_quality.train(awkward, labels.limit(0), F.lit(1), top=2)
    assert {round(r.expected_grade, 6) for r in ordinal_quality.score(awkward, nobody).collect()} == {1.0}
    assert ordinal_quality.score(nothing, model).collect() == []


ITEMS = pd.DataFrame({"item_id": [1, 2, 3, 4, 5, 6],
                      "text": [words(301, 30) + ". The answer is " + words(302, 8) + ".", words(303, 55) + ".", words(304, 20) + "? " + words(305, 5),
                               None, "", words(303, 55) + "."]})


def test_planted_items_are_found(spark, nothing):
    items = spark.createDataFrame([(int(i), t) for i, t in zip(ITEMS.item_id, ITEMS.text)], "item_id bigint, text string")
    rows, want = [], set()
    for k in range(60):
        text = words(1000 + k, 20 + 13 * k)
        if k % 3 == 0:
            for i in ([1], [2, 6], [3])[k // 3 % 3]:
                want.add((k, i))
            text = text[:len(text) // 2] + " " + ITEMS.text[[0, 1, 2][k // 3 % 3]].upper().replace(" ", "\n", 3) + " " + text[len(text) // 2:]
        rows.append((k, text, "z"))
    docs = spark.createDataFrame(rows + [(None, None, None), (70, "", None), (71, ITEMS.text[0][:60], None)], "doc_id bigint, text string, item_id string")
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in docs.collect()} - {d for d, _ in want}
    assert decontaminate.contaminated(nothing, items).collect() == [] and decontaminate.contaminated(docs, items.limit(0)).collect() == []
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_parts_of_the_index_find_the_same(spark):
    items = spark.createDataFrame([(k, words(k, 25)) for k in range(40)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, words(k + 5000, 60) + " " + words(k % 80, 25)) for k in range(160)], "doc_id bigint, text string")
    parts = list(decontaminate.index_parts(items, part_bytes=1000))
    assert len(parts) > 3 and sum(len(p.items) for p in parts) == 40
    whole = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert whole == {(k, k % 80) for k in range(160) if k % 80 < 40}


def test_short_and_long_items_do_not_catch_clean_documents(spark, monkeypatch):
    """A one-word item is only found in a document that is that word; beside an item of 5,000
    words, another one's words must still stand together; long texts are taken in slices."""
    monkeypatch.setattr(decontaminate, "BOUNDS", 64)
    question, answer = [f"q{k}" for k in range(8)], "a1"
    items = spark.createDataFrame([(1, "yes"), (2, " ".join(question) + ". " + answer + "."), (3, words(77, 5000)), (4, "no way")], "item_id bigint, text string")
    scattered = " ".join(question[:5]) + " " + words(78, 2000) + " " + answer + " " + words(79, 100)
    together = words(80, 300) + " " + " ".join(question) + " " + answer + " " + words(81, 300)
    docs = spark.createDataFrame([(1, "yes and " + words(82, 40)), (2, "Yes!"), (3, scattered), (4, together), (5, words(83, 900) + " " + words(77, 5000)),
                                  (6, "no way"), (7, "no, no way"), (8, words(84, 60) + " yes")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(2, 1), (4, 2), (5, 3), (6, 4)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {1, 3, 7, 8}


def test_wand_retrieves_every_item_above_the_threshold():
    rows = [(k, words(k % 30, 12) + " " + words(k, 15)) for k in range(90)]
    tf = [collections.Counter(decontaminate.terms_of(t)) for _, t in rows]
    df = collections.Counter(t for c in tf for t in c)
    size = [sum(c.values()) for c in tf]
    index = decontaminate.build_index(rows, df, len(rows), sum(size) / len(size), max(size))
    rng = np.random.default_rng(4)
    for _ in range(300):
        _, question, answer = index.items[rng.integers(len(index.items))]
        query = [w for w in question + answer if rng.random() < rng.uniform(0.2, 1)] + index.items[rng.integers(len(index.items))][1][:6]
        terms = np.unique(np.searchsorted(index.hashes, decontaminate.hash_terms(sorted(set(query)))))
        score = np.zeros(len(index.items))
        for t in terms:
            score[index.postings[t][0]] += index.postings[t][1]
        want = set(np.flatnonzero(score >= decontaminate.THRESHOLD - 1e-9).tolist())
        assert {i for i, _ in decontaminate.block_max_wand(index, terms)} == want
