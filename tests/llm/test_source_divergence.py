"""Source divergence audit against its SQL and against brute force."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from ledgerline.llm import source_divergence as S

from ..conftest import SF_SMALL
from .conftest import SCHEMA, texts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs=3, top=200):
    """Rows of both parts for documents (lang, source, text)."""
    docs = [(a or "", b or "", TERM.findall(low(t or ""))) for a, b, t in rows]
    in_docs, count = collections.Counter(), collections.Counter()
    for lang, source, terms in docs:
        in_docs.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (g, t), n in in_docs.items() if g == lang and n >= min_docs)
        sources = sorted({d[1] for d in docs if d[0] == lang})
        total = {s: sum(count[lang, s, t] for t in kept) + len(kept) for s in sources}
        all_n = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        whole = sum(all_n.values()) + len(kept)
        p = {(s, t): 1 + 10 ** 9 * (count[lang, s, t] + 1) // total[s] for s in sources for t in kept}
        q = {t: 1 + 10 ** 9 * (all_n[t] + 1) // whole for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(sum(f(p[s, t], p[o, t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s, t], q[t]), t) for t in kept if count[lang, s, t] and p[s, t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(frame):
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in frame.collect())


def test_awkward(spark, awkward, nothing):
    given = [(r.lang, r.source, r.text) for r in awkward.collect()]
    assert rows_of(S.audit(awkward)) == brute(given)
    assert rows_of(S.audit(nothing)) == []


def test_skewed_source_and_small_limits(spark, monkeypatch):
    """One source holds most rows, a language has no kept term, bands merge twice, tasks send often."""
    rng = random.Random(4)
    vocabulary = [f"{a}{b}é"[:rng.randrange(2, 4)] for a in "abcdefghijklmno" for b in "ABCDEFGHIJ"] + ["汉字", "Ünï"]
    rows = [(rng.choice(["en", "de", None]), "hot" if k % 3 else f"s{k % 7}", " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))))
            for k in range(240)] + [("xx", "a", "once"), ("xx", "b", "twice twice twice"), ("yy", "only", "a b c")] * 1
    monkeypatch.setattr(S, "HELD", 50)
    monkeypatch.setattr(S, "CELLS", 256)
    monkeypatch.setattr(S, "FAN_IN", 3)
    frame = spark.createDataFrame([(k, t, a, b, None, *["x"] * (len(SCHEMA) - 5)) for k, (a, b, t) in enumerate(rows)], SCHEMA).repartition(5)
    assert rows_of(S.audit(frame, top=7)) == brute(rows, top=7)


def test_skyband_counts_dominators():
    rng = np.random.default_rng(2)
    for k in (1, 3, 20):
        count, lang = rng.integers(1, 30, 600), rng.integers(1, 40, 600)
        want = [i for i in range(600) if ((count[:i] >= count[i]) & (lang[:i] <= lang[i])).sum() < k]
        for block in (7, 64, 4096):
            band = S.Band(k)
            cut = rng.integers(0, 600)
            got = band.add(count[:cut], lang[:cut], block).tolist() + (band.add(count[cut:], lang[cut:], block) + cut).tolist()
            assert got == want


def test_equals_sql(spark):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
        want = sorted(db.execute(S.ORACLE).fetchall())
    assert rows_of(S.audit(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))) == want
    assert len(want) > 100 and texts()


@pytest.mark.parametrize("text", ["", "A" * 70_000, "x y " * 50_000])
def test_long_texts(spark, text):
    rows = [("en", "a", text), ("en", "b", text), ("en", "b", "x y z a"), ("en", "a", "x")]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(S.audit(frame, min_docs=2)) == brute(rows, min_docs=2)
