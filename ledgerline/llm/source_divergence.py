"""Source divergence audit: which terms and which other sources a source departs from.

Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are
lower-cased.  Each language keeps its V terms that occur in at least
``MIN_DOCS`` of its documents.  A group is a (language, source) or a whole
language; with N occurrences of kept terms it gives each kept term

    p = 1 + floor(SCALE * (count + 1) / (N + V)),        f = floor((p - q)^2 / q).

``pair`` compares every two sources of a language over all kept terms.  A term that
a source lacks has the source's least p there.  What a source's terms have against
another's least p follows from the counts of its counts; terms that two sources
share are corrected for by tasks that hold whole terms, fill tables of sources by
terms and return one whole number for each pair.  All sums are exact.

``term`` ranks the terms that a source uses more than its language does.  For
p > q, f never falls with a higher group count and never rises with a higher
language count, so a term that has at least k terms with a group count as high, a
language count as low and an earlier UTF-8 name cannot be among the first k.  Each
partition keeps the terms with fewer than k such dominators (the k-skyband: a
dominator outside the band has k dominators inside it, so the band alone decides);
bands are merged ``FAN_IN`` at a time until each group has one, which is ranked.

Defined results: null text, language or source count as empty; a language without
kept terms gives pairs with value 0 and no terms; a source alone in its language
has no pairs; repeated rows are documents of their own; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, chunks, give_back, pin, spans, utf8

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Partitions that one merge of skybands takes together.
FAN_IN = 16
#: Cells of a task's table of sources by terms.
CELLS = 1 << 20
#: Counts that a task holds before it sends them.
HELD = 400_000

_INSIDE = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


# --- counts --------------------------------------------------------------------------

def _batch_counts(group: np.ndarray, column: pa.Array) -> pa.Table:
    """(g, term, n, docs) of some documents; ``group`` is each document's group number."""
    data, at = utf8(column)
    found = []
    for lo, hi in chunks(at):
        part = data[at[lo]:at[hi]]
        starts, ends, first = spans(part, at[lo:hi + 1] - at[lo], _INSIDE)
        if not len(starts):
            continue
        letters = LOWER[part[_INSIDE[part]]]
        cut = np.concatenate(([0], np.cumsum(ends - starts)))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
        code, size = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        once, n = np.unique(doc * size + code, return_counts=True)
        key = group[lo:hi][once // size] * size + once % size
        keys, inverse = np.unique(key, return_inverse=True)
        found.append(pa.table({"g": keys // size, "term": words.dictionary.take(pa.array(keys % size)),
                               "n": np.bincount(inverse, n, len(keys)).astype(np.int64),
                               "docs": np.bincount(inverse, minlength=len(keys)).astype(np.int64)}))
    return pa.concat_tables(found) if found else pa.table(
        {"g": pa.array([], pa.int64()), "term": pa.array([], pa.large_string()), "n": pa.array([], pa.int64()), "docs": pa.array([], pa.int64())})


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up inside each
    task as far as ``HELD`` counts.  A group's documents without terms give no row."""
    def column(name: str, alias: str):
        return F.coalesce(docs[name].cast("string"), F.lit("")).alias(alias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        held: list[pa.Table] = []

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "sum")])

        def send(table: pa.Table) -> Iterator[pa.RecordBatch]:
            pairs = list(names)
            of = table["g"].to_numpy()
            lang, source = (pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1))
            out = pa.table({"lang": lang.take(pa.array(of)), "source": source.take(pa.array(of)), "term": table["term"].cast(pa.string()),
                            "n": table["n_sum"], "docs": table["docs_sum"]})
            yield from out.combine_chunks().to_batches(max_chunksize=100_000)

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            group = np.array([names.setdefault(k, len(names)) for k in keys], np.int64)
            held.append(_batch_counts(group, batch.column(2)))
            if sum(t.num_rows for t in held) > HELD:
                table = added()
                if table.num_rows > HELD // 2:
                    yield from send(table)
                    held, names = [], {}
                else:
                    held = [table.rename_columns(["g", "term", "n", "docs"])]
        if held:
            yield from send(added())
        held.clear()
        give_back()

    parts = docs.select(column(lang_col, "lang"), column(source_col, "source"), column(text_col, "text")) \
        .mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    # Dealt by language and term, so that sums over the sources of a term need no second shuffle.
    return parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, n_lang) of the kept terms, written."""
    of_term = Window.partitionBy("lang", "term")
    return pin(term_counts(docs, text_col, lang_col, source_col)
               .withColumn("n_lang", F.sum("n").over(of_term)).withColumn("in_docs", F.sum("docs").over(of_term))
               .where(F.col("in_docs") >= min_docs).select("lang", "term", "source", "n", "n_lang"), "term-counts")


def _share(count, total):
    """1 + floor(SCALE * (count + 1) / total) in whole numbers of 38 digits."""
    return F.expr(f"1L + cast(({SCALE}BD * (cast({count} as decimal(20,0)) + 1)) div cast({total} as decimal(20,0)) as bigint)")


def _groups(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Every occurring group, numbered inside its language (``place``): its kept ``terms``,
    N + V as ``total`` and its least p as ``low``; the language's V and N + V."""
    def column(name: str, alias: str):
        return F.coalesce(docs[name].cast("string"), F.lit("")).alias(alias)

    def known(name: str):
        return F.coalesce(name, F.lit(0))

    every = docs.select(column(lang_col, "lang"), column(source_col, "source")).distinct()
    by_term = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang"))
    whole = by_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("all_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("terms"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return pin(every.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select(
        "lang", "source", place.alias("place"), known("terms").alias("terms"), known("v").alias("v"),
        F.greatest(known("own_n") + known("v"), F.lit(1)).alias("total"), F.greatest(known("all_n") + known("v"), F.lit(1)).alias("lang_total"))
        .withColumn("low", _share("0", "total")), "groups")


# --- part pair -------------------------------------------------------------------------

def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """sum over columns of floor((p - q)^2 / q) for each row of ``p`` and row of ``q``."""
    out = np.empty((len(p), len(q)), np.int64)
    for k, row in enumerate(q):
        gap = p - row
        out[:, k] = (gap * gap // row).sum(axis=1)
    return out


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (lang, term, place, p, low) in the order of (lang, term): what two sources
    that share terms have beyond what each has against the other's least p."""
    key, sums, cells, held, rows_held = None, {}, 0, [], 0

    def send() -> Iterator[pa.RecordBatch]:
        for places, total in sums.values():
            i, j = np.nonzero(total)
            for lo in range(0, len(i), 100_000):
                a, b = i[lo:lo + 100_000], j[lo:lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(a), pa.string()), pa.array(places[a]), pa.array(places[b]), pa.array(total[a, b])],
                                                 names=["lang", "a", "b", "value"])

    def add() -> int:
        """Add the held rows (whole terms) to the sums; number of cells of the sums."""
        term, place, p, low = (np.concatenate([h[k] for h in held]) for k in range(4))
        col = np.cumsum(np.concatenate(([0], term[1:] != term[:-1])))
        places, at = np.unique(place, return_index=True)
        least, width, step = low[at], int(col[-1]) + 1, max(1, CELLS // len(places))
        total = np.zeros((len(places), len(places)), np.int64)
        for lo in range(0, width, step):
            n = min(width, lo + step) - lo
            mine = slice(*np.searchsorted(col, [lo, lo + n]))
            grid = np.repeat(least[:, None], n, axis=1)
            grid[np.searchsorted(places, place[mine]), col[mine] - lo] = p[mine]
            flat = np.repeat(least[:, None], n, axis=1)
            total += _sums(grid, grid) - _sums(grid, flat) - _sums(flat, grid) + _sums(flat[:, :1], flat[:, :1]) * n
        same = places.tobytes()
        sums[same] = (places, sums[same][1] + total if same in sums else total)
        return sum(t.size for _, t in sums.values())

    for batch in batches:
        lang = batch.column("lang").dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], lang[1:] != lang[:-1], [True]))) if batch.num_rows else []
        for lo, hi in zip(cut[:-1], cut[1:]):
            now = batch.column("lang")[lo].as_py()
            if now != key:
                if held:
                    add()
                if sums:
                    yield from send()
                key, sums, cells, held, rows_held = now, {}, 0, [], 0
            part = batch.slice(lo, hi - lo)
            rows = (np.asarray(part.column("term").to_pylist(), object), *(part.column(c).to_numpy().astype(np.int64) for c in ("place", "p", "low")))
            held.append(rows)
            rows_held += len(rows[0])
            if rows_held > CELLS // 8:
                # The last term may go on in the next rows: it stays.
                whole = int(np.argmax(rows[0] == rows[0][-1]))
                held[-1] = tuple(x[:whole] for x in rows)
                if whole:
                    cells = add()
                    held, rows_held = [tuple(x[whole:] for x in rows)], len(rows[0]) - whole
                else:
                    held[-1] = rows
                if cells > 4 * CELLS:
                    yield from send()
                    sums, cells = {}, 0
    if held:
        add()
    if sums:
        yield from send()
    held.clear()
    sums.clear()
    give_back()


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two different sources of a language.

    Sum over terms of f(p, q) = what all terms of either source have against the
    other's least p (from the counts of their counts), plus the least against the
    least for terms in neither, corrected for terms in both (``_common``)."""
    own = groups.select("lang", "source", "place", "total", "low")
    rows = kept.join(own, ["lang", "source"]).select("lang", "term", "place", _share("n", "total").alias("p"), "low")
    common = rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "place") \
        .mapInArrow(_common, "lang string, a bigint, b bigint, value bigint")
    # Every two sources of a language: dealt by salt, so that a language is not one task's.
    salts = 16
    others = groups.select("lang", F.col("place").alias("other"), F.col("low").alias("other_low"), F.col("terms").alias("other_terms"),
                           "v", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def against(left: DataFrame, *by: str) -> DataFrame:
        return left.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).join(others, ["lang", "salt"]).where("place <> other")

    counted = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("h")).join(own, ["lang", "source"]) \
        .withColumn("p", _share("n", "total"))
    one = against(counted, "source", "n")

    def part(frame: DataFrame, a: str, b: str, value: str) -> DataFrame:
        return frame.select("lang", F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"),
                            F.expr(value).cast("decimal(38,0)").alias("value"))

    neither = against(groups.select("lang", "source", "place", "low", "terms"), "source")
    every = part(one, "place", "other", f"cast(h as decimal(19,0)) * ({_f('p', 'other_low')})") \
        .unionByName(part(one, "other", "place", f"cast(h as decimal(19,0)) * ({_f('other_low', 'p')})")) \
        .unionByName(part(neither, "place", "other", f"cast(v - terms - other_terms as decimal(19,0)) * ({_f('low', 'other_low')})")) \
        .unionByName(part(common.where("a <> b"), "a", "b", "value"))
    total = every.groupBy("lang", "a", "b").agg(F.sum("value").cast("bigint").alias("value"))
    first, second = (groups.select("lang", F.col("place").cast("bigint").alias(k), F.col("source").alias(name)) for k, name in (("a", "source"), ("b", "item")))
    return total.join(first, ["lang", "a"]).join(second, ["lang", "b"]).select("lang", "source", "item", "value")


# --- part term -------------------------------------------------------------------------

class Band:
    """The k-skyband of rows that come in the order of their names: those with fewer than
    ``k`` earlier rows of a group count as high and a language count as low."""

    def __init__(self, k: int):
        self.k = k
        self.count, self.lang = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, count: np.ndarray, lang: np.ndarray, block: int = 2048) -> np.ndarray:
        """Which of some new rows belong to the band."""
        kept = []
        for lo in range(0, len(count), block):
            cells, of = np.unique(np.stack((count[lo:lo + block], lang[lo:lo + block])), axis=1, return_inverse=True)
            before = np.array([np.count_nonzero((self.count >= c) & (self.lang <= g)) for c, g in cells.T.tolist()])[of.ravel()]
            live = np.flatnonzero(before < self.k)
            c, g = count[lo + live], lang[lo + live]
            # A row that is out already can only be ahead of rows that are out as well.
            inside = np.tril((c[None, :] >= c[:, None]) & (g[None, :] <= g[:, None]), -1).sum(axis=1)
            new = before[live] + inside < self.k
            kept.append(lo + live[new])
            self.count, self.lang = np.concatenate((self.count, c[new])), np.concatenate((self.lang, g[new]))
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _bands(k: int):
    """Rows (slot, lang, source, term, n, n_lang, value) in that order: those of each run's skyband."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, band = None, Band(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).dictionary_encode().indices.to_numpy() for c in ("slot", "lang", "source")])
            cut = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0), [True])))
            for lo, hi in zip(cut[:-1], cut[1:]):
                now = tuple(batch.column(c)[lo].as_py() for c in ("slot", "lang", "source"))
                if now != key:
                    key, band = now, Band(k)
                part = batch.slice(lo, hi - lo)
                chosen = band.add(part.column("n").to_numpy(), part.column("n_lang").to_numpy())
                if len(chosen):
                    yield part.take(pa.array(chosen))

    return run


def top_terms(kept: DataFrame, groups: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the first ``k`` terms that a source uses more than its language."""
    slots = max(1, int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = kept.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]) \
        .withColumn("p", _share("n", "total")).withColumn("q", _share("n_lang", "lang_total")).where("p > q") \
        .select(F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int").alias("slot"), "lang", "source", "term", "n", "n_lang",
                F.expr(_f("p", "q")).alias("value"))
    schema, order = rows.schema, ["slot", "lang", "source", "term"]
    bands = rows.repartition("slot").sortWithinPartitions(*order).mapInArrow(_bands(k), schema)
    while slots > 1:
        slots = math.ceil(slots / FAN_IN)
        merged = bands.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("int"))
        bands = merged.repartition("lang", "source", "slot").sortWithinPartitions(*order).mapInArrow(_bands(k), schema)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return bands.withColumn("rank", rank).where(F.col("rank") <= k).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    kept = kept_counts(docs, text_col, lang_col, source_col, min_docs)
    groups = _groups(docs, kept, lang_col, source_col)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(kept, groups).withColumn("rank", rank)
    terms = top_terms(kept, groups, top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS nl FROM c GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(nl) AS n FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.nl FROM g JOIN kept k ON g.lang = k.lang
         LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS n FROM cell GROUP BY ALL),
p AS (SELECT cell.lang, cell.source, cell.term, cell.n, 1 + ({SCALE}::HUGEINT * (cell.n + 1)) // (s.n + v.v) AS p,
             1 + ({SCALE}::HUGEINT * (cell.nl + 1)) // (v.n + v.v) AS q
      FROM cell JOIN s ON s.lang = cell.lang AND s.source = cell.source JOIN v ON v.lang = cell.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
