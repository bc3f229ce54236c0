"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is one Boolean expression over the text that is true when the
document must go.  ``plan_cascade`` pins a bounded sample, measures each rule's
cost (seconds over the sample) and its selectivity (share rejected), and orders
the rules by rejection per cost; ``first_failed`` chains them in a CASE, so a
document that one rule rejects pays for no later rule.  The verdict does not
depend on the order, only the work does.

Defined results: a null text counts as the empty text (no words; the word-count
rule rejects it); repeated rows are judged row by row; an empty table gives an
empty table; other columns of the input are kept as they are.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, pin

SYMBOLS = "[#*$%&|<>]"
SAMPLE_ROWS = 2000  #: at most about so many rows are read to order the rules

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_CHAR = 0.04
MAX_DUP_LINE_SHARE = 0.5
MAX_MEAN_WORD = 30.0
MAX_SHOUTED_SHARE = 0.3


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def word_chars(words: Column) -> Column:
    """Code points inside words."""
    return F.char_length(F.array_join(words, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


_POSITION_BITS = 20


def n_repeat_words(words: Column, size: int = 3) -> Column:
    """Words inside ``size``-word windows that occur twice or more in the text.

    Texts whose window hashes are all different are done at once.  Else hash
    (44 bits) and position (20 bits) of each window are sorted as one number,
    so equal windows are neighbours.  Where neighbours share the 44 bits but
    not the words, or the text is longer than 2**20 words, the windows' words
    themselves are sorted instead: the count is exact in every case."""
    def window(w, i):
        return F.array_join(F.slice(w, i + 1, size), " ")

    def inner(w):
        return F.slice(w, F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(0)))

    def covered(positions):
        return F.aggregate(
            F.transform(positions, lambda x, i: F.when(i == 0, F.lit(size)).otherwise(F.least(F.lit(size), x - F.get(positions, i - 1)))),
            F.lit(0), lambda a, x: a + x)

    def prefix(x):
        return F.shiftright(x, _POSITION_BITS)

    def position(x):
        return x.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")

    def by_words(w):
        tagged = F.sort_array(F.transform(inner(w), lambda x, i: F.struct(window(w, i).alias("w"), i.alias("i"))))
        return let(tagged, lambda s: let(F.sort_array(F.transform(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False))),
            lambda x: x["i"])), covered))

    def by_hash(w, h):
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, _POSITION_BITS).bitwiseOR(i.cast("bigint"))))
        hits = let(packed, lambda s: F.filter(s, lambda x, i: (
            (prefix(F.get(s, i - 1)) == prefix(x)) | (prefix(F.get(s, i + 1)) == prefix(x)))))
        def differ(p, q):
            return reduce(lambda a, b: a | b, [F.get(w, p + k) != F.get(w, q + k) for k in range(size)])

        return let(hits, lambda s: let(F.transform(s, position), lambda at: F.when(
            F.exists(F.transform(s, lambda x, i: (i > 0) & (prefix(F.get(s, i - 1)) == prefix(x))
                                 & differ(F.get(at, i - 1), F.get(at, i))), lambda wrong: wrong),
            by_words(w)).otherwise(let(F.sort_array(at), covered))))

    return let(words, lambda w: let(
        F.transform(inner(w), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)])),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
        .when(F.size(w) >= 1 << _POSITION_BITS, by_words(w)).otherwise(by_hash(w, h)))).cast("bigint")


@dataclass(frozen=True)
class Rule:
    """``rejects(text)`` is true when the document must go."""

    name: str
    rejects: object


def _repeats(text: Column) -> Column:
    return let(words_of(text), lambda w: 100 * n_repeat_words(w) > MAX_REPEAT_PERCENT * F.size(w))


def _mean_word(text: Column) -> Column:
    return let(words_of(text), lambda w: word_chars(w) > MAX_MEAN_WORD * F.size(w))


def _shouted(text: Column) -> Column:
    return 6 * F.regexp_count(text, F.lit("[A-Z]{4}")) > MAX_SHOUTED_SHARE * F.char_length(text)


def _lines(text: Column) -> Column:
    return n_dup_lines(text) > MAX_DUP_LINE_SHARE * F.size(F.split(text, "\n", -1))


RULES = (
    Rule("too_few_words", lambda t: n_words(t) < MIN_WORDS),
    Rule("repeated_windows", _repeats),
    Rule("symbols", lambda t: n_symbols(t) > MAX_SYMBOLS_PER_CHAR * F.char_length(t)),
    Rule("repeated_lines", _lines),
    Rule("long_words", _mean_word),
    Rule("shouted", _shouted),
)


def plan_cascade(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
                 seed: int = 7) -> list[tuple[Rule, float, float]]:
    """Rules with (rejected share, seconds on the sample), best first.

    The sample is a Bernoulli sample of the whole table of about
    ``sample_rows`` rows, pinned once so no rule's cost holds the scan."""
    total = docs.count()
    share = min(1.0, sample_rows / max(1, total))
    texts = docs.select(clean(docs[text_col]).alias("text"))
    sample = pin(texts if share >= 1.0 else texts.sample(fraction=share, seed=seed), "rule-sample")
    size = max(1, sample.count())
    found = []
    for rule in rules:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(rule.rejects(F.col("text")))).first()[0] or 0
        found.append((rule, hits / size, time.perf_counter() - began))
    return sorted(found, key=lambda x: (-x[1] / max(x[2], 1e-6), x[0].name))


def first_failed(text: Column, ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none; later rules are not evaluated."""
    return reduce(lambda tail, rule: F.when(rule.rejects(text), F.lit(rule.name)).otherwise(tail),
                  reversed(ordered), F.lit(None).cast("string"))


def apply_rules(docs: DataFrame, rules=RULES, text_col: str = "text", out: str = "failed_rule",
                sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``out``: the rule that rejected, or null."""
    order = [x[0] for x in plan_cascade(docs, rules, text_col, sample_rows)]
    return docs.withColumn(out, first_failed(clean(docs[text_col]), order))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``."""
    order = [x[0] for x in plan_cascade(docs, RULES, text_col)]
    return docs.where(first_failed(clean(docs[text_col]), order).isNull())


#: Rules beyond the two that the base columns already decide.
EXTRA = tuple(r for r in RULES if r.name not in ("too_few_words", "repeated_windows"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base measures of every row and the cascade's verdict."""
    order = [x[0] for x in plan_cascade(docs, EXTRA, text_col)]
    base = docs.select(docs[id_col].alias("doc_id"), clean(docs[text_col]).alias("text"))
    measured = base.select("doc_id", "text", let(words_of(F.col("text")), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n"), word_chars(w).alias("chars"), n_repeat_words(w).alias("r"))).alias("w"))
    t = F.col("text")
    failed = (F.col("w.n") < MIN_WORDS) | (100 * F.col("w.r") > MAX_REPEAT_PERCENT * F.col("w.n"))
    return measured.select(
        "doc_id", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(first_failed(t, order).isNull()).alias("kept"))


def oracle_ctes(source: str = "documents") -> str:
    """The report as DuckDB SQL: a CTE ``quality`` over ``source`` (doc_id, text)."""
    return rf"""
q_in AS (SELECT row_number() OVER () AS q_id, doc_id, coalesce(text, '') AS text FROM {source}),
q_word AS (SELECT q_id, unnest(regexp_extract_all(text, '{WORD}')) AS w, generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) AS i FROM q_in),
q_win AS (SELECT q_id, i, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s AS tri FROM q_word WINDOW s AS (PARTITION BY q_id ORDER BY i)),
q_dup AS (SELECT q_id, i FROM (SELECT q_id, i, count(*) OVER (PARTITION BY q_id, tri) AS n FROM q_win WHERE tri IS NOT NULL) WHERE n > 1),
q_rep AS (SELECT q_id, count(DISTINCT j) AS r FROM (SELECT q_id, unnest([i, i + 1, i + 2]) AS j FROM q_dup) GROUP BY q_id),
q_base AS (SELECT doc_id, text, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
   - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))))::BIGINT AS n_dup_lines,
  coalesce(r, 0)::BIGINT AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines,
  length(text) AS n_chars, len(regexp_extract_all(text, '[A-Z]{{4}}')) AS n_shouted
  FROM q_in LEFT JOIN q_rep USING (q_id)),
quality AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words OR n_symbols > {MAX_SYMBOLS_PER_CHAR} * n_chars
   OR n_dup_lines > {MAX_DUP_LINE_SHARE} * n_lines OR word_chars > {MAX_MEAN_WORD} * n_words OR 6 * n_shouted > {MAX_SHOUTED_SHARE} * n_chars) AS kept
  FROM q_base)"""


ORACLE = ("WITH" + oracle_ctes() + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM quality""")
