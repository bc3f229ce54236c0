"""Small tables with every awkward case: nulls in any column, empty and very
long texts, repeated rows, ties, and extra columns with clashing names."""

import random

import pytest
from pyspark.sql import types as T

#: Names that the operators use inside themselves.
CLASHING = ["block", "rest", "sizes", "data", "key", "fp", "node", "root", "size", "part", "curve", "at", "w", "id", "tokens", "h"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in CLASHING])


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n))


def texts() -> list[tuple]:
    """(doc_id, text) with copies, near copies, shared passages and awkward rows."""
    passage, long = words(900, 70), words(901, 12_000)
    rows = [(k, words(k, 40 + 7 * k)) for k in range(1, 9)]
    rows += [(20, passage + " " + words(21, 50)), (21, words(22, 60) + "\n" + passage + "\t" + words(23, 30)),
             (22, words(3, 61)), (23, words(3, 61)), (24, words(3, 61) + " tail"), (25, words(3, 61).upper()),
             (30, None), (31, ""), (32, " \t\n\x0b\x0c\r "), (33, " "), (34, "one"), (35, "one"), (36, "é ß 汉字 🙂 ​"),
             (37, "a\x00b c"), (40, long), (41, long + " end"), (42, "x" * 30_000), (43, "ha " * 3000), (44, "line one\n" * 60),
             (45, "### $$$ %%% &&& " * 40), (None, words(50, 60)), (None, words(50, 60)), (None, None), (7, words(7, 89)), (-5, words(60, 80))]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, None if k % 5 == 0 else "en", f"src{k % 3}" if k % 4 else None, None if t is None else len(t),
             *[None if k % 2 else "x"] * len(CLASHING)) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
