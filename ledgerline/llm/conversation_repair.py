"""Conversation structure repair by weighted CYK over spans.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Edits: keep a row
(0), give it the role user or assistant (1), delete it (2; blank and duplicate rows
must go), insert an empty user or assistant row anywhere (5); a truncated row that
is not deleted costs 5 more.  The cheapest edits win, ties go to the least audit
string (the edits' initials K, R, D, I in order).

Grammar in Chomsky normal form, over what a span can become: E nothing, S one
system row, and XY with first role X and last role Y (UU, UA, AU, AA, SU, SA);
X Y -> XZ if the last role of the left part may stand before the first of the
right part, and E is neutral.  A row yields E by deletion and S, UU or AA by
keeping or giving a role.  Insertions are closed over once: every cell is
(inserted) cell (inserted), where an empty span yields UU or AA for one insertion
and UA or AU for two.  A cell holds the least (cost, audit).  Audits of one span
and one cost are never prefixes of each other (the longer one would hold more
insertions and cost more), so least parts make the least whole.

Spans are combined bottom-up by their length.  The symbols say everything that a
neighbour needs to know of a span, so every split of a span gives the same cells
(tested), and one split, in the middle, is enough: rows to runs of at most
``RUN`` rows in the tasks that hold them, then runs to the conversation.

Rows are first dealt by ranges of (conversation, turn), so a conversation may go
over many tasks; faults, counts and cells are worked out there, and only the runs
of a conversation (its audit, which is one value of the result) meet.

Defined results: null ids, roles, texts and turns count as one space where text is
needed; rows without an id are one conversation; rows of one turn are ordered by the
first 64 characters of role and text, then by the MD5 of both; a role that does not
begin with s, u or a cannot be kept; turns that are null come first and make no
gaps; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin

SYMBOLS = ("E", "S", "UU", "UA", "AU", "AA", "SU", "SA")
FOLLOWS = {"S": "U", "U": "A", "A": "U"}
RUN_BITS = 12
RUN = 1 << RUN_BITS
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: ``[^\x20\x09-\x0D]`` is what is left after trimming these.
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
ROLE = {"U": "user", "A": "assistant"}

Cell = list  # for each symbol the least (cost, audit), or None


def _rules() -> list[tuple[int, int, int]]:
    """(left, right, whole) of the binary rules."""
    out = []
    for a, x in enumerate(SYMBOLS):
        for b, y in enumerate(SYMBOLS):
            if "E" in (x, y):
                out.append((a, b, b if x == "E" else a))
            elif FOLLOWS[x[-1]] == y[0]:
                out.append((a, b, SYMBOLS.index(x[0] + y[-1])))
    return out


RULES = _rules()
#: What an empty span yields by insertions alone.
EMPTY: Cell = [(0, ""), None, (INSERT, "I"), (2 * INSERT, "II"), (2 * INSERT, "II"), (INSERT, "I"), None, None]


def join(left: Cell, right: Cell) -> Cell:
    """The cell of a span from the cells of its two parts."""
    out: Cell = [None] * len(SYMBOLS)
    for a, b, whole in RULES:
        x, y = left[a], right[b]
        if x is not None and y is not None:
            best = out[whole]
            cost = x[0] + y[0]
            if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
                out[whole] = (cost, x[1] + y[1])
    return out


def _row_cell(initial: str, fault: int) -> Cell:
    out: Cell = [(DELETE, "D")] + [None] * (len(SYMBOLS) - 1)
    if fault not in (BLANK, DUPLICATE):
        more = CUT_OFF if fault == TRUNCATED else 0
        for symbol in ("UU", "AA"):
            out[SYMBOLS.index(symbol)] = (more, "K") if symbol[0] == initial.upper() and initial in "ua" else (more + REROLE, "R")
        if initial == "s":
            out[SYMBOLS.index("S")] = (more, "K")
    return join(join(EMPTY, out), EMPTY)


ROW_CELLS = {(i, f): _row_cell(i, f) for i in ("s", "u", "a", "?") for f in range(4)}


def span(cells: list[Cell]) -> Cell:
    """The cell of a row of neighbouring spans, combined bottom-up by length."""
    while len(cells) > 1:
        cells = [join(cells[k], cells[k + 1]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


def accepted(cell: Cell) -> tuple[int, tuple[int, str]]:
    """The symbol of the cheapest repair, and its (cost, audit)."""
    return min(((k, cell[k]) for k, name in enumerate(SYMBOLS) if name in ("E", "UA", "SA") and cell[k] is not None), key=lambda x: x[1])


def _levels(runs: list[Cell]) -> list[list[Cell]]:
    levels = [runs]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([join(below[k], below[k + 1]) if k + 1 < len(below) else below[k] for k in range(0, len(below), 2)])
    return levels


def choices(runs: list[Cell]) -> tuple[tuple[int, str], list[int]]:
    """(cost, audit) of a conversation and the symbol that each of its runs becomes."""
    levels = _levels(runs)
    symbol, best = accepted(levels[-1][0])
    chosen = [symbol]
    for below in reversed(levels[:-1]):
        split = []
        for k, whole in enumerate(chosen):
            if 2 * k + 1 == len(below):
                split.append(whole)
                continue
            left, right = below[2 * k], below[2 * k + 1]
            options = [(left[a][0] + right[b][0], left[a][1] + right[b][1], a, b) for a, b, w in RULES
                       if w == whole and left[a] is not None and right[b] is not None]
            split += min(options)[2:]
        chosen = split
    return best, chosen


# --- rows ----------------------------------------------------------------------------

def ordered_rows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, pos): rows in the order of their conversations and
    turns, written; ``pos`` grows by one from row to row of a partition."""
    def text(name: str):
        return F.coalesce(turns[name].cast("string"), F.lit(" "))

    rows = turns.select(turns[id_col].alias("conv"), turns[turn_col].cast("bigint").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    # Keys of bounded length; equal rows are spread, and it does not matter which of them comes first.
    keyed = rows.withColumn("r", F.left("role", F.lit(64))).withColumn("t", F.left("text", F.lit(64))) \
        .withColumn("m", F.md5(F.concat_ws("\x00", "role", "text"))).withColumn("spread", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    order = ["conv", "turn", "r", "t", "m", "spread"]
    return pin(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
               .select("conv", "turn", "role", "text", "pos"), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, pos, initial, fault) of every row; the first fault counts."""
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    first = rows.groupBy("conv", same.alias("same")).agg(F.min("pos").alias("first_pos")).select("first_pos")
    bare = F.trim(F.col("text"), F.lit(SPACE))
    marked = rows.select("conv", "turn", "pos", F.left("role", F.lit(1)).alias("initial"), (bare == "").alias("blank"),
                         (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    return marked.join(first, F.col("pos") == F.col("first_pos"), "left").select(
        "conv", "turn", "pos", "initial", F.when(F.col("blank"), BLANK).when(F.isnull("first_pos"), DUPLICATE)
        .when(F.col("cut"), TRUNCATED).otherwise(0).alias("fault"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
RUNS = "start bigint, n bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint, low_turn bigint, turns bigint, " \
    + ", ".join(f"{c} bigint" for c in COUNTS) + ", costs array<bigint>, audits array<string>"


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole chunks, by ``pos``: one summary for each conversation's rows in a chunk."""
    held: list[pa.RecordBatch] = []

    def summaries(table: pa.Table) -> pa.RecordBatch:
        conv = table["conv"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        chunk = table["pos"].to_numpy() >> RUN_BITS
        cut = np.flatnonzero(np.concatenate(([True], (conv[1:] != conv[:-1]) | (chunk[1:] != chunk[:-1]), [True]))).tolist()
        pos, turn, initial, fault = (table[c].to_pylist() for c in ("pos", "turn", "initial", "fault"))
        out = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            letters, marks, known = initial[lo:hi], fault[lo:hi], [t for t in turn[lo:hi] if t is not None]
            cell = span([ROW_CELLS[i if i in ("s", "u", "a") else "?", f] for i, f in zip(letters, marks)])
            out.append({"start": pos[lo], "n": hi - lo, "first_initial": letters[0], "last_initial": letters[-1], "first_turn": turn[lo],
                        "last_turn": turn[hi - 1], "low_turn": known[0] if known else None, "turns": len(set(known)),
                        "blank": marks.count(BLANK), "duplicate": marks.count(DUPLICATE), "truncated": marks.count(TRUNCATED),
                        "illegal": sum(not _legal(a, b) for a, b in zip(letters, letters[1:])),
                        "costs": [c and c[0] for c in cell], "audits": [c and c[1] for c in cell]})
        schema = pa.schema([("start", pa.int64()), ("n", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()),
                            ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("low_turn", pa.int64()), ("turns", pa.int64()),
                            *[(c, pa.int64()) for c in COUNTS], ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
        rest = pa.RecordBatch.from_pylist(out, schema=schema)
        heads = table["conv"].combine_chunks().take(pa.array(cut[:-1]))
        return pa.RecordBatch.from_arrays([heads, *rest.columns], names=["conv", *rest.schema.names])

    def ready(last: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        chunk = table["pos"].to_numpy() >> RUN_BITS
        whole = len(chunk) if last else int(np.argmax(chunk == chunk[-1]))
        if whole:
            yield summaries(table.slice(0, whole))
        if whole < len(chunk):
            held.extend(table.slice(whole).to_batches())

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield from ready(False)
    if held:
        yield from ready(True)


def _edits(audit: str, symbol: int, before: str, place: int) -> tuple[list[tuple], str]:
    """(offset of the row or None, place, edit, role or None) of what a run leaves, and the last role."""
    out, row, system = [], 0, SYMBOLS[symbol][0] == "S"
    for letter in audit:
        if letter != "D":
            before = "S" if system else FOLLOWS.get(before, "U")
            system = False
            out.append((None if letter == "I" else row, place + len(out), letter, None if letter == "K" else ROLE[before]))
        row += letter != "I"
    return out, before


SUMMARY = ("gaps", *COUNTS, "cost")
MENDED = ", ".join(f"{c} bigint" for c in SUMMARY) + ", audit string, pos bigint, place bigint, edit string, role string"


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs by conversation and start: one row of sums for each conversation, and one for each row that stays or comes in."""
    runs: list[dict] = []
    kind = pa.schema([*[(c, pa.int64()) for c in SUMMARY], ("audit", pa.string()), ("pos", pa.int64()), ("place", pa.int64()),
                      ("edit", pa.string()), ("role", pa.string())])

    def mended(conv: pa.Scalar) -> Iterator[pa.RecordBatch]:
        cells = [[None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])] for r in runs]
        (cost, audit), chosen = choices(cells)
        total = {c: sum(r[c] for r in runs) for c in COUNTS}
        seams = list(zip(runs, runs[1:]))
        total["illegal"] += sum(not _legal(a["last_initial"], b["first_initial"]) for a, b in seams)
        low, high = next((r["low_turn"] for r in runs if r["low_turn"] is not None), None), runs[-1]["last_turn"]
        distinct = sum(r["turns"] for r in runs) - sum(a["last_turn"] is not None and a["last_turn"] == b["low_turn"] for a, b in seams)
        out = [total | {"gaps": 0 if low is None else high - low + 1 - distinct, "cost": cost, "audit": audit}]
        before, place = "", 0
        for r, cell, symbol in zip(runs, cells, chosen):
            rows, before = _edits(cell[symbol][1], symbol, before, place)
            place += len(rows)
            out += [{"pos": None if k is None else r["start"] + k, "place": p, "edit": e, "role": role} for k, p, e, role in rows]
            if len(out) > 20_000:
                yield sent(conv, out)
                out = []
        if out:
            yield sent(conv, out)

    def sent(conv: pa.Scalar, out: list[dict]) -> pa.RecordBatch:
        rest = pa.RecordBatch.from_pylist(out, schema=kind)
        return pa.RecordBatch.from_arrays([pa.repeat(conv, len(out)), *rest.columns], names=["conv", *rest.schema.names])

    now = None
    for batch in batches:
        convs, small = batch.column("conv"), []
        for k, row in enumerate(batch.drop_columns(["conv"]).to_pylist()):
            conv = convs[k]
            if now is None or conv.as_py() != now.as_py():
                if runs:
                    small += mended(now)
                now, runs = conv, []
            runs.append(row)
        if small:
            yield from pa.Table.from_batches(small).combine_chunks().to_batches()
    if runs:
        yield from mended(now)


def _conv_kind(turns: DataFrame, id_col: str) -> str:
    return turns.schema[id_col].dataType.simpleString()


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(conversations, rows)``.

    ``conversations``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with rows.
    ``rows``: (conv_id, place, turn, role, text, edit) of the repaired conversations; edit is K, R or I."""
    conv = f"conv {_conv_kind(turns, id_col)}, "
    rows = ordered_rows(turns, id_col, turn_col, role_col, text_col)
    chunked = faults(rows).withColumn("chunk", F.shiftright("pos", RUN_BITS)).repartition("chunk").sortWithinPartitions("pos")
    runs = chunked.drop("chunk").mapInArrow(_run_rows, conv + RUNS)
    mended = pin(runs.repartition("conv").sortWithinPartitions("conv", "start").mapInArrow(_mend, conv + MENDED), "mended")
    summary = mended.where("audit is not null").select(F.col("conv").alias("conv_id"), *SUMMARY, "audit")
    kept = mended.where("edit in ('K', 'R')").select("pos", "place", "edit", F.col("role").alias("new_role"))
    stays = rows.join(kept, "pos").select(F.col("conv").alias("conv_id"), "place", "turn", F.coalesce("new_role", "role").alias("role"), "text", "edit")
    comes = mended.where("edit = 'I'").select(F.col("conv").alias("conv_id"), "place", F.lit(None).cast("bigint").alias("turn"), "role", F.lit("").alias("text"), "edit")
    return summary, stays.unionByName(comes)


# --- the query's damage and digest ------------------------------------------------------

def damage(turns: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given the role user, by
    the CRC-32 of ``conv_id:turn``.  Nulls become one space, turns and ids stay."""
    def text(name: str):
        return F.coalesce(turns[name].cast("string"), F.lit(" "))

    rows = turns.select(turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"), text("role").alias("role"), text("text").alias("text"),
                        F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))), F.lit(20)).alias("kind")).where("kind <> 0")
    cut = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), cut.alias("text"), F.explode(times).alias("copy")) \
        .drop("copy")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the lines ``role:text`` of each repaired
    conversation.  One digest reads its rows in turn; the task holds a batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.repeat(now, 1), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            out = []
            for conv, line in zip(batch.column("conv_id"), batch.column("line").to_pylist()):
                if now is None or conv.as_py() != now.as_py():
                    if digest is not None:
                        out.append(result())
                    now, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if digest is not None:
            yield result()

    lines = rows.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line") \
        .mapInArrow(run, f"conv_id {_conv_kind(rows, 'conv_id')}, repaired_sha256 string")


def repair_report(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation of ``turns`` after ``damage`` and repair."""
    summary, rows = repair(damage(turns))
    every = turns.select("conv_id").distinct()
    found, sums = digests(rows).withColumnRenamed("conv_id", "d_conv"), summary.withColumnRenamed("conv_id", "s_conv")
    out = every.join(sums, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in SUMMARY], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
