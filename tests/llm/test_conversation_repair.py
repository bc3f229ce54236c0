"""Conversation repair against a right-to-left search, an exhaustive one, and all splits."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import types as T

from ledgerline.llm import conversation_repair as C

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("conv", "pos", "place", "edit", "audit", "cost", "chunk", "start", "m", "t")])
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def options(row, state):
    """(cost, letter, role, next state) of a row's edits; its initial must be allowed next."""
    role, fault = row
    yield 2, "D", None, state
    if fault not in ("blank", "duplicate"):
        more = 5 * (fault == "truncated")
        if role[:1] and role[:1] in NEXT[state]:
            yield more, "K", role, role[:1]
        for new in ("user", "assistant"):
            if new[0] in NEXT[state]:
                yield more + 1, "R", new, new[0]


def cheapest(rows):
    """(cost, audit, roles) by the best end of each (row, state): exact, since the ends are compared whole."""
    done = {(len(rows), s): (0, "", ()) for s in ("", "a")}
    for k in range(len(rows), -1, -1):
        best = {s: [done[k, s]] if (k, s) in done else [] for s in NEXT}
        if k < len(rows):
            for s in NEXT:
                for cost, letter, role, after in options(rows[k], s):
                    if (k + 1, after) in done:
                        c, a, r = done[k + 1, after]
                        best[s].append((cost + c, letter + a, ((k, role),) * (role is not None) + r))
        for _ in range(3):
            for s in NEXT:
                for new in ("user", "assistant"):
                    if new[0] in NEXT[s] and best[new[0]]:
                        c, a, r = min(best[new[0]], key=lambda x: x[:2])
                        best[s].append((5 + c, "I" + a, ((None, new),) + r))
        for s in NEXT:
            if best[s]:
                done[k, s] = min(best[s], key=lambda x: x[:2])
    return done[0, ""]


def exhaustive(rows, most=2):
    """(cost, audit) over every choice of edits with at most ``most`` insertions in a gap."""
    best = None
    per_row = [[(2, "D", "")] + ([] if f in ("blank", "duplicate") else
               [(5 * (f == "truncated"), "K", r[:1]), (1 + 5 * (f == "truncated"), "R", "u"), (1 + 5 * (f == "truncated"), "R", "a")]) for r, f in rows]
    gaps = [(5 * n, "I" * n, "".join(p)) for n in range(most + 1) for p in itertools.product("ua", repeat=n)]
    for picked in itertools.product(*per_row):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            parts = [ins[0]] + [x for pair in zip(picked, ins[1:]) for x in pair]
            if re.fullmatch("(s?(ua)+)?", "".join(p[2] for p in parts)):
                found = (sum(p[0] for p in parts), "".join(p[1] for p in parts))
                best = found if best is None or found < best else best
    return best


def fault_list(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(table):
    convs, nul = {}, lambda x: " " if x is None else str(x)
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        kind, role, text = zlib.crc32(f"{nul(conv)}:{nul(turn)}".encode()) % 20, nul(role), nul(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks = fault_list([r[1:] for r in rows])
        turns = {r[0] for r in rows} - {None}
        cost, audit, kept = cheapest([(r[1], f) for r, f in zip(rows, marks)])
        text = "\n".join(f"{role}:{'' if k is None else rows[k][2]}" for k, role in kept)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def frame(spark, table):
    return spark.createDataFrame([(*r, *["x"] * 10) for r in table], SCHEMA).repartition(3)


def answer(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def talks(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "a", "", "User", None]
    texts = ["Yes.", "No", "why?", " ", "", None, "ok!  ", "a.b", "Fine.\n", "\x0b\x0c", "…", "A. \x00"]
    return [(c, t if rng.random() < .9 else rng.choice([None, t, t + 2, -4]), rng.choice(roles[:5 + (c % 2) * 5]), rng.choice(texts[:3 + (c % 3) * 5]))
            for c in range(n) for t in range(rng.randrange(1, 9))]


def test_grammar_equals_exhaustive_search():
    rng = random.Random(3)
    names = {None: 0, "blank": C.BLANK, "duplicate": C.DUPLICATE, "truncated": C.TRUNCATED}
    for _ in range(60):
        rows = [(rng.choice(["s", "u", "a", "t"]), rng.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(1, 4))]
        cell = C.span([C.ROW_CELLS[r if r in "sua" else "?", names[f]] for r, f in rows])
        assert C.accepted(cell)[1] == exhaustive(rows) == cheapest(rows)[:2]


def test_every_split_gives_the_same_cells():
    """Full CYK over all spans and all splits."""
    rng = random.Random(7)
    for _ in range(12):
        rows = [C.ROW_CELLS[rng.choice("sua?"), rng.randrange(4)] for _ in range(14)]
        table = {(k, k + 1): c for k, c in enumerate(rows)}
        for length in range(2, len(rows) + 1):
            for lo in range(len(rows) - length + 1):
                splits = [C.join(table[lo, m], table[m, lo + length]) for m in range(lo + 1, lo + length)]
                assert all(s == splits[0] for s in splits)
                table[lo, lo + length] = splits[0]
        assert C.span(rows) == table[0, len(rows)]
        cut = sorted(rng.sample(range(1, 14), 4))
        runs = [C.span(rows[a:b]) for a, b in zip([0] + cut, cut + [14])]
        (cost, audit), chosen = C.choices(runs)
        assert (cost, audit) == C.accepted(table[0, 14])[1] and audit == "".join(r[s][1] for r, s in zip(runs, chosen))


def test_table_against_search(spark):
    table = talks(11, 150) + [(None, None, None, None), (None, 3, "user", "Hi."), (None, 4, "assistant", "Ho."), (900, None, "user", "x."), (-8, 5, "system", "Be.")]
    assert answer(C.repair_report(frame(spark, table))) == brute(table)
    assert answer(C.repair_report(frame(spark, []))) == []


def test_long_conversation_over_many_runs(spark, monkeypatch):
    """One conversation holds most rows, with a long text and many copies of one row; runs of four rows."""
    monkeypatch.setattr(C, "RUN_BITS", 2)
    rng = random.Random(2)
    hot = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {t}.", f"cut {t}", "Same."])) for t in range(400) if t % 9]
    table = hot + [(1, 77, "user", "Same.")] * 60 + [(1, 500, "user", "long " * 20_000 + ".")] + talks(5, 30)[40:]
    table = [r for r in table if r[0] == 1] + [(r[0] + 10, *r[1:]) for r in table if r[0] != 1]
    assert answer(C.repair_report(frame(spark, table))) == brute(table)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", "And?"), (1, 4, "assistant", "Yes.")]
    summary, repaired = C.repair(frame(spark, rows))
    assert [(r.cost, r.audit) for r in summary.collect()] == [(cheapest([(r[2], None) for r in rows])[0], cheapest([(r[2], None) for r in rows])[1])]
    got = sorted(repaired.collect(), key=lambda r: r.place)
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in got)) and repaired.columns == ["conv_id", "place", "turn", "role", "text", "edit"]
