"""Repaired conversations against all edits written out, and a recursion over long ones."""

import random
import re
import zlib
from functools import cache
from itertools import product

import numpy as np

from lodestone.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile("(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        last = text.rstrip(SPACE)
        out.append("b" if not last else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def one_row_edits(row, fault):
    """(letter, cost, emitted) of each way to treat a row."""
    yield "D", 4, None
    if fault not in ("b", "d"):
        more = 3 * (fault == "t")
        yield "K", more, row
        yield from (("R", 3 + more, (role, row[1])) for role in ("user", "assistant"))


def by_all_edits(rows):
    """Least (cost, audit) of every string of edits with up to two insertions in a gap."""
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = None
    ways = [list(one_row_edits(r, f)) for r, f in zip(rows, faults(rows))]
    for chosen in product(*ways):
        for added in product(gaps, repeat=len(rows) + 1):
            out, audit, cost = [], "", 0
            for i, names in enumerate(added):
                out += [(n, "") for n in names]
                audit, cost = audit + "I" * len(names), cost + 3 * len(names)
                if i < len(rows):
                    letter, c, emitted = chosen[i]
                    audit, cost = audit + letter, cost + c
                    out += [emitted] if emitted else []
            if (best is None or (cost, audit) <= best[:2]) and LEGAL.fullmatch("".join(r[0][:1] or "-" for r in out)):
                best = (cost, audit, out)
    return best


def by_recursion(rows):
    fault = faults(rows)

    @cache
    def best(i, state, inserted):
        """Least (cost, audit) from row i on; state: what has been emitted last, '' for nothing."""
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        due = "a" if state == "u" else "u"
        if inserted < 2:
            c, e = best(i, due, inserted + 1)
            found.append((c + 3, "I" + e))
        if i < len(rows):
            for letter, cost, emitted in one_row_edits(rows[i], fault[i]):
                initial = emitted[0][:1] if emitted else None
                if emitted is None or initial == due or (initial == "s" and state == ""):
                    c, e = best(i + 1, state if emitted is None else initial, 0)
                    found.append((c + cost, letter + e))
        return min(found, default=(1 << 40, ""))

    return best(0, "", 0)


def repaired_of(rows, audit):
    out, i, state = [], 0, ""
    for letter in audit:
        due = "assistant" if state == "u" else "user"
        if letter != "D":
            out.append((rows[i][0], rows[i][1]) if letter == "K" else (due, "" if letter == "I" else rows[i][1]))
            state = out[-1][0][:1]
        i += letter != "I"
    return out


def repaired(spark, convs, extra=()):
    rows = [(i, t, role, text, True, "x", 0) for i, c in convs.items() for t, (role, text) in enumerate(c)] + list(extra)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean, key string, blank int").repartition(7)
    return {r.conv_id: r for r in C.repair_conversations(df).collect()}


ROLES, TEXTS = ["user", "assistant", "system", "tool", " ", "assistant", "user"], ["Yes.", "no", "", " \n", "Ok! \n", "Yes.", "\x85", "Why?"]


def test_short_conversations_against_all_edits(spark):
    g = random.Random(1)
    convs = {i: [(g.choice(ROLES), g.choice(TEXTS)) for _ in range(g.randint(1, 3))] for i in range(60)}
    got = repaired(spark, convs)
    assert len(got) == 60
    for i, rows in convs.items():
        cost, audit, out = by_all_edits(rows)
        assert (got[i].cost, got[i].audit, [tuple(r) for r in got[i].repaired]) == (cost, audit, out), rows


def test_longer_conversations_against_recursion(spark):
    g = random.Random(2)
    convs = {i: [(g.choice(ROLES), g.choice(TEXTS) + str(g.randrange(3)) * g.randrange(2) + "." * g.randrange(2)) for _ in range(g.randint(1, 40))] for i in range(300)}
    got = repaired(spark, convs)
    for i, rows in convs.items():
        f = faults(rows)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
        cost, audit = by_recursion(tuple(rows))
        assert (got[i].cost, got[i].audit) == (cost, audit)
        assert [tuple(r) for r in got[i].repaired] == repaired_of(rows, audit)
        assert (got[i].blank, got[i].duplicate, got[i].truncated, got[i].illegal, got[i].gaps) == (f.count("b"), f.count("d"), f.count("t"), sum(p not in C.LEGAL for p in pairs), 0)


def test_nulls_ties_and_conversations_without_rows(spark):
    rows = [(1, None, "user", None, True, "", 0), (1, 5, None, "a.", True, "", 0), (1, 9, "assistant", "b.", True, "", 0), (2, 3, "user", "x", False, "", 0), (None, 1, "user", "A?", True, "", 0), (None, 2, "assistant", "B.", True, "", 0)]
    rows += [(3, None, "user", "A?", True, "", 0), (3, None, "assistant", "B.", True, "", 0), (4, 7, "user", "A?", True, "", 0), (4, 7, "user", "A?", True, "", 0), (4, 7, "assistant", "B.", True, "", 0)]
    got = repaired(spark, {}, rows)
    assert set(got) == {1, 2, 3, 4, None}
    assert (got[1].gaps, got[1].blank, got[1].audit, [tuple(r) for r in got[1].repaired]) == (3, 1, "DRK", [("user", "a."), ("assistant", "b.")])
    assert (got[2].gaps, got[2].cost, got[2].audit, got[2].repaired) == (0, 0, "", [])
    assert (got[None].cost, got[None].audit) == (0, "KK")
    assert (got[3].gaps, got[3].audit) == (0, "IKKI")  # without turns the assistant's row comes first, and I before R
    assert (got[4].duplicate, got[4].audit) == (1, "IKKDI")


def test_a_long_conversation_across_batches(spark):
    rows = [("assistant" if i % 3 == 1 else "user", f"{i}." + "x" * (i % 50 == 7)) for i in range(25_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "999")
    try:
        got = repaired(spark, {1: rows[:10], 2: rows, 3: rows[:11]})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i].cost for i in (1, 3)] == [by_recursion(tuple(rows[: 9 + i - (i == 3)]))[0] for i in (1, 3)]
    assert LEGAL.fullmatch("".join(r.role[0] for r in got[2].repaired)) and got[2].audit.replace("I", "").__len__() == len(rows)


def test_tensor_pads_shorter_conversations():
    roles = np.array([[1, 1], [2, 3]])
    there = np.array([[True, True], [True, False]])
    costs = C.backward(roles, np.zeros((2, 2), bool), np.zeros((2, 2), int), there)
    assert costs[0, C.START].tolist() == [0, 3]


def test_damage(spark):
    rows = [(c, t, r, "A. b! c?") for c in range(40) for t, r in enumerate(["system", "user", None])] + [(None, None, "user", None), (None, 3, "user", "A."), (7, None, "user", "A.")]
    got = {}
    for r in C.damage(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, k int")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.present))
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = [(role, "", False)] if k == 0 else [("user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text, True)] * (1 + (k == 3))
        assert got[c, t] == want


def test_empty_table(spark):
    assert C.repair_conversations(C.damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
