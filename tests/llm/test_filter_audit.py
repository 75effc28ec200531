"""The filter audit against orders played through document by document."""

import re
from collections import defaultdict
from itertools import permutations

from lodestone.llm import filter_audit

WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def played_through(rows, labels):
    """rows: (doc_id, text, source)."""
    first, by, out = {}, defaultdict(list), {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, s in rows:
        t = t or ""
        w = re.findall(WORD, t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        mine = [x for x in labels if x[0] == i and i is not None]
        by[s or ""].append((fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    for part, docs in by.items():
        shapley, found = defaultdict(int), {}
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, c in enumerate(order, 1):
                gone, left = [d for d in left if d[0][c]], [d for d in left if not d[0][c]]
                shapley[c] += len(gone)
                found[part, order, step] = (c, len(left), len(gone), sum(d[0][c] for d in docs) - len(gone), sum(d[0][c] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
        out |= {k: v[1:] + (shapley[v[0]],) for k, v in found.items()}
    return out


def test_audit_equals_orders_played_through(spark):
    long, mixed = " ".join(f"w{i}" for i in range(60)), "Ab cD " * 40
    rows = [(i, (long + f" z{i % 7}") if i % 3 else mixed, f"s{i % 2}") for i in range(40)]
    rows += [(100 + i, long + " $", "s0") for i in range(30)] + [(100, long + " $", "s0")] * 3  # copies, and a row repeated
    rows += [(200, None, "s1"), (201, "", None), (202, "", None), (None, "", "s0"), (None, long, None), (None, long, None), (203, "x " * 30_000, "s1"), (204, "A\x85B", ""), (-5, long + " z1", "s2")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (100, 1, 1), (203, 1, 0), (None, 1, 1), (999, 1, 1), (120, 1, 0), (120, 1, 0)]
    docs = spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], "doc_id long, text string, source string, part int, mask int, h int").repartition(5)
    got = filter_audit.audit_filters(docs, spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int, n int")).collect()
    want = played_through(rows, labels)
    assert len(got) == len(want) == 4 * 600
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in got} == want


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs, labels).collect() == []
    one = filter_audit.audit_filters(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert len(one) == 600 and {(r.part, r.kept, r.removed) for r in one if r.step == 1} == {("", 0, 1), ("", 1, 0)}


def test_survivors_invert_joint_failures(spark):
    """Counts made from known masks come back."""
    masks = [(m, (7 * m) % 11) for m in range(32)]
    sums = filter_audit.joint_failures(spark.createDataFrame([("p", m, 0, 0, n) for m, n in masks], "part string, mask int, good int, toxic int, n long"))
    left = sums.select(filter_audit.survivors(sums.failing).alias("left")).first().left
    assert left == [sum(n for m, n in masks if not m & s) for s in range(32)]
