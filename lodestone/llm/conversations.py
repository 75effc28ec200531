"""Repair of conversations by the cheapest edits, found for many conversations at a time.

A conversation is legal if the initials of its roles read (s?(ua)+)?: nothing, or an optional system turn and then pairs of user and
assistant. What has been read so far is one of four states: START, SYSTEM, USER and PAIR (after an assistant). In a bucket of conversations of
about the same length, the least cost from each state to the end is a tensor of turns x states x conversations; it is filled from the last
turn to the first, one vectorised step for all conversations of the bucket, and the edits are read off from the first to the last, again one
step for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

START, SYSTEM, USER, PAIR = range(4)
NEVER = 1 << 29
#: Costs of edits; an edit's letter is its initial.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Where an emitted user or assistant leads to, by the state before.
NEXT = np.array([USER, USER, PAIR, USER])
EMITS = np.array(["user", "user", "assistant", "user"], dtype=object)
INITIALS = "sua"
LEGAL = ("su", "ua", "au")
BLANK, DUPLICATE, TRUNC = 1, 2, 3
#: Cells of a tensor: a bucket of more is cut by conversations. One conversation is one tensor, whatever its length.
CELLS = 1 << 22


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): each row damaged by the checksum of its `conv_id:turn` modulo 20: 0 drops it (it stays with present
    false, so that its conversation does), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. A null
    anywhere counts as one space; conv_id and turn stay null themselves. Other columns aren't read."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), one_space("role").alias("role"), one_space("text").alias("text"), (F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")


# ---- the tensor --------------------------------------------------------------------------------


def backward(roles: np.ndarray, forced: np.ndarray, extra: np.ndarray, there: np.ndarray) -> np.ndarray:
    """costs[t, state, conversation]: of the cheapest edits of turns t to the last that end legally. All arguments are turns x conversations: the role's
    place in INITIALS (3: none of them), whether it must go, what keeping it adds, and whether there is such a turn."""
    turns, n = roles.shape
    cost = np.empty((turns + 1, 4, n), np.int32)
    cost[turns] = np.array([0, 2 * INSERT, INSERT, 0])[:, None]
    for t in range(turns - 1, -1, -1):
        after, stay = cost[t + 1], np.where(forced[t], NEVER, extra[t])
        here = after + DELETE
        for state in range(4):
            emitted = after[NEXT[state]] + stay
            here[state] = np.minimum(here[state], emitted + REROLE)
            here[state] = np.minimum(here[state], np.where(roles[t] == (2 if state == USER else 1), emitted, NEVER))
        here[START] = np.minimum(here[START], np.where(roles[t] == 0, after[SYSTEM] + stay, NEVER))
        here[USER], here[PAIR] = np.minimum(here[USER], here[PAIR] + INSERT), np.minimum(here[PAIR], here[USER] + INSERT)
        here[START], here[SYSTEM] = np.minimum(here[START], here[USER] + INSERT), np.minimum(here[SYSTEM], here[USER] + INSERT)
        cost[t] = np.where(there[t], here, after)
    return cost


def trace(cost: np.ndarray, roles: np.ndarray, forced: np.ndarray, extra: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest edits, of equal ones those whose letters come first: letters[step, conversation] (0: done), the turn that each edit is of, and
    the state before it. All conversations take a step at a time."""
    n = len(lengths)
    at, state, every = np.zeros(n, int), np.zeros(n, int), np.arange(n)
    letters, turns, states = [], [], []
    wide = lambda a: np.concatenate([a, np.zeros((1, n), a.dtype)])
    roles, forced, extra = wide(roles), wide(forced), wide(extra)
    while True:
        left, inside = cost[at, state, every], at < lengths
        active = inside | (left > 0)
        if not active.any():
            return np.array(letters, np.uint8).reshape(-1, n), np.array(turns, int).reshape(-1, n), np.array(states, int).reshape(-1, n)
        role, to = roles[at, every], NEXT[state]
        stay = np.where(forced[at, every], NEVER, extra[at, every])
        deletes = active & inside & (left == cost[at + 1 - ~inside, state, every] + DELETE)
        inserts = active & ~deletes & (left == cost[at, to, every] + INSERT)
        system = (state == START) & (role == 0)
        fits = system | (role == np.where(state == USER, 2, 1))
        to = np.where(system, SYSTEM, to)
        keeps = active & ~deletes & ~inserts & fits & (left == cost[at + 1 - ~inside, to, every] + stay)
        reroles = active & ~deletes & ~inserts & ~keeps
        letters.append(np.select([deletes, inserts, keeps, reroles], [ord(c) for c in "DIKR"], 0))
        turns.append(at.copy())
        states.append(state.copy())
        to = np.where(keeps, to, NEXT[state])
        state = np.where(inserts | keeps | reroles, to, state)
        at = at + (deletes | keeps | reroles)


def _buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Conversations by length, a bucket for each power of two, in pieces of CELLS at most."""
    size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for s in np.unique(size):
        members = np.flatnonzero(size == s)
        step = max(1, CELLS // (4 * (int(lengths[members].max()) + 1)))
        yield from (members[i : i + step] for i in range(0, len(members), step))


# ---- conversations in tasks --------------------------------------------------------------------


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key as tables that end where a key does; a conversation is held at most."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        codes = b.column("key").dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.diff(codes)) + 1
        if held and b.column("key")[0].as_py() != last:
            yield pa.Table.from_batches(held)
            held = []
        if len(starts):
            yield pa.Table.from_batches([*held, b.slice(0, starts[-1])])
            held = []
        held.append(b.slice(starts[-1] if len(starts) else 0))
        last = b.column("key")[b.num_rows - 1].as_py()
    if held:
        yield pa.Table.from_batches(held)


def _repaired(table: pa.Table) -> dict:
    """The columns of repair_conversations() but for conv_id, of whole conversations in order, and the first row of each in `first`."""
    codes = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    n = len(first)
    present = table.column("present").to_numpy(zero_copy_only=False).astype(bool)
    conv = np.repeat(np.arange(n), np.diff([*first, len(codes)]))[present]
    rows = table.filter(table.column("present"))
    role, text = rows.column("role").to_pylist(), rows.column("text").to_pylist()
    initial = np.array([INITIALS.find(r[0]) % 4 if r else 3 for r in role], int)
    seen = pd.DataFrame({"c": conv, "r": rows.column("role").combine_chunks().dictionary_encode().indices.to_numpy(), "t": rows.column("text").combine_chunks().dictionary_encode().indices.to_numpy()}).duplicated().to_numpy()
    fault = np.select([rows.column("blank").to_numpy(zero_copy_only=False), seen, rows.column("cut").to_numpy(zero_copy_only=False)], [BLANK, DUPLICATE, TRUNC], 0)
    count = lambda m: np.bincount(conv[m], minlength=n)
    lengths = np.bincount(conv, minlength=n)
    begin = np.cumsum(lengths) - lengths

    turn, known = rows.column("turn").fill_null(0).to_numpy(), ~rows.column("turn").is_null().to_numpy(zero_copy_only=False)
    spans = pd.DataFrame({"c": conv[known], "t": turn[known]}).groupby("c")["t"].agg(["min", "max", "nunique"])
    gaps = np.zeros(n, np.int64)
    gaps[spans.index.to_numpy()] = (spans["max"] - spans["min"] + 1 - spans["nunique"]).to_numpy()
    legal = np.isin(initial[:-1] * 4 + initial[1:], [INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in LEGAL])
    illegal = np.bincount(conv[1:][(conv[1:] == conv[:-1]) & ~legal], minlength=n)

    cost, audit, repaired = np.zeros(n, np.int64), [""] * n, [[]] * n
    for members in _buckets(lengths):
        size = int(lengths[members].max())
        if not size:
            continue
        there = np.arange(size)[:, None] < lengths[members]
        of = np.where(there, begin[members] + np.arange(size)[:, None], 0)
        roles, forced, extra = initial[of], np.isin(fault[of], (BLANK, DUPLICATE)), np.where(fault[of] == TRUNC, TRUNCATED, 0)
        costs = backward(roles, forced, extra, there)
        letters, turns, states = trace(costs, roles, forced, extra, lengths[members])
        cost[members] = costs[0, START]
        for j, c in enumerate(members):
            steps = np.flatnonzero(letters[:, j])
            audit[c] = letters[steps, j].tobytes().decode()
            out = []
            for edit, t, s in zip(audit[c], turns[steps, j], states[steps, j]):
                i = begin[c] + t
                if edit != "D":
                    out.append({"role": role[i] if edit == "K" else EMITS[s], "text": "" if edit == "I" else text[i]})
            repaired[c] = out
    return {"first": first, "gaps": gaps, "blank": count(fault == BLANK), "duplicate": count(fault == DUPLICATE), "truncated": count(fault == TRUNC), "illegal": illegal, "cost": cost, "audit": audit, "repaired": repaired}


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): a row for each conversation of rows: conv_id, turn, role, text
    and present (where false, the row only tells that there is such a conversation).

    Rows follow each other by turn, nulls first, then by role and text. A row's first fault counts: blank; duplicate of an earlier row's role and
    text; truncated, its last character but blanks being no sentence end. gaps are the turns missing between the first and the last, illegal the
    neighbours whose initials don't follow each other in a legal conversation. repaired has (role, text) after the edits of audit: K keeps a row, R
    gives it the role due, D deletes it, I inserts an empty one. Roles of other initials can't be kept, null roles and texts count as one space.
    Conversations without rows have zeros, an empty audit and nothing repaired; a null conv_id is a conversation of its own. Empty tables give no rows.

    Rows are dealt by conversation and sorted, so that a task holds one conversation, not a partition: an audit and a repaired conversation are a
    value each, which bounds what one can be.
    """
    space = r"[\x20\x09-\x0D]*"
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce("present", F.lit(True)).alias("present"))
    own = own.withColumns({"key": F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))), "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "cut": ~F.col("text").rlike(rf"[.!?]{space}\z")})
    dealt = own.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
    out = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"

    def repair(batches):
        for table in _whole(batches):
            found = _repaired(table)
            ids = table.column("conv_id").combine_chunks().take(pa.array(found.pop("first")))
            columns = [pa.array(v, pa.int64()) if isinstance(v, np.ndarray) else pa.array(v, pa.string() if k == "audit" else pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))) for k, v in found.items()]
            yield from pa.Table.from_arrays([ids, *columns], ["conv_id", *found]).combine_chunks().to_batches()

    schema = StructType([own.schema["conv_id"], *StructType.fromDDL(out).fields])
    return dealt.mapInArrow(repair, schema)
