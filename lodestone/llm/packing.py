"""Packing documents into token sequences by cutting-stock column generation.

Documents are tokenised on the executors and cut into pieces of a sequence's capacity and a rest.
The histogram of sizes, lengths rounded up to UNIT, at most `capacity / UNIT` numbers whatever the
input, goes to the driver. There a linear program over patterns (how many pieces of which sizes
make a sequence) is solved by revised simplex; a knapsack by dynamic programming prices new
patterns. Whole parts of the solution are taken as they are, what is left over is filled sequence
by sequence with the subset of pieces that fits best. Pieces are ranked within their size, and
ranks are dealt to patterns.
"""

from __future__ import annotations

import array
import json
import math
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import free_names, giving_back, materialise

CAPACITY = 1024
UNIT = 4  # tokens; sizes in the linear program are whole units
GAP = 2e-3  # of the linear program's value that may be left when pricing stops
MAX_COLUMNS = 2500  # patterns generated at most; the best solution until then is rounded
CACHED = 500_000  # pieces of text whose ids a Python worker remembers; beyond, those used once go
RANGE_ROWS, MAX_RANGES = 1000, 65_536
END = 0  # id put behind each document
SPECIAL = "<|endoftext|>"
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"
# A space before white space or the end belongs to what precedes it; any other space begins a word.
UNCLEAR = re.compile(r" (?:\s|\Z)")


# Of byte-level BPE: the words that merges stay within.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked_encoding(path: str):
    """The same ids from tiktoken, which makes them several times faster, if in the file each merge's
    rank is its token's id, as it is in plain byte-level BPE; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or file.get("normalizer"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    rest = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in file.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """A byte-level BPE file's ids of whole texts.

    White space and what follows it up to the next space are always tokenised alike, so texts are
    cut before each space that precedes a word, and the ids of each distinct piece made once."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = ranked_encoding(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.uses = array.array("I"), array.array("q", [0]), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Drop what was used once; all, if that leaves too much."""
        old, flat, start, uses = self.known, self.flat, self.start, self.uses
        self.clear()
        if (uses > 1).sum() <= CACHED * 3 // 4:
            for piece, i in old.items():
                if uses[i] > 1:
                    self.known[piece] = len(self.known)
                    self.flat.extend(flat[start[i] : start[i + 1]])
                    self.start.append(len(self.flat))
            self.uses = np.ones(len(self.known), np.int64)

    def learn(self, pieces: list[str]) -> None:
        if self.ranked:
            found = map(self.ranked.encode_ordinary, pieces)
        else:
            found = (e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False))
        for piece, ids in zip(pieces, found):
            self.known[piece] = len(self.known)
            self.flat.extend(ids)
            self.start.append(len(self.flat))

    def encode(self, texts) -> list[np.ndarray]:
        if len(self.known) > CACHED:
            self.forget()
        cut = []
        for text in texts:
            text = text or ""
            if UNCLEAR.search(text) or SPECIAL in text:
                cut.append(None)
                continue
            parts = text.split(" ")
            cut.append(parts[:1] * bool(parts[0]) + [" " + x for x in parts[1:]])
        new = list(dict.fromkeys(x for parts in cut if parts for x in parts if x not in self.known))
        if new:
            self.learn(new)
        flat, start = np.array(self.flat, dtype=np.uint32), np.array(self.start)
        uses = np.zeros(len(self.known), np.int64)
        uses[: len(self.uses)] = self.uses
        out = []
        for text, parts in zip(texts, cut):
            if parts is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
                continue
            i = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
            uses[i] += 1
            begin, size = start[i], start[i + 1] - start[i]
            shift = np.repeat(begin - (np.cumsum(size) - size), size)
            out.append(flat[shift + np.arange(len(shift))])
        self.uses = uses
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Python worker's own, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of a document's pieces. Of a document that must be cut, a rest of over half a
    sequence is halved, as long rests find few partners; one that fits stays whole."""
    ends = [*range(capacity, n, capacity), n]
    if n > capacity and n - ends[-2] > capacity // 2:
        ends.insert(-1, (n + ends[-2]) // 2)
    return list(zip([0, *ends], ends))


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, start, length, ids_crc32 and doc_tokens of each piece: every document's
    ids and END, cut as by cuts(). Null text: as empty, of END alone."""
    docs = documents.select(*carry, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                pdf = whole.iloc[at : at + 1024].reset_index(drop=True)
                rows = []
                for k, ids in enumerate(encoder(tokenizer).encode(list(pdf["text"]))):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for s, e in cuts(len(ids), capacity):
                        part = ids[s:e]
                        rows.append((k, s, len(part), zlib.crc32(part.tobytes()), len(ids)))
                k, *rest = np.array(rows, dtype=np.int64).reshape(-1, 5).T
                out = pdf[list(carry)].iloc[k].reset_index(drop=True)
                yield out.assign(**dict(zip(("start", "length", "ids_crc32", "doc_tokens"), rest)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("text").schema)
    return docs.mapInPandas(giving_back(run), f"{schema}, {PIECES}")


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most value, and how many of each of the rising lengths give it, repeats allowed."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            v = best[c - lengths[:k]] + values[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], choice[c] = v[i], i
    counts, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= lengths[choice[c]]
    return best[capacity], counts


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of patterns and how often each is used, fractions allowed, so that their pieces are
    the demand exactly and sequences few."""
    columns = np.diag(np.floor(capacity / lengths))
    inverse = np.diag(1 / np.diag(columns))
    x = demand / np.diag(columns)
    # Prices swing from step to step; so patterns are priced between the program's own prices and
    # the best ones known that no pattern beats, at first the lengths themselves.
    centre = lengths / capacity
    bound = centre @ demand
    for _ in range(MAX_COLUMNS):
        own = inverse.sum(axis=0)
        if own @ demand <= bound * (1 + GAP):
            break
        for pull in (0.9, 0.6, 0.0):
            prices = pull * centre + (1 - pull) * own
            value, new = knapsack(lengths, prices, capacity)
            if value > 0 and prices @ demand / value > bound:
                bound, centre = prices @ demand / value, prices / value
            if new @ own > 1 + 1e-7:
                break
        else:
            break
        way = np.einsum("ij,j->i", inverse, new)
        ratio = np.where(way > 1e-9, x / np.maximum(way, 1e-9), np.inf)
        out = int(ratio.argmin())
        take = ratio[out]
        x = np.maximum(x - take * way, 0)
        x[out] = take
        columns[:, out] = new
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    return columns.astype(np.int64), x


def fill(left: Counter, capacity: int) -> Iterator[Counter]:
    """Sequences for the pieces left over: the longest one and, of the others, those that fill up
    the rest best, found as a subset sum over sets of reachable sums kept as bits."""
    left = Counter({k: v for k, v in left.items() if v > 0})
    while left:
        first = max(left)
        gap, mask = capacity - first, (1 << (capacity - first + 1)) - 1
        left[first] -= 1
        sums, steps = 1, []
        for size in sorted((k for k, v in left.items() if v and k <= gap), reverse=True):
            for _ in range(min(left[size], gap // size)):
                more = (sums | sums << size) & mask
                if more == sums:
                    break
                steps.append((size, sums))
                sums = more
            if sums >> gap & 1:
                break
        total, made = sums.bit_length() - 1, Counter([first])
        for size, before in reversed(steps):
            if not before >> total & 1:
                made[size] += 1
                left[size] -= 1
                total -= size
        left = Counter({k: v for k, v in left.items() if v > 0})
        yield made


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}) patterns that use up the histogram exactly."""
    out = [(histogram[capacity], {capacity: 1})] if histogram.get(capacity) else []
    lengths = np.array(sorted(k for k, v in histogram.items() if 0 < k < capacity and v), dtype=np.int64)
    if not len(lengths):
        return out
    demand = np.array([histogram[k] for k in lengths], dtype=np.float64)
    columns, x = solve_patterns(lengths, demand, capacity)
    left = Counter(dict(zip(lengths.tolist(), demand.astype(np.int64).tolist())))
    for p in np.argsort(-x, kind="stable"):
        pattern = {int(lengths[i]): int(columns[i, p]) for i in np.flatnonzero(columns[:, p])}
        times = min([int(x[p] + 1e-6), *(left[k] // v for k, v in pattern.items())])
        if times > 0:
            out.append((times, pattern))
            left.subtract({k: v * times for k, v in pattern.items()})
    return out + [(1, dict(made)) for made in fill(left, capacity)]


def slots(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, lo, hi, each, base, place): pieces of this size with ranks from lo to below hi go,
    `each` to a sequence, to the sequences from base on, behind the sizes of lower place."""
    used, base, out = Counter(), 0, []
    for times, pattern in patterns:
        for place, (size, each) in enumerate(sorted(pattern.items(), reverse=True)):
            lo = used[size]
            used[size] += times * each
            out.append((size, lo, used[size], each, base, place))
        base += times
    return out


def assign(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """cut: materialised pieces with a length. Adds sequence_id and offset: sequences of at most
    `capacity`, a multiple of unit, gapless from 0."""
    names = cut.columns
    n = cut.count()
    ranges = max(1, min(MAX_RANGES, math.ceil(n / RANGE_ROWS)))
    rows = cut.withColumn("__size", F.ceil(F.col("length") / unit)).withColumn("__key", F.xxhash64(*names)).withColumn("__range", F.pmod("__key", F.lit(ranges)))
    counts = rows.groupBy("__size", "__range").count()
    starts = counts.withColumn("__start", F.sum("count").over(W.partitionBy("__size").orderBy("__range")) - F.col("count")).drop("count")
    histogram = {r["__size"]: r.n for r in counts.groupBy("__size").agg(F.sum("count").alias("n")).collect()}  # at most capacity / unit rows
    table = cut.sparkSession.createDataFrame(slots(plan(histogram, capacity // unit)) or [(0, 0, 0, 1, 0, 0)], "s long, lo long, hi long, each long, base long, __place long")
    rank = F.row_number().over(W.partitionBy("__size", "__range").orderBy("__key", *names)) - 1 + F.col("__start")
    ranked = rows.join(starts, ["__size", "__range"]).withColumn("__rank", rank)
    # the table is bounded by capacity and unit, not by rows
    placed = ranked.join(F.broadcast(table), (F.col("__size") == F.col("s")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.expr("(__rank - lo) div each"))
    before = F.sum("length").over(W.partitionBy("sequence_id").orderBy("__place", "__rank").rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    return placed.withColumn("offset", before).select(*names, "sequence_id", "offset")


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Repeated rows are documents of their
    own. An empty table gives no rows.
    """
    return assign(materialise(pieces(documents, tokenizer, capacity)), capacity)
