"""Language-model scoring by a probabilistic suffix tree over words.

A context is the last one to DEPTH words before a token; it is admitted if it occurs LEAST times in
the training documents, or a quarter of the root of their number of tokens if that is more, so that more
text gives more and longer contexts, and each more occurrences to be judged by. An admitted context becomes a state if its next-word distribution diverges from its parent's, that of
the context one word shorter: if, each occurrence left out in turn, the distribution smoothed with
the best of the weights SMOOTHS makes its own successors likelier than the parent's does. Each token
is scored in the longest state that ends before it, smoothed by the shorter ones down to the
distribution of single tokens.

Counts are exact and cover all training documents, whatever the partitions:

1. documents are tokenised into blocks, a row each; texts aren't read again;
2. blocks send counts of their distinct tokens, cut by hash into parts, and get the sums back;
3. contexts are counted depth by depth; only those are candidates whose two shorter parts were
   admitted, which blocks look up in a Bloom filter of bounded size. A false hit is a candidate more;
4. blocks send counts of distinct (context, token) pairs, cut by the context's last word, so that all
   that a pair's probability needs is in one part. Words, and pairs of words, that make up more than a
   part's share are salted. Parts give the test's sums by context;
5. with what was kept, parts give the probabilities back to the blocks that asked.

What is held at once is a block or a part, both of bounded size; the driver holds the filter, the salted
words and pairs (fewer than parts) and totals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bit_filter, forget, giving_back, id_bucket, in_filter, materialise, words_of

HELD = (10, 0)
DEPTH = 4  # words of the longest context
LEAST, ROOTS = 20, 0.25  # occurrences that a context has at least: LEAST, or ROOTS times the root of the training tokens
SMOOTHS = (2.0, 16.0, 128.0, 1024.0)  # weights of the shorter context's distribution to choose from
PARENT = 64.0  # that weight for the parent's distribution in the test
BASE = 0.1
BLOCK_BYTES = 3 << 20
PART_BYTES = 32 << 20  # of text for each part
MAX_PARTS = 1 << 20
FILTER_BITS = (12, 26)  # log2 of the filter's size at least and at most
UNITS = 65536.0  # gains are added as whole numbers of nats / UNITS, so that their order doesn't matter
END = 0  # hash of the token behind each document

BLOCK = "block long, doc_id array<string>, held binary, sizes binary, words binary, counts binary, tokens binary, train long, bytes long"
CONTEXT = "state long, before long, last long, n long"
SCORES = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_in_state long"


def pack(a: np.ndarray) -> bytes:
    """An array compressed, its bytes by significance, which suits numbers that are small or sorted."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes)


def unpack(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).ravel()


def mix(a: np.ndarray, b) -> np.ndarray:
    """64-bit hash of pairs."""
    b = np.atleast_1d(np.asarray(b, np.uint64))
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def find(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in sorted known, and whether each is there."""
    if not len(known):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return at, known[at] == x


@dataclass
class Corpus:
    """What all tasks know."""

    parts: int
    total: int  # training tokens
    least: int  # occurrences that a context has at least
    distinct: int = 0
    filters: list[np.ndarray] = field(default_factory=list)  # bits of contexts of two words, three ...
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # salted words, sorted
    word_salts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # salted pairs of words, as context of two
    pair_last: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # the pair's first word
    pair_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def base(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return (counts + BASE) / (self.total + BASE * (self.distinct + 1))

    def salts(self, counts) -> np.ndarray:
        """Into how many parts something that occurs so often is cut."""
        return np.maximum(1, -(-np.asarray(counts, np.float64) * self.parts // max(1, self.total))).astype(np.uint64)

    def pair_part(self, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (mix(self.pairs[at], salt + np.uint64(1)) % np.uint64(self.parts)).astype(np.int64)

    def part(self, last: np.ndarray, token: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where pairs of a token and contexts of the last word, and of the word before, are added up."""
        key = mix(last, 0)
        at, hot = find(self.words, last)
        if hot.any():
            key[hot] = mix(last[hot], np.uint64(1) + mix(token[hot], 1) % self.word_salts[at[hot]])
        out = (key % np.uint64(self.parts)).astype(np.int64)
        at, hot = find(self.pairs, mix(token, last))
        if hot.any():
            at = at[hot]
            out[hot] = self.pair_part(at, mix(before[hot], 2) % self.salts(self.pair_counts[at]))
        return out

    def parts_of(self, last: np.ndarray, before: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of context, part): all parts where pairs of these contexts of a depth are added up."""
        at, hot = find(self.words, last)
        who, where = [np.flatnonzero(~hot)], [(mix(last[~hot], 0) % np.uint64(self.parts)).astype(np.int64)]
        i = np.flatnonzero(hot)
        k = self.word_salts[at[i]].astype(np.int64)
        salt = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        i = np.repeat(i, k)
        who.append(i)
        where.append((mix(last[i], np.uint64(1) + salt.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64))
        order = np.argsort(self.pair_last)
        lo, hi = (np.searchsorted(self.pair_last[order], last, side=x) for x in ("left", "right"))
        i = np.repeat(np.arange(len(last)), hi - lo)
        p = order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]
        k = self.salts(self.pair_counts[p])
        if depth > 1:
            salt = mix(before[i], 2) % k
        else:
            k = k.astype(np.int64)
            salt = (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)).astype(np.uint64)
            i, p = np.repeat(i, k), np.repeat(p, k)
        who.append(i)
        where.append(self.pair_part(p, salt))
        who, where = np.concatenate(who), np.concatenate(where)
        _, first = np.unique(who * self.parts + where, return_index=True)
        return who[first], where[first]

    def may_be(self, depth: int, grams: np.ndarray) -> np.ndarray:
        return in_filter(self.filters[depth - 2], grams)


# ---- blocks ------------------------------------------------------------------------------------


def block_row(ident: int, docs: list[tuple]) -> dict:
    ids: dict[bytes, int] = {}
    parts, sizes = [], []
    for _, text, _ in docs:
        words = words_of(text)
        parts.append(np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.uint32, len(words)))
        parts.append(np.zeros(1, np.uint32))
        sizes.append(len(words) + 1)
    hashes = np.concatenate([np.array([END], np.uint64), np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in ids), np.uint64, len(ids))])
    tokens = np.concatenate(parts)
    order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")  # small numbers for common ones
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    held = np.array([h for *_, h in docs], np.uint8)
    sizes = np.array(sizes, np.uint64)
    return {
        "block": ident, "doc_id": [d for d, *_ in docs], "held": held.tobytes(), "sizes": pack(sizes), "words": hashes[order].tobytes(),
        "counts": pack(np.zeros(0, np.int64)), "tokens": pack(rank[tokens]), "train": int(sizes[held == 0].sum()), "bytes": sum(len(t) for _, t, _ in docs if t),
    }


def blocks_of(size_of_block: int):
    """Documents in the order they come, cut into blocks of about that many characters; a longer text is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ident, docs, size = TaskContext.get().partitionId() << 32, [], 0
        for pdf in batches:
            for doc in zip(pdf["doc_id"], pdf["text"], pdf["held_out"]):
                docs.append(doc)
                size += len(doc[1] or "")
                if size >= size_of_block:
                    yield pd.DataFrame([block_row(ident, docs)])
                    ident, docs, size = ident + 1, [], 0
        if docs:
            yield pd.DataFrame([block_row(ident, docs)])

    return run


class Block:
    """words: hashes of the distinct tokens, numbers once counted; counts: theirs; tokens: places of them."""

    def __init__(self, row) -> None:
        self.ident, self.row = row.block, row
        self.sizes = unpack(row.sizes, "<u8").astype(np.int64)
        self.words, self.counts = np.frombuffer(row.words, "<u8"), unpack(row.counts, "<i8")
        self.tokens = unpack(row.tokens, "<u4").astype(np.int64)
        self.held = np.frombuffer(row.held, np.uint8) == 1
        self.train = np.repeat(~self.held, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)

    def by_part(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct tokens in order of their part, and where each part begins."""
        part = self.words % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1))

    def grams(self, corpus: Corpus, depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By number of words: hashes of the runs that end at each token, and which may be contexts;
        the longest ones are candidates, not looked up unless there is a filter."""
        word = self.words[self.tokens]
        out, may = [word], [self.counts[self.tokens] >= corpus.least]
        for d in range(2, depth + 1):
            g, ok = np.zeros(len(word), np.uint64), np.zeros(len(word), bool)
            g[d - 1 :] = mix(out[-1][d - 1 :], word[: max(0, len(word) - d + 1)])
            ok[1:] = may[-1][1:] & may[-1][:-1] & (self.place[1:] >= d - 1)
            if d - 2 < len(corpus.filters):
                at = np.flatnonzero(ok)
                ok[at] = corpus.may_be(d, g[at])
            out.append(g)
            may.append(ok)
        return out, may


@dataclass
class Entries:
    """A block's distinct pairs of context and token by depth, in order of their part."""

    at: np.ndarray  # tokens that have a context
    leaf: np.ndarray  # of these: (depth, entry) of the longest one, as depth * 2^40 + entry
    part: list[np.ndarray]
    state: list[np.ndarray]
    token: list[np.ndarray]
    n: list[np.ndarray]
    parent: list[np.ndarray]  # entry of the depth before
    is_leaf: list[np.ndarray]


def entries_of(b: Block, corpus: Corpus) -> Entries:
    grams, may = b.grams(corpus, 1 + len(corpus.filters))
    at = np.flatnonzero(b.place >= 1)
    at = at[may[0][at - 1]]
    tok = b.tokens[at]
    before = np.where(b.place[at] >= 2, b.words[b.tokens[np.maximum(at - 2, 0)]], np.uint64(0))
    part = corpus.part(b.words[b.tokens[at - 1]], b.words[tok], before)
    e = Entries(at, np.full(len(at), -1, np.int64), [], [], [], [], [], [])
    which = np.full(len(at), -1, np.int64)
    for d, (g, ok) in enumerate(zip(grams, may)):
        sel = np.flatnonzero(ok[at - 1])
        state = g[at[sel] - 1]
        distinct, inverse = np.unique(state, return_inverse=True)
        code = (part[sel] * max(1, len(distinct)) + inverse) * len(b.words) + tok[sel]
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        e.part.append(part[sel][first])
        e.state.append(state[first])
        e.token.append(tok[sel][first])
        e.n.append(np.bincount(inverse, weights=b.train[at[sel]], minlength=len(first)).astype(np.int64))
        e.parent.append(which[sel][first])
        which = np.full(len(at), -1, np.int64)
        which[sel] = inverse
        e.leaf[sel] = (d << 40) + inverse
    for d in range(len(grams)):
        flag = np.zeros(len(e.n[d]), bool)
        flag[e.leaf[e.leaf >> 40 == d] & ((1 << 40) - 1)] = True
        e.is_leaf.append(flag)
    return e


# ---- the exchanges -----------------------------------------------------------------------------


SALTED, ADMITTED = -1, -2  # rows for no block


def _counted(blocks: DataFrame, parts: int, total: int, least: int) -> tuple[DataFrame, Corpus, DataFrame]:
    """Blocks with the tokens' numbers and counts over all training documents; the corpus; and the
    words that are contexts."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in map(Block, pdf.itertuples()):
                n = np.bincount(b.tokens[b.train], minlength=len(b.words))
                order, cut = b.by_part(parts)
                rows = [(p, b.ident, b.words[order[x:y]].tobytes(), pack(n[order[x:y]])) for p, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                yield pd.DataFrame(rows, columns=["part", "block", "words", "n"])

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        words = np.frombuffer(b"".join(pdf["words"]), "<u8")
        distinct, at = np.unique(words, return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, at, np.concatenate([unpack(x, "<i8") for x in pdf["n"]]))
        number = np.arange(len(distinct), dtype=np.uint64) * np.uint64(parts) + np.uint64(key[0] + 1)
        ends = np.cumsum([len(x) // 8 for x in pdf["words"]])
        starts = np.concatenate([[0], ends[:-1]])
        rows = [(block, key[0], pack(number[at[x:y]]), pack(sums[at[x:y]]), 0) for block, x, y in zip(pdf["block"], starts, ends)]
        for kind, some in ((SALTED, sums > total / parts), (ADMITTED, sums >= least)):
            rows.append((kind, key[0], number[some].tobytes(), sums[some].tobytes(), int((sums > 0).sum())))
        return pd.DataFrame(rows, columns=["block", "part", "words", "counts", "distinct"])

    sent = blocks.mapInPandas(send, "part int, block long, words binary, n binary")
    back = materialise(sent.groupBy("part").applyInPandas(add, "block long, part int, words binary, counts binary, distinct long"))
    corpus = Corpus(parts, total, least)
    hot = []
    for r in back.where(F.col("block") == SALTED).select("distinct", "words", "counts").toLocalIterator():  # a row for each part, fewer salted words than parts
        corpus.distinct += r.distinct
        hot += zip(np.frombuffer(r.words, "<u8"), np.frombuffer(r.counts, "<i8"))
    hot.sort()
    corpus.words = np.array([w for w, _ in hot], np.uint64)
    corpus.word_salts = corpus.salts([n for _, n in hot])

    def fill(key, pdf: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pdf
        order, _ = Block(next(pdf.itertuples())).by_part(parts)
        sums = sums.sort_values("part")
        words, counts = np.empty(len(order), np.uint64), np.empty(len(order), np.int64)
        words[order] = np.concatenate([unpack(x, "<u8") for x in sums["words"]])
        counts[order] = np.concatenate([unpack(x, "<i8") for x in sums["counts"]])
        return pdf.assign(words=[words.tobytes()], counts=[pack(counts)])

    filled = blocks.groupBy("block").cogroup(back.where("block >= 0").select("block", "part", "words", "counts").groupBy("block")).applyInPandas(fill, BLOCK)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, n in zip(pdf["words"], pdf["counts"]):
                w = np.frombuffer(w, "<i8")
                yield pd.DataFrame({"state": w, "before": 0, "last": w, "n": np.frombuffer(n, "<i8")})

    admitted = materialise(back.where(F.col("block") == ADMITTED).select("words", "counts").mapInPandas(words, CONTEXT))
    filled = materialise(filled)
    forget(back)
    return filled, corpus, admitted


def _contexts(blocks: DataFrame, corpus: Corpus, words: DataFrame) -> list[DataFrame]:
    """The admitted contexts by depth, words first; sets the corpus's filters and salted pairs."""
    spark, found, least = blocks.sparkSession, [words], corpus.least
    for depth in range(2, DEPTH + 1):
        shared = spark.sparkContext.broadcast(corpus)

        def send(batches: Iterator[pd.DataFrame], depth: int = depth, shared=shared) -> Iterator[pd.DataFrame]:
            corpus = shared.value
            for pdf in batches:
                for b in map(Block, pdf.itertuples()):
                    grams, may = b.grams(corpus, depth)
                    at = np.flatnonzero(may[-1] & b.train)
                    state, first, n = np.unique(grams[-1][at], return_index=True, return_counts=True)
                    at = at[first]
                    part = (state % np.uint64(corpus.parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    state, n, before, last = state[order], n[order], b.words[b.tokens[at[order] - 1]], b.words[b.tokens[at[order]]]
                    cut = np.searchsorted(part[order], np.arange(corpus.parts + 1))
                    rows = [(p, pack(state[x:y]), pack(before[x:y]), pack(last[x:y]), pack(n[x:y])) for p, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                    yield pd.DataFrame(rows, columns=["part", "state", "before", "last", "n"])

        def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
            state, before, last, n = (np.concatenate([unpack(x, "<i8") for x in pdf[c]]) for c in ("state", "before", "last", "n"))
            distinct, first, inverse = np.unique(state, return_index=True, return_inverse=True)
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, inverse, n)
            some = sums >= least
            return pd.DataFrame({"state": distinct[some], "before": before[first[some]], "last": last[first[some]], "n": sums[some]})

        sent = blocks.mapInPandas(send, "part int, state binary, before binary, last binary, n binary")
        level = materialise(sent.groupBy("part").applyInPandas(add, CONTEXT))
        n = level.count()
        if not n:
            break
        corpus.filters = [*corpus.filters, bit_filter(level.select(F.col("state").alias("k")), n, FILTER_BITS)]
        if depth == 2:  # pairs that make up more than a part's share, fewer than parts
            hot = sorted((r.state & ((1 << 64) - 1), r.before, r.n) for r in level.where(F.col("n") * corpus.parts > corpus.total).collect())
            corpus.pairs = np.array([s for s, *_ in hot], np.uint64)
            corpus.pair_last = np.array([w for _, w, _ in hot], np.int64).view(np.uint64)
            corpus.pair_counts = np.array([k for *_, k in hot], np.int64)
        found.append(level)
    return found


def _sizes(levels: list[DataFrame], corpus: Corpus) -> DataFrame:
    """(part, state, size) of the contexts, in each part that may ask."""
    shared = levels[0].sparkSession.sparkContext.broadcast(corpus)

    def deal(depth: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                who, part = shared.value.parts_of(pdf["last"].to_numpy(np.int64).view(np.uint64), pdf["before"].to_numpy(np.int64).view(np.uint64), depth)
                yield pd.DataFrame({"part": part, "state": pdf["state"].to_numpy()[who], "size": pdf["n"].to_numpy()[who]})

        return run

    dealt = [level.mapInPandas(deal(d), "part int, state long, size long") for d, level in enumerate(levels, 1)]
    out = dealt[0]
    for d in dealt[1:]:
        out = out.unionByName(d)
    return out


SENT = ["counts", "state", "token", "n", "parent", "base", "leaf"]
TESTED = ["part", "block", "state", *(f"g{i}" for i in range(len(SMOOTHS))), "depths", "states", "n", "sizes", "parent", "base"]


def _send(blocks: DataFrame, shared) -> DataFrame:
    """What each block has to tell each part: (part, block, then the arrays of SENT, depth after depth)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus = shared.value
        for pdf in batches:
            for b in map(Block, pdf.itertuples()):
                e = entries_of(b, corpus)
                if not len(e.at):
                    continue
                parts = np.unique(e.part[0])
                lo = [np.searchsorted(p, parts) for p in e.part]
                hi = [np.searchsorted(p, parts, side="right") for p in e.part]
                rows = []
                for i, p in enumerate(parts):
                    cut = [slice(x[i], y[i]) for x, y in zip(lo, hi)]
                    join = lambda arrays: np.concatenate([a[c] for a, c in zip(arrays, cut)])  # noqa: B023, E731
                    parent = np.concatenate([e.parent[d][c] - (lo[d - 1][i] if d else 0) for d, c in enumerate(cut)])
                    token = e.token[0][cut[0]]
                    counts = np.array([c.stop - c.start for c in cut], "<i8")
                    rows.append((p, b.ident, counts.tobytes(), pack(join(e.state)), pack(b.words[join(e.token)]), pack(join(e.n)), pack(parent.astype("<i4")), pack(b.counts[token]), join(e.is_leaf).tobytes()))
                yield pd.DataFrame(rows, columns=["part", "block", *SENT])

    return blocks.mapInPandas(giving_back(run), "part int, block long, " + ", ".join(f"{c} binary" for c in SENT))


def _test(sent: DataFrame, sizes: DataFrame, shared) -> DataFrame:
    """Rows of three kinds: a part's pairs added up (block -1), the pairs each block asked for (as places of
    these), and by part and context the gain of each smoothing (block -2)."""

    def run(key, pdf: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        corpus, part = shared.value, key[0]
        if not len(pdf):
            return pd.DataFrame(columns=TESTED)
        counts = np.stack([np.frombuffer(x, "<i8") for x in pdf["counts"]])
        depths = counts.shape[1]
        state, token, n, parent = (np.concatenate([unpack(x, kind) for x in pdf[c]]) for c, kind in (("state", "<u8"), ("token", "<u8"), ("n", "<i8"), ("parent", "<i4")))
        base, leaf = np.concatenate([unpack(x, "<i8") for x in pdf["base"]]), np.frombuffer(b"".join(pdf["leaf"]), bool)
        begin = (np.cumsum(counts.ravel()) - counts.ravel()).reshape(counts.shape)
        depth = np.repeat(np.tile(np.arange(depths), len(counts)), counts.ravel())
        row = np.repeat(np.arange(len(counts)), counts.sum(axis=1))
        known_state, known_size = sizes["state"].to_numpy(np.int64).view(np.uint64), sizes["size"].to_numpy(np.int64)
        order = np.argsort(known_state)
        known_state, known_size = known_state[order], known_size[order]

        own = np.zeros(len(state), np.int64)
        all_states, all_n, all_sizes, all_parents, all_gains, q, offset = [], [], [], [], [], np.zeros(0), 0
        firsts = None
        for d in range(depths):
            at = np.flatnonzero(depth == d)
            _, si = np.unique(state[at], return_inverse=True)
            tokens, ti = np.unique(token[at], return_inverse=True)
            _, first, inverse = np.unique(si * max(1, len(tokens)) + ti, return_index=True, return_inverse=True)
            own[at] = inverse + offset
            sums = np.zeros(len(first), np.int64)
            np.add.at(sums, inverse, n[at])
            here, s = sums.copy(), state[at][first]
            if d == 0:
                up = np.full(len(first), -1)
                firsts = base[first]
                before = corpus.base(firsts)
                place, hot = find(corpus.pairs, mix(token[at][first], s))
                sums[hot] = corpus.pair_counts[place[hot]]  # of salted pairs a part has a share
            else:
                i = at[first]
                up = own[begin[row[i], d - 1] + parent[i]]
                before = q[up]
            place, there = find(known_state, s)
            size = np.where(there, known_size[place] if len(known_size) else 0, 0)
            live = there & (here > 0)
            gains = np.zeros((len(SMOOTHS), len(first)), np.int64)
            for k, w in enumerate(SMOOTHS):
                better = np.log(sums[live] - 1 + w * before[live]) - np.log(size[live] - 1 + w) - np.log(before[live])
                gains[k, live] = here[live] * np.rint(better * UNITS).astype(np.int64)
            q = np.concatenate([q, np.where(there, (sums + PARENT * before) / (size + PARENT), before)])
            for store, x in ((all_states, s), (all_n, sums), (all_sizes, size), (all_parents, up), (all_gains, gains)):
                store.append(x)
            offset += len(first)
        states, sums, size = np.concatenate(all_states), np.concatenate(all_n), np.concatenate(all_sizes)
        arrays = (np.array([len(x) for x in all_n], "<i8").tobytes(), pack(states), pack(sums), pack(size), pack(np.concatenate(all_parents).astype("<i4")), pack(firsts))
        none = (None,) * (len(SMOOTHS) + 1)
        rows = [(part, -1, *none, *arrays)]
        edge = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
        for block, x, y in zip(pdf["block"], edge, edge[1:]):
            rows.append((part, block, *none, b"", b"", pack(own[x:y][leaf[x:y]].astype("<i4")), b"", b"", b""))
        out = [pd.DataFrame(rows, columns=TESTED)]
        contexts, inverse = np.unique(states[size > 0], return_inverse=True)
        gains = np.zeros((len(contexts), len(SMOOTHS)), np.int64)
        np.add.at(gains, inverse, np.concatenate(all_gains, axis=1).T[size > 0])
        stats = pd.DataFrame(gains, columns=[f"g{i}" for i in range(len(SMOOTHS))]).assign(part=part, block=-2, state=contexts.view(np.int64))
        out.append(stats)
        return pd.concat(out)[TESTED].astype({c: "Int64" for c in TESTED[1 : 3 + len(SMOOTHS)]})

    kinds = [f"{c} {'binary' if c in TESTED[-6:] else 'int' if c == 'part' else 'long'}" for c in TESTED]
    return sent.groupBy("part").cogroup(sizes.groupBy("part")).applyInPandas(run, ", ".join(kinds))


def _kept(tested: DataFrame) -> DataFrame:
    """(part, state, smooth) of the states: contexts whose best gain over all parts is above 0."""
    stats = tested.where("block = -2")
    gains = [f"g{i}" for i in range(len(SMOOTHS))]
    sums = stats.groupBy("state").agg(*(F.sum(g).alias(g) for g in gains))
    best = F.greatest(*gains)
    smooth = F.coalesce(*(F.when(F.col(g) == best, F.lit(w)) for g, w in zip(gains, SMOOTHS)))
    return stats.select("part", "state").join(sums.where(best > 0).select("state", smooth.alias("smooth")), "state").select("part", "state", "smooth")


def _answer(tested: DataFrame, kept: DataFrame, shared) -> DataFrame:
    """(block, part, inside, p): whether each pair that a block asked for is in a state, and if so its probability."""

    def run(key, pdf: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        corpus = shared.value
        whole, asked = pdf[pdf["block"] == -1], pdf[pdf["block"] >= 0]
        if not len(whole):
            return pd.DataFrame(columns=["block", "part", "inside", "p"])
        r = next(whole.itertuples())
        depths = np.frombuffer(r.depths, "<i8")
        states, n, size, parent = unpack(r.states, "<u8"), unpack(r.n, "<i8"), unpack(r.sizes, "<i8"), unpack(r.parent, "<i4")
        order = np.argsort(kept["state"].to_numpy(np.int64).view(np.uint64)) if len(kept) else np.zeros(0, np.int64)
        known = kept["state"].to_numpy(np.int64).view(np.uint64)[order] if len(kept) else np.zeros(0, np.uint64)
        weight = kept["smooth"].to_numpy(np.float64)[order] if len(kept) else np.zeros(0)
        place, use = find(known, states)
        w = np.where(use, weight[place] if len(weight) else 0, 1.0)
        p, inside = np.zeros(len(n)), np.zeros(len(n), bool)
        end = 0
        for d, k in enumerate(depths):
            i = slice(end, end + k)
            end += k
            before = p[parent[i]] if d else corpus.base(unpack(r.base, "<i8"))
            p[i] = np.where(use[i], (n[i] + w[i] * before) / (size[i] + w[i]), before)
            inside[i] = use[i] | (inside[parent[i]] if d else False)
        rows = []
        for block, which in zip(asked["block"], asked["n"]):
            which = unpack(which, "<i4")
            rows.append((block, key[0], np.packbits(inside[which]).tobytes(), pack(p[which[inside[which]]])))
        return pd.DataFrame(rows, columns=["block", "part", "inside", "p"])

    rows = tested.where("block >= -1").select("part", "block", *TESTED[-6:])
    return rows.groupBy("part").cogroup(kept.groupBy("part")).applyInPandas(run, "block long, part int, inside binary, p binary")


def _score(blocks: DataFrame, answers: DataFrame, shared) -> DataFrame:
    def run(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        corpus = shared.value
        names = [c.split()[0] for c in SCORES.split(", ")]
        if not len(pdf):
            return pd.DataFrame(columns=names)
        b = Block(next(pdf.itertuples()))
        base = corpus.base(b.counts)[b.tokens]
        p, in_state = base.copy(), np.zeros(len(base), bool)
        e = entries_of(b, corpus)
        if len(e.at):
            values = [np.full(len(x), np.nan) for x in e.n]
            for part, inside, given in zip(answers["part"], answers["inside"], answers["p"]):
                where = []
                for parts, is_leaf in zip(e.part, e.is_leaf):
                    x, y = np.searchsorted(parts, [part, part + 1])
                    where.append(x + np.flatnonzero(is_leaf[x:y]))
                depth = np.repeat(np.arange(len(where)), [len(x) for x in where])
                where = np.concatenate(where)
                live = np.unpackbits(np.frombuffer(inside, np.uint8), count=len(where)).astype(bool)
                got = np.full(len(where), np.nan)
                got[live] = unpack(given, "<f8")
                for d in range(len(values)):
                    values[d][where[depth == d]] = got[depth == d]
            for d, v in enumerate(values):
                here = np.flatnonzero(e.leaf >> 40 == d)
                x = v[e.leaf[here] & ((1 << 40) - 1)]
                live = ~np.isnan(x)
                p[e.at[here[live]]] = x[live]
                in_state[e.at[here[live]]] = True
        total_of = lambda x: np.add.reduceat(x, b.starts)
        known = total_of((b.counts[b.tokens] > 0).astype(np.int64))
        values = (list(b.row.doc_id), b.held, b.sizes, known, corpus.total, total_of(np.log10(base)), total_of(np.log10(p)), total_of(in_state.astype(np.int64)))
        return pd.DataFrame(dict(zip(names, values)))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, SCORES)


def score_documents(documents: DataFrame, contexts_to: list | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and
    n_in_state, its tokens that were scored in a state longer than the root.

    Null and empty texts are the end token alone. Repeated rows are documents of their own, and
    all of them count where they are learned from; so do rows whose doc_id is null. With nothing to
    learn from each token has probability one. An empty table gives no rows. Columns other than doc_id and
    text aren't read. Words, and contexts of several words, are told apart by 64-bit hashes.

    contexts_to: a list that gets the tables of admitted contexts by depth and of states, for reports.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", (id_bucket("doc_id", HELD[0]) == HELD[1]).alias("held_out"))
    tokenised = materialise(docs.mapInPandas(giving_back(blocks_of(BLOCK_BYTES)), BLOCK))
    sums = tokenised.agg(F.sum("train").alias("train"), F.sum("bytes").alias("bytes")).first()
    parts = min(MAX_PARTS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sums.bytes or 0) // PART_BYTES)))
    total = sums.train or 0
    blocks, corpus, words = _counted(tokenised, parts, total, max(LEAST, math.ceil(ROOTS * math.sqrt(total))))
    forget(tokenised)
    levels = _contexts(blocks, corpus, words)
    shared = spark.sparkContext.broadcast(corpus)
    tested = materialise(_test(_send(blocks, shared), _sizes(levels, corpus), shared))
    kept = materialise(_kept(tested))
    if contexts_to is not None:
        contexts_to += [levels, kept]
    else:
        forget(*levels)
    answers = _answer(tested, kept, shared)
    return _score(blocks, answers, shared).withColumn("doc_id", F.col("doc_id").cast(kind))
