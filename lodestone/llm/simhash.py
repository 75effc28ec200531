"""SimHash near-duplicates: fingerprints of word shingles, deletion-variant signatures.

Two 64-bit fingerprints that differ in 3 bits at most, cut into two segments, have one segment
that differs in one bit at most. So each segment is indexed once for each of its bits with that
bit wiped out: fingerprints that may link share such a signature, and an equality join finds them.
Distinct fingerprints alone are indexed. Signatures that hold more than BUCKET of them are cut
again, the other segment in the same way, and so on; after three cuts only 11 bits are free, so
that no set of fingerprints compared with each other exceeds 2048, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bit_filter, components, forget, fraction_of, free_names, give_back, giving_back, in_filter, materialise, unsent, words_of

SHINGLE = 3
MAX_BITS = 3
BUCKET = 256
LEVELS = 3

# of keep_one, which compares exactly what fingerprints link, and then what they can't tell
WORDS = 5
SAMPLE = 20_000  # documents, about, that common shingles are told from
COMMON = 200_000
CROWD = 8  # documents that a shingle may be looked up by, beyond which it comes after others
FILTER_BITS = (12, 26)  # log2 of the size of the filter of those
HUBS = 3
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit set where over half the shingles' XXH64 (seed 42) have it; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(b" ".join(g), 42) for g in grams], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """Bit set where over half the hashes have it; 0 of none."""
    # in pieces: very long texts don't make a large matrix
    counts = sum(np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(h), 4096))
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprints(documents: DataFrame, carry: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """The carried columns and fp, the fingerprint as a signed long, of each document's whole text."""
    docs = documents.select(*carry, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint_of(t, shingle) for t in pdf["text"]], dtype=np.uint64)
            yield pdf[list(carry)].assign(fp=fp.view(np.int64))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("text").schema)
    return docs.mapInPandas(giving_back(run), f"{schema}, fp long" if schema else "fp long")


def _cut(rows: DataFrame, width: int) -> DataFrame:
    """rows: (sig, lo, fp), bits lo to lo + width of fp being free. One row for each of these bits,
    wiped out of its half; the other half is free next."""
    half = width // 2
    ones = F.lit((1 << half) - 1).cast("long")
    rows = rows.withColumn("i", F.explode(F.array(*map(F.lit, range(width)))))
    at = F.col("lo") + (F.col("i") / half).cast("int") * half
    value = F.expr("shiftright(fp, a)").bitwiseAND(ones).bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, i % {half})")))
    rows = rows.withColumn("a", at).withColumn("sig", F.xxhash64("sig", "i", value))
    return rows.select("sig", F.when(F.col("i") < half, F.col("lo") + half).otherwise(F.col("lo")).alias("lo"), "fp")


def link_bucket(fps: list[int], max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links enough to connect what fps within max_bits of each other connect: at most one fewer
    than fps. Breadth first, so that no link found is lost to the connection."""
    f = np.array(fps, dtype=np.int64).view(np.uint64)
    left, found = np.arange(len(f)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(f[left] ^ f[x]) <= max_bits
            found += [(fps[x], fps[y]) for y in left[near]]
            todo += list(left[near])
            left = left[~near]
    return found


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([x for fps in pdf["fps"] for x in link_bucket(sorted(fps))], columns=["a", "b"]).astype("int64")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """fps: distinct fp. (a, b): enough of the pairs within MAX_BITS to connect all that they connect. Signatures are deleted when the
    links of their level, and the next level's signatures, have been written."""
    rows, width, found, held = fps.select(F.lit(0).cast("long").alias("sig"), F.lit(0).alias("lo"), "fp"), 64, None, []
    for level in range(LEVELS):
        rows = _cut(rows, width)
        width //= 2
        shared = rows.groupBy("sig").count().where("count > 1")
        rows = rows.join(unsent(shared), "sig")
        last = level == LEVELS - 1
        if not last:
            rows = materialise(rows)
            forget(*held)
            held = [rows]
        small = rows if last else rows.where(F.col("count") <= bucket)
        some = materialise(small.groupBy("sig").agg(F.sort_array(F.collect_set("fp")).alias("fps")).select("fps").distinct().mapInPandas(_links, "a long, b long"))
        found = some if found is None else found.unionByName(some)
        rows = rows.where(F.col("count") > bucket).select("sig", "lo", "fp")
        if last or rows.isEmpty():
            break
    forget(*held)
    return found.distinct()


def _groups(docs: DataFrame, order: Column) -> DataFrame:
    """docs: fp. (fp, first, component): of each distinct fp the least `order` of its documents, and the
    group's fp. Exact copies are one row from here on."""
    firsts = materialise(docs.groupBy("fp").agg(F.min(order).alias("first")))
    groups = components(links(firsts.select("fp")), "a", "b").withColumnRenamed("node", "fp")
    return firsts.join(unsent(groups), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the carried columns (doc_id among them), fingerprint (16 lowercase
    hex digits) and component_id, the smallest doc_id reachable by links, itself included.

    Fingerprints link at MAX_BITS or fewer differing bits. Texts with no words have fingerprint
    zero and link like any other; repeated rows stay; a null doc_id is never a component's id
    unless all of its documents have null.
    """
    docs = materialise(fingerprints(documents, carry))
    groups = _groups(docs, F.col("doc_id"))
    lowest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = groups.join(unsent(lowest), "component").select("fp", "component_id")
    return docs.join(unsent(ids), "fp").select(*carry, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles_of(text: str | None) -> np.ndarray:
    """The distinct shingles of WORDS words as sorted 64-bit hashes; of a shorter text all words as one,
    none without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * ODD[i]
    h = (h ^ (h >> np.uint64(32))) * ODD[0]
    return np.unique((h ^ (h >> np.uint64(29))).view(np.int64))


def packed(h: np.ndarray) -> bytes:
    """A set of shingles as the distinct upper halves of their hashes: sorted, differences, compressed."""
    half = np.unique((h.view(np.uint64) >> np.uint64(32)).astype(np.uint32))
    planes = np.ascontiguousarray(np.diff(half, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes)


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' Jaccard similarity is 4/5 or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * shared >= 4 * (len(a) + len(b))


@dataclass
class Order:
    """Of shingles: those few documents have first, so that what documents are looked up by is rare. Any order will do for finding all pairs;
    a bad one costs time."""

    known: np.ndarray  # shingles that are common in a sample, sorted
    often: np.ndarray  # how often they are there
    crowded: np.ndarray | None = None  # filter of those that over CROWD documents were looked up by

    def first(self, h: np.ndarray) -> np.ndarray:
        """Of a document's shingles, sorted: as many as two sets of similarity 4/5 can't both have apart."""
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        rank = np.where(self.known[at] == h, self.often[at], 0) if len(self.known) else np.zeros(len(h), np.int64)
        if self.crowded is not None:
            rank = np.maximum(rank, in_filter(self.crowded, h.view(np.uint64)))
        return h[np.argsort(rank, kind="stable")[: len(h) - -(-4 * len(h) // 5) + 1]]


def _counts(texts: DataFrame, shingles) -> DataFrame:
    """(h, n): in how many of the texts each shingle is, of those that a function picks of a text's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(shingles(shingles_of(t)) for t in pdf["text"])]), return_counts=True)
            yield pd.DataFrame({"h": h, "n": n})

    return texts.select("text").mapInPandas(giving_back(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _order(texts: DataFrame) -> Order:
    """The order for the texts (k1, text): common shingles by a sample, then those that turn out crowded when all texts are looked up so."""
    share = SAMPLE / max(1, texts.count())
    counts = _counts(texts.where(fraction_of("k1", "shingles") < share), lambda h: h)
    rows = counts.where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()  # two numbers a row
    known, often = rows["h"].to_numpy(), rows["n"].to_numpy()
    by = np.argsort(known)
    order = Order(known[by], often[by])
    shared = texts.sparkSession.sparkContext.broadcast(order)
    crowded = materialise(_counts(texts, lambda h: shared.value.first(h)).where(F.col("n") > CROWD).select(F.col("h").alias("k")))
    out = Order(order.known, order.often, bit_filter(crowded, crowded.count(), FILTER_BITS))
    forget(crowded)
    give_back()
    return out


def _shingled(texts: DataFrame) -> DataFrame:
    """texts: k1, k2, doc_id, text. Without text, with fp, a hash of the shingles, sim, their SimHash, n, their number, the packed set, and the first
    ones in order."""
    order = texts.sparkSession.sparkContext.broadcast(_order(texts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                h = shingles_of(text)
                rows.append((xxhash.xxh64_intdigest(h.tobytes()), len(h), order.value.first(h), packed(h), majority(h.view("<u8"))))
            fp, sim = (np.array([r[k] for r in rows], np.uint64).view(np.int64) for k in (0, 4))
            yield pdf[["k1", "k2", "doc_id"]].assign(fp=fp, sim=sim, n=[r[1] for r in rows], first=[r[2] for r in rows], set=[r[3] for r in rows])

    return texts.mapInPandas(giving_back(run), f"k1 long, k2 long, doc_id {texts.schema['doc_id'].dataType.simpleString()}, fp long, sim long, n int, first array<long>, set binary")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, last, left = np.zeros(len(pdf), bool), None, None
            for i, (a, x, y) in enumerate(zip(pdf["a"], pdf["sa"], pdf["sb"])):
                if a != last:
                    last, left = a, unpacked(x)
                keep[i] = similar(left, unpacked(y))
            yield pdf.loc[keep, ["a", "b"]]

    both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    return both.select("a", "b", "sa", "sb").mapInPandas(giving_back(run), "a long, b long")


FITS = "5 * least(na, nb) >= 4 * greatest(na, nb) AND 9 * least(na - ia, nb - ib) >= 4 * (na + nb)"


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups: fp, g. The groups that links (a, b) join are one."""
    edges = links.join(groups.toDF("a", "ga"), "a").join(groups.toDF("b", "gb"), "b").select("ga", "gb").where("ga <> gb")
    names = components(edges, "ga", "gb").toDF("g", "to")
    return groups.join(names, "g", "left").select("fp", F.coalesce("to", "g").alias("g"))


def fingerprint_links(reps: DataFrame) -> DataFrame:
    """reps: fp, sim. (a, b): each set with the least of its SimHash, and those least ones as links() of the SimHashes join them; near
    pairs for the most part, to be compared."""
    least = materialise(reps.groupBy("sim").agg(F.min("fp").alias("least")))
    same = reps.join(least, "sim").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    near = links(least.select(F.col("sim").alias("fp"))).join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b")
    out = materialise(same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct())
    forget(least)
    return out


def met_shingles(reps: DataFrame) -> DataFrame:
    """reps: fp, n, first. (h, fp, n, i): the first shingles that several sets have, with the place of each. What is shuffled to count them is
    gone before rows are."""
    rows = reps.select("fp", "n", F.posexplode("first").alias("i", "h"))
    met = materialise(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    out = materialise(rows.join(met, "h"))
    forget(met)
    return out


def similar_groups(sims: DataFrame, rows: DataFrame, held: DataFrame) -> DataFrame:
    """sims: fp, sim; rows: met_shingles(); held: fp, set, of the sets in rows; both are deleted. (fp, g): sets that pairs of similarity 4/5 or more
    connect have one g.

    Pairs that SimHash links are compared first, and groups begin with those that are similar. It can't link all: at similarity 4/5
    two fingerprints differ in about ten bits. But such pairs share one of their first shingles, at places that leave enough behind them. Of the sets that share one, all are compared with one,
    a hub; then with another those that aren't in its group yet, and so on; in the end, so that nothing is missed, those of
    different groups with each other.
    """
    pairs = fingerprint_links(sims.join(rows.select("fp").distinct(), "fp", "left_semi"))
    near = materialise(_similar(pairs, held))
    groups = materialise(_joined(rows.select("fp", F.col("fp").alias("g")).distinct(), near))
    forget(pairs, near)
    for turn in range(HUBS):
        named = rows.join(groups, "fp")
        hub = F.min_by(F.struct("fp", "n", "i", "g"), F.xxhash64("fp", F.lit(turn))).alias("hub")
        hubs = named.groupBy("h").agg(hub, F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("h", "hub")
        open_ = materialise(named.join(hubs, "h"))  # shingles whose sets aren't of one group yet
        pairs = open_.where("g <> hub.g").select(F.col("hub.fp").alias("a"), F.col("fp").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"), F.col("hub.i").alias("ia"), F.col("i").alias("ib"))
        links = materialise(_similar(pairs.where(FITS).select("a", "b").distinct(), held))
        last, old = groups, rows
        groups, rows = materialise(_joined(groups, links)), materialise(open_.select("h", "fp", "n", "i"))
        done = links.isEmpty()
        forget(last, old, links, open_)
        if done:
            break
    named = rows.join(groups, "fp")
    split = named.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("h")
    named = materialise(named.join(split, "h"))
    x, y = (named.select("h", F.col("fp").alias(s), F.col("n").alias(f"n{s}"), F.col("i").alias(f"i{s}"), F.col("g").alias(f"g{s}")) for s in "ab")
    rest = materialise(_similar(x.join(y, "h").where(f"ga < gb AND {FITS}").select("a", "b").distinct(), held))
    out = materialise(_joined(groups, rest))
    forget(rows, held, named, groups, rest)
    return out


def keep_one(documents: DataFrame) -> DataFrame:
    """The columns of documents, whatever these are called, one row of each group of near-duplicates: that of smallest
    doc_id, null ids last; of rows with equal ids always the same one, of rows equal in all columns one.

    Near-duplicates are documents whose sets of shingles of WORDS words have a Jaccard similarity of 4/5 or more,
    all of them: those whose SimHashes link, compared exactly but for hashes, then what is left; groups are what such pairs connect. Null texts and texts without
    words are one group. An empty table stays empty.
    """
    names = documents.columns
    key = [F.xxhash64(*names).alias("k1"), F.xxhash64(F.lit(1), *names).alias("k2")]  # rows are told apart by all their columns
    table = materialise(_shingled(documents.select(*key, "doc_id", "text")))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1", "k2")
    reps = table.groupBy("fp").agg(F.min(order).alias("best"), F.first("sim").alias("sim"), F.first("n").alias("n"), F.first("first").alias("first"))
    whole = materialise(reps.select("fp", "best", "sim", "n", "first"))
    rows = met_shingles(whole)
    reps = materialise(whole.select("fp", "best", "sim"))
    forget(whole)
    key2 = ["k1", "k2", "fp"]
    chosen = reps.join(rows.select("fp").distinct(), "fp", "left_semi").select("best.k1", "best.k2", "fp")
    # one shuffle of the sets: repeated rows meet where the join has brought them
    held = materialise(table.select(*key2, "set").join(chosen.hint("merge"), key2, "left_semi").dropDuplicates(key2).select("fp", "set"))
    copies = materialise(table.groupBy("k1", "k2").count().where("count > 1").drop("count"))
    forget(table)
    groups = reps.select("fp", "best").join(similar_groups(reps.select("fp", "sim"), rows, held), "fp", "left").withColumn("g", F.coalesce("g", "fp"))
    best = groups.groupBy("g").agg(F.min("best").alias("best")).select("best.k1", "best.k2")
    best = materialise(best.join(copies.withColumn("copies", F.lit(True)), ["k1", "k2"], "left"))
    forget(reps, copies)
    k1, k2, many = free_names(documents, "k1", "k2", "copies")
    rows = documents.withColumns({k1: key[0], k2: key[1]}).join(best.toDF(k1, k2, many), [k1, k2])
    once = rows.where(F.col(many).isNull()).select(*names)
    return once.unionByName(rows.where(many).dropDuplicates([k1, k2]).select(*names))
