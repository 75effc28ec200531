"""Embedding near-duplicates by iterative quantisation.

Unit vectors are centred, projected on principal axes and turned by a rotation learned so that
their signs lose least (iterative quantisation). Several such rotations, from different starts, make a
balanced binary code. Multi-index Hamming tables hold its substrings; vectors that share one are
candidates, which are compared by exact cosine of the original vectors.

Width and number of the substrings follow from the number of vectors and from how many bits pairs at the
least cosine differ in, measured on the sample the rotations are learned from: of the widths that
let all but 1 % of such pairs share a substring, the cheapest. Wider ones for more vectors keep the number of
candidates of a vector about the same at every size.

Equal vectors are searched for once and counted. A bucket of over BLOCK vectors is dealt out as
pairs of blocks. Pairs aren't emitted: each pair is judged in the first bucket that it shares,
which gives counts of links by vector and links enough to connect each bucket; of buckets of several tables that
hold the same vectors the first is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, forget, materialise, whole_runs

BLOCK = 128
SAMPLE = 3000  # vectors that the rotations are learned from, about
RECALL = 0.99  # share of the pairs at the least cosine that meet in a table
CARRIED = 15.0  # cost of a row that meets others, which carries its vector, in rows that don't
COMPARED = 0.3  # cost of a candidate, likewise
WIDTHS = range(4, 32)


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 6) -> np.ndarray:
    """(dim, bits): principal axes times the rotation that brings them closest to their signs. x: centred."""
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def pairs_at(x: np.ndarray, least: float, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors like the sample's, each beside one at the cosine `least`: towards another of the sample's
    vectors, and in any direction."""
    g = np.random.default_rng(seed)
    a = x[g.integers(0, len(x), 1000)]
    out = []
    for b in (x[g.integers(0, len(x), 1000)], g.normal(size=a.shape)):
        away = b - (a * b).sum(axis=1, keepdims=True) * a
        size = np.linalg.norm(away, axis=1)
        ok = size > 1e-9
        if ok.any():
            out.append((a[ok], least * a[ok] + np.sqrt(1 - least**2) * away[ok] / size[ok, None]))
    return out


def choose(differing: list[np.ndarray], n: int) -> tuple[int, int]:
    """(width, tables) of the substrings for n vectors; differing: shares of bits in which pairs differ."""
    best = None
    for width in WIDTHS:
        tables = 1
        while any((1 - (1 - (1 - d) ** width) ** tables).mean() < RECALL for d in differing):
            tables += 1 + tables // 16
            if tables > 100_000:
                break
        else:
            met = n / 2.0**width
            cost = tables * (1 + CARRIED * -np.expm1(-met) + COMPARED * met)
            if best is None or cost < best[0]:
                best = cost, width, tables
    return (best or (0, 1, 1))[1:]


class Codes:
    """Mean and projections for vectors such as the sample x, and the width of substrings."""

    def __init__(self, x: np.ndarray, n: int, least: float) -> None:
        self.mean = x.mean(axis=0)
        centred, bits = x - self.mean, min(x.shape[1], 64)
        turns = [learn_rotation(centred, bits, seed) for seed in range(-(-256 // bits))]
        sign = lambda v: (v - self.mean) @ np.hstack(turns) >= 0
        differing = [(sign(a) != sign(b)).mean(axis=1) for a, b in pairs_at(x, least)]
        self.width, self.tables = choose(differing, n)
        while len(turns) * bits < self.width * self.tables:
            turns.append(learn_rotation(centred, bits, len(turns)))
        self.projection = np.hstack(turns)[:, : self.width * self.tables]

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables) numbers."""
        power = 1 << np.arange(self.width)
        parts = [(((x[i : i + 500] - self.mean) @ self.projection >= 0).reshape(-1, self.tables, self.width) @ power) for i in range(0, len(x), 500)]
        return np.concatenate(parts).astype(np.int32)


RUN = ["sig", "bi", "bj"]


def _pairs(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of each bucket, for rows sorted by bucket: each row with the one k
    further, for k up to the longest bucket; of two blocks, one of each."""
    run = pdf.groupby(RUN, sort=False).ngroup().to_numpy()
    block, cross = pdf["block"].to_numpy(), (pdf["bi"] != pdf["bj"]).to_numpy()
    for k in range(1, len(run)):
        i = np.flatnonzero(run[:-k] == run[k:])
        if not len(i):
            return
        j = i + k
        ok = ~cross[i] | (block[i] != block[j])
        yield i[ok], j[ok]


def _judge(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_runs(batches, RUN):
            width = max(map(len, pdf["embedding"]))  # a bucket's vectors are of one length, a batch's may not be
            x = unit(np.stack([np.pad(v, (0, width - len(v))) for v in pdf["embedding"]]))
            width = max(map(len, pdf["code"]))
            code = np.stack([np.pad(v, (0, width - len(v)), constant_values=-1) for v in pdf["code"]])
            rid, n, table = pdf["rid"].to_numpy(), pdf["n"].to_numpy(), pdf["table"].to_numpy()
            links, root, edges = np.zeros(len(pdf), np.int64), np.arange(len(pdf)), []

            def find(v: int) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for i, j in _pairs(pdf):
                close = np.einsum("ij,ij->i", x[i], x[j]) >= least
                i, j = i[close], j[close]
                first = (code[i] == code[j]).argmax(axis=1) == table[i]
                i, j = i[first], j[first]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                for a, b in zip(i, j):
                    if (p := find(a)) != (q := find(b)):
                        root[max(p, q)] = min(p, q)
                        edges.append((rid[a], 0, rid[b]))
            counts = pd.DataFrame({"rid": rid, "links": links, "other": rid})[links > 0].groupby("rid", as_index=False).agg({"links": "sum", "other": "first"})
            yield pd.concat([counts, pd.DataFrame(edges, columns=["rid", "links", "other"])]).astype("int64")

    return run


def near_vectors(embeddings: DataFrame, least: float = 0.9, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at cosine >= least, as far as found),
    component_id (smallest vec_id reachable) and kept (vec_id = component_id).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as
    do vectors of different length. Repeated rows are vectors of their own and link with each
    other. A null vec_id counts as a link of others, is never kept, and names no component. An empty table
    gives no rows; columns other than vec_id and embedding aren't read. The rotations are learned
    from about `sample` distinct vectors, drawn by a hash of their components, so that the result
    doesn't depend on how rows are stored.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select("vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid, other = vectors.where(good), vectors.where(~good)
    reps = valid.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    reps = materialise(reps.select(F.monotonically_increasing_id().alias("rid"), F.size("embedding").alias("dim"), "embedding", "first", "n"))

    models = {}
    for dim, count in reps.groupBy("dim").count().collect():  # a row for each length of vector
        draw = F.pmod(F.xxhash64(F.lit("itq"), "embedding"), F.lit(1 << 30)) < min(1.0, sample / count) * (1 << 30)
        x = np.array([r.embedding for r in reps.where((F.col("dim") == dim) & draw).select("embedding").toLocalIterator()], np.float64).reshape(-1, dim)
        x = x[np.lexsort(x.T)] if len(x) else np.eye(dim)
        models[dim] = Codes(unit(x), count, least)
    shared = spark.sparkContext.broadcast(models)

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                yield part.assign(code=list(shared.value[dim].substrings(unit(np.stack(part["embedding"].to_numpy())))))

    kind = reps.schema["embedding"].dataType.simpleString()
    coded = materialise(reps.select("rid", "dim", "n", "embedding").mapInPandas(codes, f"rid long, dim int, n long, embedding {kind}, code array<int>"))
    keys = coded.select("rid", "dim", F.posexplode("code").alias("table", "sub")).select("rid", "table", F.xxhash64("dim", "table", "sub").alias("sig"))
    # of buckets that hold the same vectors the first table's is enough: pairs are judged in the first bucket they share
    same = [F.bit_xor(F.xxhash64("rid")).alias("x"), F.sum(F.xxhash64(F.lit(1), "rid") % (1 << 32)).alias("y")]
    met = keys.groupBy("sig").agg(F.count("*").alias("count"), F.min("table").alias("table"), *same).where("count > 1")
    met = met.groupBy("count", "x", "y").agg(F.min_by("sig", F.struct("table", "sig")).alias("sig")).select("sig", "count")
    rows = keys.join(met, "sig").withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"), "block", "table", "rid")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.join(coded.select("rid", "n", "embedding", "code"), "rid")
    judged = rows.repartition(parts, *RUN).sortWithinPartitions(*RUN).mapInPandas(_judge(least), "rid long, links long, other long")
    judged = materialise(judged)
    forget(coded)

    counts = judged.groupBy("rid").agg(F.sum("links").alias("links"))
    groups = components(judged.where("rid <> other"), "rid", "other").withColumnRenamed("node", "rid")
    lowest = groups.join(reps.select("rid", "first"), "rid").groupBy("component").agg(F.min("first").alias("lowest"))
    named = reps.join(counts, "rid", "left").join(groups.join(lowest, "component").select("rid", "lowest"), "rid", "left")
    named = named.select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "first").alias("component_id"))
    out = valid.join(named, "embedding").select("vec_id", "n_links", "component_id")
    out = out.unionByName(other.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
