"""What the operators of this subpackage share: tables, materialising, words, components."""

from __future__ import annotations

import ctypes
from ctypes.util import find_library
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.names import free_names  # noqa: F401
from lodestone.operators import lineage
from lodestone.operators.lineage import materialise, shared_folder  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(*dfs: DataFrame) -> None:
    """lineage.forget(), and ask the driver to collect what refers to finished shuffles, whose files Spark then removes."""
    lineage.forget(*dfs)
    if dfs:
        dfs[0].sparkSession._jvm.System.gc()


def bit_filter(keys: DataFrame, count: int, bits: tuple[int, int]) -> np.ndarray:
    """A Bloom filter of keys: k, long, about `count` of them; of 2^bits[0] to 2^bits[1] bits, whatever their number."""
    size = 1 << min(bits[1], max(bits[0], (16 * max(1, count)).bit_length()))
    at = F.explode(F.array(F.col("k").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("k", 32).bitwiseAND(F.lit(size - 1))))
    words = keys.select(at.alias("i")).groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(i & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys (uint64) may be in the filter; false for none that are."""
    mask, hit = np.uint64(len(bits) * 64 - 1), np.ones(len(keys), bool)
    for x in (keys & mask, (keys >> np.uint64(32)) & mask):
        hit &= (bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1
    return hit


def give_back() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    libc = find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)


def giving_back(run):
    """run, a function of batches, which when it ends gives the memory that its Python worker has freed back to the system: workers
    live on, and what one stage's allocator holds the next one's lacks."""

    @wraps(run)
    def ends(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return ends


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased. On bytes, lower() and split() know ASCII only: split()
    cuts at exactly 0x20 and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def id_bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the contracts' train and held-out split."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def fraction_of(doc_id: str, salt: str) -> Column:
    """A number in [0, 1) drawn from the id, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(doc_id)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def unsent(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles both: it grows with the input, and is no size that the driver should collect to broadcast it."""
    return df.hint("merge")


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component being the
    smallest node reachable. Nodes without links aren't returned.

    Alternates large-star and small-star rounds, which converge in about log(n) of them. A hub's
    edges are spread by skew-splitting joins; all aggregates combine before their shuffle.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, before = materialise(e), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(unsent(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(unsent(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        forget(last)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: not converged")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots)


def whole_runs(batches, keys: list[str]):
    """Of batches sorted by keys: frames that end where a run of equal keys does. What is held
    back is a run at most, so runs have to be bounded."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        same = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(pdf) if not same.size else int(len(pdf) - same[::-1].cumprod().sum())
        held = pdf.iloc[cut:]
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def known_labels(labels: DataFrame, label: str, held: tuple[int, int]) -> DataFrame:
    """(doc_id, label) of the rows to learn from: those whose id_bucket modulo held[0] isn't held[1]."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    return known.where(id_bucket("doc_id", held[0]) != held[1])


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, held: tuple[int, int], per_class: int) -> DataFrame:
    """(doc_id, label, text, lang) of labelled documents to learn from: those whose id_bucket modulo
    held[0] isn't held[1]; of each label about per_class rows, drawn by a hash of the id, or all if
    there are fewer. Texts are whole. Of documents of equal id the one of least text counts, once for each label."""
    known = known_labels(labels, label, held)
    shares = {r.label: min(1.0, per_class / r["count"]) for r in known.groupBy("label").count().collect() if r.label in (0, 1)}
    share = F.lit(0.0)
    for value, x in shares.items():
        share = F.when(F.col("label") == value, x).otherwise(share)
    picked = known.where(fraction_of("doc_id", "sample") < share).dropDuplicates()
    docs = documents.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id")  # picked: about 2 * per_class rows of two numbers
    return docs.groupBy("doc_id", "label").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang")).alias("d")).select("doc_id", "label", "d.text", "d.lang")


def labelled(documents: DataFrame, labels: DataFrame, label: str, held: tuple[int, int]) -> DataFrame:
    """labelled_sample() without drawing: all labelled documents to learn from, written. Documents are first looked up in a filter of the
    labelled ids of bounded size, so that of the texts hardly more than these are shuffled."""
    known = known_labels(labels, label, held).where("label IN (0, 1)").dropDuplicates()
    key = F.xxhash64(F.col("doc_id").cast("string"))
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(known.select(key.alias("k")), known.count(), (12, 26)))

    @F.pandas_udf("boolean")
    def may_be(k: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, k.to_numpy().view(np.uint64)))

    docs = documents.select("doc_id", "text", "lang").where(may_be(key)).join(unsent(known), "doc_id")
    rows = docs.groupBy("doc_id", "label").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang")).alias("d"))
    return materialise(rows.select("doc_id", "label", "d.text", "d.lang"))
