"""Mixing sources to target weights by distributed prefix sums.

Documents get hash-random keys and are sorted by them within their source. Ranges of keys, not
whole sources, are the unit of work: totals by (source, range) give each range its start, and a
window within the range gives each document its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, free_names, materialise

WEIGHTS = (3, 1, 2)
RANGE_ROWS = 1000  # documents aimed at in a range of keys, of all sources together
MAX_DIGITS = 4  # at most 16^4 ranges


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), limit: int = 2) -> DataFrame:
    """by_source: (source, source_size). Adds target: sources by code point, null last, take the
    weights in turn and share share[0]/share[1] of all words by weight; a target stops at `limit`
    times its source's size and the excess is shared anew by weight.

    by_source has a row for each source, and is worked through in one task, which serves some millions of sources. By rising limit per weight, the sources that stop are the first ones, and one pass of running
    sums tells where they end. All sums are of whole numbers.
    """
    everything = W.partitionBy()
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")
    num, den = share
    order = W.orderBy((F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rows = by_source.withColumn("w", weight).withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "stopped": F.coalesce(F.sum("source_size").over(order), F.lit(0)) * limit,
            "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order), F.lit(0)),
        }
    )
    rest = F.col("total") * num - F.col("stopped") * den
    rows = rows.withColumn("stops", F.col("w") * rest > F.col("source_size") * limit * den * F.col("w_left"))
    free = lambda c: F.sum(F.when(~F.col("stops"), F.col(c)).otherwise(0)).over(everything)
    stopped = F.sum(F.when(F.col("stops"), F.col("source_size")).otherwise(0)).over(everything) * limit
    target = F.when(F.col("stops"), (F.col("source_size") * limit).cast("double")).otherwise(F.col("w") * (F.col("total") * num - stopped * den) / (free("w") * den).cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(documents: DataFrame, seed: str = "mix", carry: tuple[str, ...] = (), **kw) -> DataFrame:
    """One row per document: doc_id, source, the carried columns, size (words), source_size, target, copies and taken.

    taken: the words the mix takes of it, repeats counted. A source is taken whole as often as its
    target holds it, then in key order up to the target's last whole word, which can cut one
    document. copies: how often the document begins. Null and empty texts have size 0; a source
    of such alone has target 0. Repeated rows are documents of their own. Keys are md5 of seed and
    doc_id, so reruns agree; equal ids go by size.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = materialise(documents.select("doc_id", "source", *carry, size.alias("size"), key.alias("key")))
    n = docs.count()
    digits = max(0, min(MAX_DIGITS, math.ceil(math.log(max(1, n / RANGE_ROWS), 16))))
    docs = docs.withColumn("range", F.substring("key", 1, digits))
    totals = docs.groupBy("source", "range").agg(F.sum("size").alias("words"))
    starts = totals.withColumn("start", F.sum("words").over(W.partitionBy("source").orderBy("range")) - F.col("words"))
    goals = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), **kw)
    plan = starts.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.select(F.col("source").alias("s"), F.col("range").alias("r"), "start", "source_size", "target")
    # ranges of all sources: at most 16^MAX_DIGITS times the sources
    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    within = F.sum("size").over(W.partitionBy("s", "r").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("before", F.col("start") + within - F.col("size")).withColumn("budget", F.floor("target").cast("long"))
    full = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long")
    rows = rows.withColumn("full", full).withColumn("left", F.col("budget") - F.col("full") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    copies = F.col("full") + (F.col("before") < F.col("left")).cast("long")
    return rows.select("doc_id", "source", *carry, "size", "source_size", "target", copies.alias("copies"), (F.col("full") * F.col("size") + part).cast("long").alias("taken"))


def mixed(documents: DataFrame) -> DataFrame:
    """The columns of documents, whatever these are called; each document as often as the mix begins it, whole each
    time.

    Texts without words, null ones too, are begun as the documents before them in the order of keys are, which takes no
    word. Repeated rows are documents of their own; an empty table stays empty.
    """
    row, copies, copy = free_names(documents, "row", "copies", "copy")
    docs = materialise(documents.withColumn(row, F.monotonically_increasing_id()))
    mixed = mix(docs.select("doc_id", "source", "text", F.col(row).alias("row_")), carry=("row_",))
    times = mixed.select(F.col("row_").alias(row), F.col("copies").alias(copies)).where(F.col(copies) > 0)
    rows = docs.join(times, row).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return rows.drop(row, copies, copy)
