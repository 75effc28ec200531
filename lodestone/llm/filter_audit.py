"""What quality filters remove in each order, from the counts of documents that fail them jointly.

A document fails a set of filters if the product of its flags is 1. The joint failures of all 32 sets, aggregated once for each
part, tell everything: inclusion and exclusion gives the survivors of any prefix of any order, the failures that a filter has to
itself and, as the dividends of the union, the filter's share over all orders. No order is ever played through on documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD
from lodestone.operators.lineage import materialise

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_flags(text: Column) -> dict[str, Column]:
    """0 or 1 for each filter that reads the text alone: A under 50 words, B under 65 distinct of 100 words, C over 5 capitals
    A-Z of 100 code points, D any of #$%&*|. text isn't null."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    # one pass of the words gives both counts
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    few = F.transform(F.array(counts), lambda c: (F.when(c["n"] < 50, 1).otherwise(0) + F.when(100 * c["d"] < 65 * c["n"], 2).otherwise(0)))[0]
    return {"ab": few, "c": F.when(100 * capitals > 5 * F.char_length(text), 4).otherwise(0), "d": F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)}


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a source fail exactly the filters of mask (bit i is FILTERS[i]), by whether
    a label of theirs says quality 1 or toxic 1.

    Null texts are empty, null sources the part ''. A document fails E if a smaller doc_id has its text; rows of the same doc_id and
    text are no copies of each other, rows without a doc_id neither fail E nor make others fail it, and have no label. Documents
    labelled more than once have the greatest label. Empty tables give no rows."""
    text = F.coalesce("text", F.lit(""))
    flags = text_flags(text)
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), sum(flags.values(), F.lit(0)).alias("mask"), F.unhex(F.sha2(text, 256)).alias("h"))
    rows = materialise(rows)
    known = rows.where("doc_id IS NOT NULL")
    # a text's first document is looked up by text and id together, so the copies of one text spread over all tasks
    first = known.groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    label = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    known = known.groupBy("h", "doc_id", "part", "mask").agg(F.count("*").alias("n")).join(first, ["h", "doc_id"], "left")
    known = known.withColumn("mask", F.col("mask") + F.when(F.col("is_first"), 0).otherwise(16)).join(label, "doc_id", "left")
    known = known.select("part", "mask", zero("good").alias("good"), zero("toxic").alias("toxic"), "n")
    unknown = rows.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.lit(1).cast("long").alias("n"))
    return known.unionByName(unknown).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").cast("long").alias("n"))


def joint_failures(masks: DataFrame) -> DataFrame:
    """(part, failing, good, toxic): arrays with, for each of the 32 sets of filters, how many documents fail all of the set, and how many of
    these are good, toxic. Of the empty set that is all documents."""
    flag = [F.shiftright("mask", i).bitwiseAND(1) for i in range(len(FILTERS))]
    sums = []
    for s in range(SETS):
        product = F.col("n")
        for i, f in enumerate(flag):
            if s >> i & 1:
                product = product * f
        sums += [F.sum(product).alias(f"n{s}"), F.sum(product * F.col("good")).alias(f"g{s}"), F.sum(product * F.col("toxic")).alias(f"t{s}")]
    one = masks.groupBy("part").agg(*sums)
    return one.select("part", *(F.array(*(F.col(f"{c}{s}") for s in range(SETS))).alias(name) for c, name in (("n", "failing"), ("g", "good"), ("t", "toxic"))))


def _signed(counts: Column, of: Column, weigh) -> Column:
    """The sum over the sets s in `of` of (-1)^|s| * counts[s] * weigh(s)."""
    term = lambda s: F.when(F.bit_count(s) % 2 == 0, F.get(counts, s)).otherwise(-F.get(counts, s)) * weigh(s)
    return F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda s: s.bitwiseAND(F.bitwise_not(of)) == 0), F.lit(0).cast("long"), lambda sum_, s: sum_ + term(s))


def survivors(counts: Column) -> Column:
    """For each set of filters, how many documents fail none of it, from how many fail all of each set."""
    return F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda of: _signed(counts, of, lambda s: F.lit(1)))


def _of_each_filter(counts: Column, weigh) -> Column:
    """For each filter f, the sum over the sets s with f of (-1)^(|s| + 1) * counts[s] * weigh(s)."""
    has = lambda s, f: F.when(s.bitwiseAND(f) != 0, weigh(s)).otherwise(0)
    return F.array(*(-_signed(counts, F.lit(SETS - 1), lambda s, f=1 << i: has(s, f)) for i in range(len(FILTERS))))


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part,
    each of the 120 orders and each step. failures() says what nulls, copies and repeated labels count as.

    shapley is the filter's removed summed over all orders: 120 times the sum, over the sets that have it, of the set's dividend
    shared equally by its filters."""
    sums = joint_failures(failures(documents, labels))
    parts = sums.select(
        "part", "failing", survivors(F.col("failing")).alias("left"), survivors(F.col("good")).alias("good_left"), survivors(F.col("toxic")).alias("toxic_left"),
        _of_each_filter(F.col("failing"), lambda s: F.lit(1)).alias("alone"),
        _of_each_filter(F.col("failing"), lambda s: (F.lit(len(ORDERS)) / F.bit_count(s)).cast("int")).alias("shares"),
    )
    at = parts.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = "aggregate(slice(transform(split(filter_order, ''), c -> shiftleft(1, ascii(c) - 65)), 1, {}), 0, (m, b) -> m | b)"
    at = at.withColumns({"before": F.expr(bits.format("step - 1")), "after": F.expr(bits.format("step")), "filter": F.substring("filter_order", F.col("step"), 1)})
    own = F.ascii("filter") - ord(FILTERS[0])
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return at.select(
        "part", "filter_order", "step", "filter", F.get("left", F.col("after")).alias("kept"), lost("left").alias("removed"),
        (F.get("failing", F.expr("shiftleft(1, ascii(filter) - 65)")) - lost("left")).alias("redundant"), F.get("alone", own).alias("unique_fails"),
        lost("good_left").alias("good_lost"), lost("toxic_left").alias("toxic_lost"), F.get("shares", own).alias("shapley"),
    )
