"""Document fingerprints: Merkle trees over sections, paragraphs and sentences, in DataFrame
functions alone.

A text is cut at blank lines into sections, at line ends into paragraphs and after runs of
`.!?` into sentences, the leaves. Every node's hash is that of its children's. The root is equal
exactly if the texts are; differing branches of two trees locate edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"


def _let(value: Column, body) -> Column:
    """body of a value that is made once."""
    return F.get(F.transform(F.array(value), body), 0)


def _node(name: str, children: Column, hashes: Column) -> Column:
    return F.struct(F.md5(F.array_join(hashes, "")).alias("hash"), children.alias(name))


def merkle_tree(text: Column) -> Column:
    """array of sections, each struct<hash, paragraphs: array<struct<hash, leaves: array<string>>>>; a leaf is a
    sentence's hash, any other node's hash that of its children's. Null: as empty."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)), lambda s: F.md5(s))
    paragraphs = lambda s: F.transform(F.split(s, "\n", -1), lambda p: _let(leaves(p), lambda x: _node("leaves", x, x)))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda s: _let(paragraphs(s), lambda x: _node("paragraphs", x, x["hash"])))


def root(tree: Column) -> Column:
    """64 hex digits: SHA-256 of the section hashes."""
    return F.sha2(F.array_join(tree["hash"], ""), 256)


def nodes(tree: Column) -> Column:
    """The distinct hashes of a tree's nodes: its root, sections, paragraphs and sentences."""
    paragraphs = F.flatten(tree["paragraphs"])
    leaves = F.flatten(F.transform(paragraphs, lambda p: p["leaves"]))
    return F.array_distinct(F.concat(F.array(root(tree)), tree["hash"], F.transform(paragraphs, lambda p: p["hash"]), leaves))


def likeness(a: Column, b: Column) -> Column:
    """Of two trees' nodes(): shared ones, twice, to all. 1 exactly if the roots are equal; sentences moved, repeated or
    joined to another paragraph are shared, the nodes above them aren't."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)).cast("double")


def edited_leaves(a: Column, b: Column) -> Column:
    """Hashes of a's sentences that an edit to b removed or changed, found by descending from the sections that b hasn't to
    their paragraphs that b's other sections haven't, and to these one's sentences that b's other paragraphs haven't. What
    moved whole isn't an edit, nor what stands behind an insertion."""
    without = lambda x, y: F.filter(x, lambda n: ~F.array_contains(y["hash"], n["hash"]))
    below = lambda x: F.flatten(x["paragraphs"])
    leaves = lambda x: F.flatten(x["leaves"])
    sections = F.struct(without(a, b).alias("a"), without(b, a).alias("b"))
    return _let(sections, lambda s: _let(F.struct(below(s["a"]).alias("a"), below(s["b"]).alias("b")), lambda p: F.array_except(leaves(without(p["a"], p["b"])), leaves(without(p["b"], p["a"])))))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_sections, n_paragraphs, n_leaves of every text; null text: as empty."""
    trees = documents.select("doc_id", merkle_tree(F.col("text")).alias("tree"))
    paragraphs = F.flatten(F.col("tree")["paragraphs"])
    return trees.select("doc_id", root(F.col("tree")).alias("fingerprint"), F.size("tree").alias("n_sections"), F.size(paragraphs).alias("n_paragraphs"), F.size(F.array_distinct(F.flatten(paragraphs["leaves"]))).alias("n_leaves"))


SUB = 1024  # ranges that one id, or null, is cut into at most


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the next document's text by descending doc_id, nulls last, equal
    ids by md5 of the text and text; after the last comes the first.

    Ids are cut into as many ranges as there are shuffle partitions, each a window of its own; an id, or null, that
    fills several is cut by the md5. The first document of a range is also put, as a ghost, behind the last of the
    range before it. So texts are shuffled once and no window spans all rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    sizes = docs.agg(F.count("*").alias("all"), F.count_if(F.col("doc_id").isNull()).alias("null")).first()
    hot = {int(x): min(SUB, found.count(x)) for x in set(found) if found.count(x) > 1}  # ids that are several cuts
    of_null = max(1, min(SUB, -(-n * sizes["null"] // max(1, sizes["all"]))))
    cuts = F.array(*(F.lit(int(x)) for x in sorted(set(found)))) if found else F.array().cast("array<bigint>")
    key = F.md5("text")
    pieces = F.when(F.col("doc_id").isNull(), of_null)
    for ident, k in hot.items():
        pieces = pieces.when(F.col("doc_id") == ident, k)
    place = F.conv(F.substring(key, 1, 4), 16, 10).cast("int") * pieces.otherwise(1) / 65536
    # ranges fall as documents come: nulls have the lowest ones, equal ids fall by key
    at = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(cuts, lambda x: x < F.col("doc_id"))))
    docs = docs.withColumn("key", key).withColumn("range", at * SUB + (SUB - 1) - F.floor(place).cast("int"))
    order = F.struct((-F.col("doc_id")).alias("a"), "key", "text")
    firsts = docs.groupBy("range").agg(F.min(order).alias("f"))
    ranges = [r.range for r in docs.select("range").distinct().orderBy(F.desc("range")).collect()]  # bounded by partitions and SUB
    if not ranges:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"))
    before = spark.createDataFrame([(x, y) for x, y in zip(ranges, [ranges[-1], *ranges[:-1]])], "range int, into int")
    ghosts = firsts.join(F.broadcast(before), "range").select(F.col("into").alias("range"), (-F.col("f.a")).alias("doc_id"), "f.key", "f.text", F.lit(1).alias("ghost"))
    rows = docs.select("range", "doc_id", "key", "text", F.lit(0).alias("ghost")).unionByName(ghosts)
    w = W.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), "key", "text")
    return rows.withColumn("next_text", F.lead("text").over(w)).where("ghost = 0").select("doc_id", "text", "next_text")


def compare_edited(documents: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited text: the last floor(n_chars / 2) code
    points replaced by the first as many (or all) of the next document. n_edited: sentences that the edit removed.

    Empty and null texts have the fingerprint of the empty text; repeated rows give repeated rows, and follow each
    other; rows with a null doc_id come last. An empty table gives no rows; other columns aren't read.
    """
    half = F.expr("n_chars div 2")
    rows = with_next(documents).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half.cast("int"))))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), merkle_tree(F.col("text")).alias("a"), merkle_tree(F.col("edited")).alias("b"), nodes(merkle_tree(F.col("next_text"))).alias("c"))
    rows = rows.withColumn("of_a", nodes(F.col("a")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        root(F.col("a")).alias("fingerprint"),
        root(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("of_a"), nodes(F.col("b"))).alias("near_edited"),
        likeness(F.col("of_a"), F.col("c")).alias("near_next"),
        F.size("a").alias("n_sections"),
        F.size(edited_leaves(F.col("a"), F.col("b"))).alias("n_edited"),
    )
