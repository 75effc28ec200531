"""Joins that the built-in ones compose to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.names import free_names

def lookup(left: DataFrame, right: DataFrame, on: list[str], what: str) -> tuple[DataFrame, DataFrame]:
    """(rows found, error rows): an inner join whose missing keys become rows of an error table."""
    errors = left.join(right, on, "left_anti").select(*on, F.lit(f"missing {what}").alias("message"))
    return left.join(right, on), errors


def longest_prefix_join(left: DataFrame, uri: str, right: DataFrame, path: str, on: list[str] | None = None) -> DataFrame:
    """One row per left row with the columns of the right row whose path is the longest prefix of its
    uri, nulls if none is. Paths are unique by `on`.

    Each uri meets its own prefixes at the lengths that paths have, by equality; so no pair of a uri and
    a path that isn't its prefix is ever made. The number of distinct lengths is small and measured.
    """
    on = on or []
    lengths = [r.n for r in right.select(F.length(path).alias("n")).distinct().orderBy(F.desc("n")).collect()]
    row, prefix, found = free_names(left.select("*", *(F.lit(None).alias(c) for c in right.columns if c not in left.columns)), "row", "prefix", "found")
    rows = left.withColumn(row, F.monotonically_increasing_id())
    if not lengths:
        lengths = [0]
    cuts = F.filter(F.array(*(F.when(F.length(uri) >= n, F.substring(F.col(uri), 1, n)) for n in lengths)), lambda x: x.isNotNull())
    tried = rows.select(row, *on, F.explode(cuts).alias(prefix))
    others = [c for c in right.columns if c not in on]
    paths = right.select(*on, F.col(path).alias(prefix), F.struct(*others).alias(found))
    hits = tried.join(paths, [*on, prefix]).groupBy(row).agg(F.max_by(found, F.length(prefix)).alias(found))
    return rows.join(hits, row, "left").select(*left.columns, *(F.col(f"{found}.{c}").alias(c) for c in others))


def mark_join(left: DataFrame, key: str, right: DataFrame, right_key: str, name: str, ignore_case: bool = False) -> DataFrame:
    """Adds `name`: whether the key is among the right ones. A null key is in if a null is."""
    fold = F.lower if ignore_case else (lambda c: c)
    k, m = free_names(left, "k", "m")
    keys = right.select(fold(F.col(right_key)).alias(k), F.lit(True).alias(m)).distinct()
    return left.join(keys, fold(F.col(key)).eqNullSafe(F.col(k)), "left").withColumn(name, F.col(m).isNotNull()).drop(*(c for c in (k, m) if c != name))


def left_chain(first: DataFrame, others: list[tuple[DataFrame, str]], on: str) -> DataFrame:
    """Left joins on one key; the columns of each other table get its prefix."""
    named = [d.select(on, *(F.col(c).alias(f"{p}{c}") for c in d.columns if c != on)) for d, p in others]
    return reduce(lambda a, b: a.join(b, on, "left"), named, first)


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    """Set equality, as an assertion before a join that relies on it."""
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def threshold_sweep(df: DataFrame, column: str, steps: int = 100) -> DataFrame:
    """(threshold, n): rows at or over each of i / steps. One count for each step that a row passes
    first, then a running sum from above: rows are counted once, not for every threshold."""
    at = F.least(F.lit(steps), F.floor(F.col(column) * steps + 1e-9)).cast("int")
    counts = df.where(F.col(column) >= 0).groupBy(at.alias("__i")).agg(F.count("*").alias("__c"))
    grid = df.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("__i"))
    above = F.sum(F.coalesce("__c", F.lit(0))).over(W.orderBy(F.desc("__i")))  # steps rows
    return grid.join(counts, "__i", "left").select((F.col("__i") / float(steps)).alias("threshold"), above.alias("n"))


def merge_datasets(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of the first, and of the second what the first hasn't."""
    return first.unionByName(second.join(first, key, "left_anti"), allowMissingColumns=True)


def reconcile(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """(key, problem): `missing` of the wanted, `unknown` or `duplicate` of those there."""
    counts = have.groupBy(key).count()
    missing = want.select(key).distinct().join(counts, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    unknown = counts.join(want, key, "left_anti").select(key, F.lit("unknown").alias("problem"))
    return missing.unionByName(unknown).unionByName(counts.where("count > 1").select(key, F.lit("duplicate").alias("problem")))


def effective_paths(paths: DataFrame) -> DataFrame:
    """paths: module_id, path, scope, ord and others. One row per module and path: the first whose scope
    isn't test, else the last."""
    test = F.col("scope") == "test"
    w = W.partitionBy("module_id", "path").orderBy(test, F.when(test, -F.col("ord")).otherwise(F.col("ord")))
    (n,) = free_names(paths, "n")
    return paths.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def zero_filled(all_of: DataFrame, counted: DataFrame, on: str) -> DataFrame:
    """All rows of the one with the columns of the other, 0 where it has none or a null."""
    return all_of.join(counted, on, "left").na.fill(0)


def listed_only(df: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """Rows whose key is listed; an error unless each listed key is there."""
    if not listed.select(on).join(df, on, "left_anti").isEmpty():
        raise ValueError(f"listed values of {on} are missing")
    return df.join(listed, on, "left_semi")


def first_failures(projects: DataFrame, problems: dict[str, DataFrame], on: str, order: str) -> DataFrame:
    """Projects with <phase>_cause and <phase>_detail of the first problem of each phase. problems: by phase, the key, order, cause, detail."""
    for phase, df in problems.items():
        first = df.groupBy(on).agg(F.min_by(F.struct("cause", "detail"), order).alias("f"))
        projects = projects.join(first.select(on, F.col("f.cause").alias(f"{phase}_cause"), F.col("f.detail").alias(f"{phase}_detail")), on, "left")
    return projects


def right_wins(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of both by key, the right one's where both have it. Keys are unique in each."""
    return right.unionByName(left.join(right, on, "left_anti"))


def merged_in_order(left: DataFrame, right: DataFrame, on: str, pick: str) -> DataFrame:
    """Rows of both sorted by key, the greatest `pick` of equal keys."""
    return left.unionByName(right).groupBy(on).agg(F.max(pick).alias(pick)).orderBy(on)


def in_tests(documents: DataFrame, uri: str, paths: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Adds is_test: whether the longest of the paths that the document's uri begins with is a source path of scope test. paths: path, entry_kind,
    scope and the columns of on."""
    kinds = paths.select(*(on or []), "path", ((F.col("entry_kind") == "source") & (F.col("scope") == "test")).alias("is_test"))
    return longest_prefix_join(documents, uri, kinds, "path", on).withColumn("is_test", F.coalesce("is_test", F.lit(False))).drop("path")
