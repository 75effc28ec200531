"""Aggregates of corpus studies, to be called on tables of one's own. Nulls are groups of their own unless said otherwise; ties are
broken by the columns given as order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("success", "not_run", "failed", "timed_out")


def status_of(code: Column) -> Column:
    """0 success, -1 not run, 1 failed, 130 and over timed out; null for other exit codes."""
    return F.when(code == 0, "success").when(code == -1, "not_run").when(code == 1, "failed").when(code >= 130, "timed_out")


def phase_status(df: DataFrame, phase: str, code: str) -> DataFrame:
    """(phase, all, and a count for each status); rows of another exit code count in all alone."""
    status = status_of(F.col(code))
    return df.groupBy(phase).agg(F.count("*").alias("all"), *(F.count_if(status == s).alias(s) for s in STATUSES))


def totals(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(metric, value): aggregates of the whole table, one row each."""
    wide = df.agg(*(c.cast("double").alias(k) for k, c in values.items()))
    return wide.unpivot([], list(values), "metric", "value")


def breakdown(df: DataFrame, by: str, name: str, unknown: str | None = None) -> DataFrame:
    """(name, n): rows of each value; null is counted as `unknown`, if given."""
    value = F.coalesce(F.col(by), F.lit(unknown)) if unknown else F.col(by)
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def funnel(steps: list[tuple[str, DataFrame]], by: str, name: str, sums: dict[str, str]) -> DataFrame:
    """(name, n, a sum for each of sums, step): the same aggregate of each step's rows."""
    one = lambda label, df: df.groupBy(F.col(by).alias(name)).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items())).withColumn("step", F.lit(label))
    return reduce(DataFrame.unionByName, [one(label, df) for label, df in steps])


def counts_by_sets(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """(columns of the sets, n): rows by each set of columns, others null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("n"))


def projects_with(df: DataFrame, by: str, project: str) -> DataFrame:
    """(by, n_projects): distinct projects of each value."""
    return df.groupBy(by).agg(F.countDistinct(project).alias("n_projects"))


def first_by(df: DataFrame, by: list[str], order: list[str], firsts: dict[str, str], last: bool = False) -> DataFrame:
    """(by, n, firsts): how many rows each group has, and columns of its first row in the order, or its last."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(pick(c, F.struct(*order)).alias(k) for k, c in firsts.items()))


def code_by_scope(paths: DataFrame) -> DataFrame:
    """paths: project_id, path, scope (compile or test), managed, code, ord. (project_id, code_test_managed, code_test, code_compile_managed, code_compile,
    code): lines of code, each path once for each scope and kind by its first row; null code is 0, what a project hasn't is 0."""
    first = paths.groupBy("project_id", "scope", "managed", "path").agg(F.min_by(F.coalesce("code", F.lit(0)), "ord").alias("code"))
    kind = F.concat("scope", F.when(F.col("managed"), "_managed").otherwise("_unmanaged"))
    wide = first.withColumn("kind", kind).groupBy("project_id").pivot("kind", ["test_managed", "test_unmanaged", "compile_managed", "compile_unmanaged"]).sum("code").na.fill(0)
    test, compile_ = F.col("test_managed") + F.col("test_unmanaged"), F.col("compile_managed") + F.col("compile_unmanaged")
    return wide.select("project_id", F.col("test_managed").alias("code_test_managed"), test.alias("code_test"), F.col("compile_managed").alias("code_compile_managed"), compile_.alias("code_compile"), (test + compile_).alias("code"))


def corpus_sizes(df: DataFrame, distinct: dict[str, str], rows: str) -> DataFrame:
    """One row: how many distinct values columns have, and the number of rows."""
    parts = [df.select(c).distinct().agg(F.count("*").alias(k)) for k, c in distinct.items()]
    return reduce(DataFrame.crossJoin, [*parts, df.agg(F.count("*").alias(rows))])  # one row each
