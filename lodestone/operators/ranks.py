"""Running totals and quantiles over all rows in an order, without putting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.lineage import materialise


def with_running_total(df: DataFrame, order: list[str], weight: Column, name: str) -> DataFrame:
    """Adds `name`: the weights of all rows before, in the given order, whose columns should tell rows apart.

    Rows are range-partitioned by the order; what a range's rows weigh comes from a window of its own, what the ranges before
    weigh from the driver, a number for each range."""
    ranged = materialise(df.withColumn("__weight", weight).repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()))
    sums = sorted((r["__pid"], r.w) for r in ranged.groupBy("__pid").agg(F.sum("__weight").alias("w")).collect())
    starts, total = [], 0
    for pid, w in sums:
        starts.append((pid, total))
        total += w or 0
    table = df.sparkSession.createDataFrame(starts or [(0, 0)], "__pid int, __start long")
    before = F.sum("__weight").over(W.partitionBy("__pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    rows = ranged.join(F.broadcast(table), "__pid")  # a row for each range
    return rows.withColumn(name, F.col("__start") + F.coalesce(before, F.lit(0))).drop("__pid", "__weight", "__start")


def quantiles(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, q0, q1 ...): exact quantiles, linear between neighbours, nulls left out; one row for each group, or one row.

    Equal values are counted first; a group's ranks are running totals less its start, so that no group, however
    large, is sorted in one task."""
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    ranked = with_running_total(counts, [*by, "__v"], F.col("__n"), "__before")
    ranked = materialise(ranked)
    groups = ranked.groupBy(*by).agg(F.sum("__n").alias("__all"), F.min("__before").alias("__first"))
    rows = ranked.join(groups, by) if by else ranked.crossJoin(F.broadcast(groups))  # one row
    low = F.col("__before") - F.col("__first")
    out = []
    for i, share in enumerate(shares):
        at = share * (F.col("__all") - 1)
        pick = lambda rank: F.max(F.when((low <= rank) & (rank < low + F.col("__n")), F.col("__v")))
        out += [pick(F.floor(at)).alias(f"__a{i}"), pick(F.ceil(at)).alias(f"__b{i}"), F.max(at - F.floor(at)).alias(f"__t{i}")]
    found = rows.groupBy(*by).agg(*out)
    between = lambda i: F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * F.col(f"__t{i}")
    return found.select(*by, *(between(i).alias(f"q{i}") for i in range(len(shares))))
