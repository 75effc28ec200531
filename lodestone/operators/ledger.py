"""Work on many keys that can stop at any point and go on: what is done is noted with its results, so that a rerun does the rest, once.

Below a folder, data/batch=<id> holds the rows of a batch and ledger/batch=<id> its keys with what became of each. A batch counts when its ledger is complete;
rows of a batch that stopped before are never read, and its keys are done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.lineage import counted, forget

def _complete(spark: SparkSession, path: str) -> list[str]:
    """Ids of the batches whose ledger is written whole; one for each batch that has been run."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger/batch=*/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    return sorted(f.getPath().getParent().getName().split("=", 1)[1] for f in found)


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    ids = _complete(spark, path)
    return spark.read.parquet(*(f"{path}/{kind}/batch={i}" for i in ids)) if ids else None


def finished(spark: SparkSession, path: str, lasting: tuple[str, ...] = ()) -> DataFrame | None:
    """Keys that are done: without an error, or with one of those that last, which another try wouldn't change. None if nothing is."""
    ledger = _read(spark, path, "ledger")
    return None if ledger is None else ledger.where(F.col("error").isNull() | F.col("error").isin(*lasting)).drop("error").distinct()


def resume(todo: DataFrame, key: list[str], work: Callable[[DataFrame], DataFrame], path: str, batches: int = 1, lasting: tuple[str, ...] = ()) -> int:
    """Do what work does with the keys of todo that aren't finished at path, in so many batches by a hash of the key; how many keys there were.

    work: from keys to rows of key, error (null, or why the key failed) and whatever the result is; a key without rows is done too. Keys of todo
    may repeat and are done once; null keys are keys."""
    spark = todo.sparkSession
    keys, done = todo.select(*key).distinct(), finished(spark, path, lasting)
    if done is not None:
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"d.{c}")) for c in key]
        keys = keys.alias("t").join(done.alias("d"), same, "left_anti")
    total = 0
    for i in range(batches):
        # once this batch is noted its keys are finished, so a later batch of the same run never sees them
        mine = keys.where(F.pmod(F.xxhash64(*key), F.lit(batches)) == i) if batches > 1 else keys
        total += _run(spark, mine, key, work, path)
    return total


def _run(spark: SparkSession, keys: DataFrame, key: list[str], work: Callable[[DataFrame], DataFrame], path: str) -> int:
    keys, n = counted(keys, F.lit(True))
    if n:
        batch = uuid.uuid4().hex
        work(keys).write.parquet(f"{path}/data/batch={batch}")
        rows = spark.read.parquet(f"{path}/data/batch={batch}").select(*key, "error")
        errors = rows.groupBy(*key).agg(F.min("error").alias("error"))
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"e.{c}")) for c in key]
        keys.alias("k").join(errors.alias("e"), same, "left").select("k.*", "e.error").write.parquet(f"{path}/ledger/batch={batch}")
    forget(keys)
    return n


def results(spark: SparkSession, path: str, lasting: tuple[str, ...] = ()) -> DataFrame | None:
    """The rows of all finished keys, without those of tries that failed; None if no batch is complete."""
    data = _read(spark, path, "data")
    return None if data is None else data.where(F.col("error").isNull() | F.col("error").isin(*lasting))
