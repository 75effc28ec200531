"""Cutting the lineage of iterative queries by tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables written and not forgotten yet, with the session that wrote each; removed when the driver's Python ends.
_written: dict[str, SparkSession] = {}
#: Seconds of a write from which its shuffles are worth being collected before the next.
LONG = 2.0
#: Sessions with such a write since they last collected.
_shuffled: dict[SparkSession, bool] = {}
#: What settled() has to delete.
_on_the_way: ContextVar[list[DataFrame] | None] = ContextVar("on_the_way", default=None)
#: The column and the number of buckets by which materialise() keeps rows together.
_together: ContextVar[tuple[str, int] | None] = ContextVar("together", default=None)
#: Lets joins by more columns use what is kept together by one of them.
SUBSET_OF_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Sizes up to which a join broadcasts: by the size of files, and by what was measured after a shuffle.
BY_FILES, BY_ROWS = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: How many files a task writes at a time before it sorts its rows by file; a task that writes a bucket, or the exports of one, needs no sort.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Filters that joins imply, as that keys aren't null: with one above it, a part of a union isn't seen to be kept together (Spark 4.1).
IMPLIED = "spark.sql.constraintPropagation.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one if the executors
    are threads of this process, as in tests; an error on a cluster, whose machines would not see it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        folder = sc.getCheckpointDir()
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has already stopped
        pass


@atexit.register
def _remove_all() -> None:
    while _written:
        path, spark = _written.popitem()
        _remove(spark, path)


def keep_until_end(spark: SparkSession, path: str) -> str:
    """The path, to be removed when the driver's Python ends."""
    _written[path] = spark
    return path


def _dropped(spark: SparkSession, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS `{path.rsplit('/', 1)[1].replace('-', '_')}`")
    except Exception:  # the session has already stopped
        pass
    _remove(spark, path)


@contextmanager
def kept_together(spark: SparkSession, key: str, buckets: int) -> Iterator[None]:
    """What materialise() writes here and has column key is in buckets by it, so that joins and groups by key, or by key and more, shuffle neither
    side. For keys that have few rows each beside a bucket. Only jobs that run in here profit. Ids repeat in all modules, so that a table of millions of
    rows is a few MB of Parquet: by the size of its files it would be collected and broadcast by the driver, so joins broadcast by measured size alone."""
    was, token = spark.conf.getAll, _together.set((key, buckets))
    new = {SUBSET_OF_KEYS: "false", BY_FILES: "-1", BY_ROWS: was.get(BY_ROWS) or spark.conf.get(BY_FILES), WRITERS: "8", IMPLIED: "false"}
    for c, value in new.items():
        spark.conf.set(c, value)
    try:
        yield
    finally:
        for c in new:
            spark.conf.set(c, was[c]) if c in was else spark.conf.unset(c)
        _together.reset(token)


def dealt(df: DataFrame, column: str) -> DataFrame:
    """df with the rows where kept_together() wants them, by the column that its key will be made of; elsewhere df."""
    return df.repartition(_together.get()[1], column) if _together.get() else df


def pieces(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Their union by name, of which gathered() writes one after the other: a union doesn't know where rows are, even if its parts do."""
    out = df
    for x in more:
        out = out.unionByName(x)
    out.pieces = (df, *more)
    return out


def made_in_place(df: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """make(df), not written, if df is said to be `cheap`: made by expressions from tables that are kept together. What reads a few columns of it evaluates
    these alone, which takes less than to write and read all. None where that isn't so."""
    return make(df) if _together.get() is not None and getattr(df, "cheap", False) else None


def held(df: DataFrame) -> DataFrame:
    """df as the side of a join that isn't broadcast by the size of its files: ids repeat in all modules, so that a table of millions of rows is a few MB of Parquet, which
    the driver would collect. Where tables are kept together a task holds its bucket of df, the smaller side, and streams the other past it; elsewhere both are sorted."""
    return df.hint("merge" if _together.get() is None else "shuffle_hash")


def gathered(df: DataFrame, make: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """materialise() of make(df), which takes rows by themselves; of pieces(), each is written where it is."""
    parts = getattr(df, "pieces", (df,))
    return materialise(make(df)) if _together.get() is None else materialise(*map(make, parts))


def materialise(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and outlives
    any executor. The files go with forget(), or when the driver's Python ends. More tables of the same columns are added to it."""
    spark = df.sparkSession
    path = keep_until_end(spark, f"{shared_folder(spark).rstrip('/')}/lodestone-{uuid.uuid4().hex}")
    if _shuffled.pop(spark, False):
        spark._jvm.System.gc()  # what earlier writes have shuffled has no more use: Spark removes the files once the driver has collected what refers to them
    began = time.monotonic()
    together = _together.get()
    if together and together[0] in df.columns:
        key, buckets = together
        name = path.rsplit("/", 1)[1].replace("-", "_")
        for x in (df, *(x.select(*df.columns) for x in more)):
            x.repartition(buckets, key).write.mode("append").bucketBy(buckets, key).option("path", path).saveAsTable(name)
        out = spark.table(name).withMetadata(key, {"together": name})  # a column without the table's name, which Spark 4.1 needs to see where a union of such tables is
    else:
        for x in (df, *(x.select(*df.columns) for x in more)):
            x.write.mode("append").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    if time.monotonic() - began > LONG:
        _shuffled[spark] = True
    out.materialised_at = path
    if (written := _on_the_way.get()) is not None:
        written.append(out)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, materialised, without the tables that its rounds have written; make() is no place to write what others read."""
    token = _on_the_way.set([])
    try:
        out = materialise(make())
        written = _on_the_way.get()
    finally:
        _on_the_way.reset(token)
    forget(*written[:-1])
    if (outer := _on_the_way.get()) is not None:
        outer.append(out)
    return out


def whole(make: Callable[[], DataFrame], spark: SparkSession, key: str, buckets: int) -> DataFrame:
    """What make() gives, written as it is, when all that it has written kept together by key is deleted."""
    token = _on_the_way.set([])
    try:
        with kept_together(spark, key, buckets):
            found = make()
            inner = _together.set(None)
            try:
                out = materialise(found)
            finally:
                _together.reset(inner)
        written = _on_the_way.get()
    finally:
        _on_the_way.reset(token)
    forget(*written[:-1])
    if (outer := _on_the_way.get()) is not None:
        outer.append(out)
    return out


def counted(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """materialise(), and how many rows meet the condition, counted while they are written."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count_if(condition).alias("n")))
    return out, seen.get["n"]


def forget(*dfs: DataFrame) -> None:
    """Delete the files of what materialise() returned, once nothing that reads them will run again. Files of shuffles go when Spark's
    cleaner finds that nothing refers to them any more (spark.cleaner.periodicGC.interval)."""
    for df in dfs:
        path = getattr(df, "materialised_at", None)
        if path in _written:
            _dropped(_written.pop(path), path)
