"""Resumed work, and counts in buckets of flags."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.functions import rstats
from lodestone.operators import clones, joins, ledger


def work(failing=(), seen=None):
    def run(keys):
        if seen is not None:
            seen.extend(r.k for r in keys.collect())
        return keys.select("k", F.when(F.col("k").isin(*failing), "later").otherwise(F.when(F.col("k") == "gone", "for good")).alias("error"), F.length("k").alias("n"))

    return run


@pytest.mark.parametrize("batches", [1, 3])
def test_a_rerun_does_the_rest_once(spark, tmp_path, batches):
    to, todo = str(tmp_path / "l"), spark.createDataFrame([(k,) for k in ["a", "bb", "ccc", "gone", None, "a"]], "k string")
    seen = []
    assert ledger.finished(spark, to) is None and ledger.results(spark, to) is None
    assert ledger.resume(todo, ["k"], work(("bb",), seen), to, batches, ("for good",)) == 5
    assert sorted(map(str, seen)) == ["None", "a", "bb", "ccc", "gone"]
    more = todo.union(spark.createDataFrame([("new",)], "k string"))
    seen.clear()
    assert ledger.resume(more, ["k"], work((), seen), to, batches, ("for good",)) == 2 and sorted(seen) == ["bb", "new"]
    assert ledger.resume(more, ["k"], work(), to, batches, ("for good",)) == 0
    got = sorted((str(r.k), r.n, r.error) for r in ledger.results(spark, to, ("for good",)).collect())
    assert got == [("None", None, None), ("a", 1, None), ("bb", 2, None), ("ccc", 3, None), ("gone", 4, "for good"), ("new", 3, None)]


def test_a_batch_that_stops_is_done_again(spark, tmp_path):
    """Rows without a complete ledger don't count, whether the work, the data or the ledger was cut short."""
    to, todo = str(tmp_path / "l"), spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(ZeroDivisionError):
        ledger.resume(todo, ["k"], lambda keys: 1 / 0, to)
    with pytest.raises(Exception, match="no"):
        ledger.resume(todo, ["k"], lambda keys: keys.select("k", F.raise_error(F.lit("no")).cast("string").alias("error")), to)
    ledger.resume(todo, ["k"], work(), to)
    batch = next((tmp_path / "l" / "ledger").iterdir())
    shutil.copytree(tmp_path / "l" / "data" / batch.name, tmp_path / "l" / "data" / "batch=x")
    shutil.copytree(batch, tmp_path / "l" / "ledger" / "batch=x")
    (tmp_path / "l" / "ledger" / "batch=x" / "_SUCCESS").unlink()
    assert sorted(r.k for r in ledger.results(spark, to).collect()) == ["a", "b"]


def test_keys_without_rows_are_done(spark, tmp_path):
    to, todo = str(tmp_path / "l"), spark.createDataFrame([("a", 1), ("b", 2)], "k string, i int")
    none = lambda keys: keys.where("k = 'a'").select("k", "i", F.lit(None).cast("string").alias("error"))
    assert ledger.resume(todo, ["k", "i"], none, to) == 2 and ledger.resume(todo, ["k", "i"], none, to) == 0
    assert ledger.results(spark, to).count() == 1


def test_helper_columns_give_way(spark):
    """Tables whose columns have the names that joins use beside them."""
    left = spark.createDataFrame([("a/b/c", 1, 2, 3, 4), ("x", 5, 6, 7, 8)], "uri string, row int, PREFIX int, found int, k int")
    right = spark.createDataFrame([("a/", "r", 1), ("a/b", "s", 2)], "path string, row_ string, n int")
    got = joins.longest_prefix_join(left, "uri", right, "path")
    assert got.columns == [*left.columns, "path", "row_", "n"]
    assert {tuple(r) for r in got.collect()} == {("a/b/c", 1, 2, 3, 4, "a/b", "s", 2), ("x", 5, 6, 7, 8, None, None, None)}
    assert {(r.uri, r.m) for r in joins.mark_join(left, "uri", spark.createDataFrame([("X",)], "k string"), "k", "m", ignore_case=True).collect()} == {("x", True), ("a/b/c", False)}
    paths = spark.createDataFrame([("m", "p", "test", 1, 9), ("m", "p", "compile", 2, 8)], "module_id string, path string, scope string, ord int, n int")
    assert [tuple(r) for r in joins.effective_paths(paths).collect()] == [("m", "p", "compile", 2, 8)]
    files = clones.file_statistics(spark.createDataFrame([("a b // c\n", 1, 2)], "text string, runs int, MARKED int"))
    assert files.columns[:3] == ["text", "runs", "MARKED"] and files.first()[:3] == ("a b // c\n", 1, 2) and files.first().total_tokens == 2


def test_buckets_of_flags(spark):
    g = random.Random(1)
    rows = [(g.choice([True, False, None]), g.choice([True, False]), g.choice([True, False, None]), g.choice([None, *range(-3, 12)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, m int")
    got = {(r.month, r.bucket): (r.n, r.n_with) for r in rstats.cumulative_buckets(df, [F.col("a"), F.col("b"), F.col("c")], F.col("m"), 0, 9).collect()}
    bucket = [(bool(a) + 2 * bool(b) + 4 * bool(c), m) for a, b, c, m in rows if m is not None]
    assert got == {(t, k): (sum(f == k and m <= t for f, m in bucket), sum(f & k == k and m <= t for f, m in bucket)) for t in range(10) for k in range(8)}
    empty = rstats.cumulative_buckets(df.limit(0), [F.col("a")], F.col("m"), 0, 1).collect()
    assert sorted(map(tuple, empty)) == [(0, 0, 0, 0), (0, 1, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0)]
