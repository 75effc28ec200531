"""Registered queries on small tables against plain Python."""

from hashlib import md5

import duckdb

from lodestone.plans import oracle_sql, queries


def documents(spark, path, rows):
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_project_originals_count_hosted_clones(spark, tmp_path):
    d = documents(spark, tmp_path, [(1, "a b c", "p"), (2, "d e f", "p"), (3, "a b c", "q"), (4, "x y z", "q"), (5, "a b c", "r"), (6, "k l m", "s")])
    got = {(r.project, r.files, r.unique_files, r.contained_clones) for r in queries()["agg_31_project_originals"](spark, d).collect()}
    assert got == {("p", 2, 1, 0), ("q", 2, 1, 1), ("r", 1, 0, 2), ("s", 1, 1, 0)}


def test_merge_and_reconciliation_take_whole_tables(spark, tmp_path):
    d = documents(spark, tmp_path, [(1, "a", "p"), (5, "b", "p"), (6, "c", "q"), (7, "b", "q")])
    spark.createDataFrame([(1, "c"), (5, "x"), (7, "y")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    h = lambda t: md5(t.encode()).hexdigest()
    got = {(r.project, r.file_id, r.hash) for r in queries()["joi_27_merged_datasets"](spark, d).collect()}
    assert got == {("p", 1, h("a")), ("p", 5, h("b")), ("q", 6, h("c")), ("q", 7, h("b")), ("benchmark", 5, h("x")), ("benchmark", 7, h("y"))}
    got = {(r.hash, r.problem) for r in queries()["joi_30_reconciliation"](spark, d).collect()}
    assert got == {(h("x"), "missing"), (h("y"), "missing"), (h("a"), "unknown"), (h("b"), "unknown"), (h("b"), "duplicate")}


def test_longest_prefix_has_paths_of_all_pages(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.b/c/d?q"), (2, "http://e.f"), (3, "http://a.b/x")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.path) for r in queries()["joi_05_longest_prefix"](spark, str(tmp_path)).collect()}
    assert got == {(1, "http://a.b/c"), (2, "http://e.f"), (3, "http://a.b/x")}


def test_counts_in_order_has_all_brands(spark, tmp_path):
    spark.createDataFrame([(f"b{i:02}",) for i in range(12) for _ in range(1 + i % 3)], "p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = [(r.p_brand, r.n) for r in queries()["srt_01_counts_in_order"](spark, str(tmp_path)).collect()]
    assert got == sorted(((f"b{i:02}", 1 + i % 3) for i in range(12)), key=lambda x: (-x[1], x[0]))


def test_ratio_of_nulls_and_negatives_is_that_of_its_sql(spark, tmp_path):
    values = (None, -1.0, -0.0, 0.0, 0.5, float("inf"), float("nan"))
    rows = [(i * 10 + j, i, j, x, y) for i, x in enumerate(values) for j, y in enumerate(values)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(repr(r) for r in con.execute(oracle_sql()["scl_16_ratio"]).fetchall())
    assert sorted(repr(tuple(r)) for r in queries()["scl_16_ratio"](spark, str(tmp_path)).collect()) == want
