"""Aggregates, joins and predicates that users call, on nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import predicates as P
from lodestone.functions import rstats
from lodestone.functions import scalars as S
from lodestone.operators import analyses as A
from lodestone.operators import joins as J
from lodestone.operators import summaries as Y


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_phase_status_counts_other_codes_in_all_alone(spark):
    df = spark.createDataFrame([("a", 0), ("a", 7), ("a", None), ("a", 137), (None, -1), ("b", 1)], "phase string, code int")
    got = {r.phase: (r["all"], r.success, r.not_run, r.failed, r.timed_out) for r in Y.phase_status(df, "phase", "code").collect()}
    assert got == {"a": (4, 1, 0, 0, 1), None: (1, 0, 1, 0, 0), "b": (1, 0, 0, 1, 0)}
    assert Y.phase_status(df.limit(0), "phase", "code").count() == 0


def test_breakdowns_totals_and_funnels(spark):
    df = spark.createDataFrame([("x", 1.0), (None, 2.0), ("x", None)], "k string, v double")
    assert rows(Y.breakdown(df, "k", "b", "unknown")) == [("unknown", 1), ("x", 2)] and rows(Y.breakdown(df, "k", "b")) == [("x", 2), (None, 1)]
    assert rows(Y.totals(df, {"n": F.count("*"), "v": F.sum("v")})) == [("n", 3.0), ("v", 3.0)]
    assert rows(Y.funnel([("all", df), ("known", df.where("k IS NOT NULL"))], "k", "key", {"v": "v"})) == [("x", 2, 1.0, "all"), ("x", 2, 1.0, "known"), (None, 1, 2.0, "all")]
    assert rows(Y.counts_by_sets(df, [["k"], []])) == [("x", 2), (None, 1), (None, 3)]
    assert rows(Y.projects_with(spark.createDataFrame([("t", 1), ("t", 1), ("t", None), ("u", None)], "t string, p int"), "t", "p")) == [("t", 1), ("u", 0)]


def test_firsts_break_ties_by_the_columns_given(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 4), ("a", 2, 1), ("b", None, 9)], "k string, at int, id int")
    assert rows(Y.first_by(df, ["k"], ["at", "id"], {"first": "id"})) == [("a", 3, 4), ("b", 1, 9)]
    assert rows(Y.first_by(df, ["k"], ["at", "id"], {"last": "id"}, last=True)) == [("a", 3, 1), ("b", 1, 9)]
    assert rows(rstats.with_previous(df.where("k = 'a'").distinct(), ["k"], "id", "p").select("id", "p")) == [(1, None), (4, 1), (5, 4)]


def test_code_counts_each_path_once_by_its_first_row(spark):
    df = spark.createDataFrame([("p", "a", "test", True, 5, 2), ("p", "a", "test", True, 9, 1), ("p", "a", "compile", False, 3, 1), ("p", "b", "test", False, None, 1), ("q", "a", "compile", True, 2, 1)], "project_id string, path string, scope string, managed boolean, code int, ord int")
    assert rows(Y.code_by_scope(df)) == [("p", 9, 9, 0, 3, 12), ("q", 0, 0, 2, 2, 2)]


def test_joins_that_fill_check_and_pick(spark):
    corpus = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    counted = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    assert rows(J.zero_filled(corpus, counted, "k")) == [("a", 1), ("b", 0), ("c", 0)]
    assert rows(J.listed_only(corpus, corpus.where("k = 'b'"), "k")) == [("b",)]
    with pytest.raises(ValueError, match="missing"):
        J.listed_only(counted, corpus, "k")
    problems = spark.createDataFrame([("a", 2, "late", "x"), ("a", 1, "early", None), ("z", 1, "none", "y")], "k string, ord int, cause string, detail string")
    got = rows(J.first_failures(corpus, {"build": problems, "test": problems.limit(0)}, "k", "ord"))
    assert got == [("a", "early", None, None, None), ("b", None, None, None, None), ("c", None, None, None, None)]
    two = spark.createDataFrame([("a", 7), ("d", 8)], "k string, n int")
    assert rows(J.right_wins(counted, two, "k")) == [("a", 7), ("b", None), ("d", 8)]
    assert [tuple(r) for r in J.merged_in_order(counted, two, "k", "n").collect()] == [("a", 7), ("b", None), ("d", 8)]
    paths = spark.createDataFrame([("s/", "source", "compile"), ("s/t/", "source", "test"), ("j/", "class", "test")], "path string, entry_kind string, scope string")
    docs = spark.createDataFrame([("s/a",), ("s/t/a",), ("j/a",), ("x",)], "uri string")
    assert rows(J.in_tests(docs, "uri", paths)) == [("j/a", False), ("s/a", False), ("s/t/a", True), ("x", False)]


def test_predicates_and_accessors(spark):
    with pytest.raises(ValueError, match="no kind"):
        P.is_kind(F.lit("DEF"), "METHOD")
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(P.is_kind(F.lit("DEF"), "DEF")) and one(P.signature_field(F.lit("method"), "method", F.lit(3))) == 3
    with pytest.raises(Exception, match="not a method signature"):
        one(P.signature_field(F.lit("class"), "method", F.lit(3)))
    assert one(S.encode_enum(F.lit(1), ("A", "B"))) == "B" and one(S.encode_enum(F.lit(5), ("A", "B"))) is None
    assert str(one(S.from_epoch(F.lit(0)))).startswith("1970-01-01")
    spans, ms = S.phase_timing(F.lit("[info]   typer                  : 12 spans, ()345.5ms (1.2%)"), "typer")
    assert (one(spans), one(ms)) == (12, 345.5) and one(S.phase_timing(F.lit("[info] other : 1 spans, 2ms"), "typer")[0]) is None


def test_project_sums_are_zero_where_a_flag_is_unknown(spark):
    corpus = spark.createDataFrame([("p",), ("q",), ("r",)], "project_id string")
    flags = spark.createDataFrame([("p", True, None), ("p", False, True), ("q", True, True)], "project_id string, is_a boolean, is_b boolean")
    assert rows(A.project_sums(flags, ["is_all", "is_a", "is_b"], corpus)) == [("p", 2, 1, 0), ("q", 1, 1, 1), ("r", 0, 0, 0)]


def test_failures_and_final_corpus(spark):
    p = spark.createDataFrame([("a", 1, 1, "missing-dependencies", "x"), ("b", 0, 1, None, None), ("c", 0, 0, None, None), ("d", None, 1, None, None)], "project_id string, metadata_exit_code int, semanticdb_exit_code int, metadata_failure string, metadata_failure_detail string")
    failed = A.failed_projects(p.withColumns({"semanticdb_failure": F.lit("compilation-failed"), "semanticdb_failure_detail": F.lit(None).cast("string")}))
    causes, missing = A.failure_counts(failed)
    assert rows(causes) == [("compilation-failed", 2), ("missing-dependencies", 1)] and rows(missing) == [("x", 1)]
    corpus = spark.createDataFrame([(0, 5), (1, 5), (0, 0), (None, 5), (0, None)], "implicits_exit_code int, metadata_scala_code int")
    assert A.final_corpus(corpus).count() == 1
