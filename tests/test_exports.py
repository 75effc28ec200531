"""A prepared model, read once, and its exports written in one pass."""

from functools import partial

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import model as M
from lodestone.sources import messages, readers, writers

INT = [{"id": "scala/Int#", "depth": 0}]
PROBLEM = "project_id string, module_id string, declaration_id string, message string"


def declaration(ident, module="m", **more):
    base = {"kind": "DEF", "properties": 0, "name": ident, "access": "PUBLIC", "location_path": "src", "location_uri": "A.scala", "line": 1, "col": 2, "language": "SCALA", "annotations": [], "sig_kind": "method", "type_parameters": [], "parents": [], "upper": None, "lower": None, "result": INT, "parameter_lists": []}
    return {"module_id": module, "declaration_id": ident, **base, **more}


def small_model(spark, wrap=lambda name, df: df):
    parameter = lambda implicit: {"name": "x", "type": INT, "is_implicit": implicit}
    w = [{"id": "W#", "depth": 0}]
    declarations = [
        declaration("scala/Int#", kind="CLASS", sig_kind="class", result=None), declaration("W#", kind="CLASS", sig_kind="class", properties=32, result=None),
        declaration("toW().", properties=32, parameter_lists=[[parameter(False)]], result=w), declaration("with().", parameter_lists=[[parameter(False)], [parameter(True)]]),
        declaration("plain()."), declaration("lost().", location_path="gone", properties=32),
    ]
    tables = {
        "modules": [("m", "o--p", "g", "a", "1", "c", "2.12", 3, 1)],
        "paths": [("m", "src", "source", "compile", False, None, None, None, None, None)],
        "declarations": declarations,
        "call_sites": [("m", i, None if i < 2 else i - 1, d, "f", "src", "A.scala", 1, 2, []) for i, d in ((1, "with()."), (2, "plain()."), (3, "missing()."))],
        "args": [("m", 1, 0, 2, None), ("m", 2, 0, None, "plain().")],
    }
    return M.Model(**{name: wrap(name, spark.createDataFrame(rows, messages.TABLES[name])) for name, rows in tables.items()})


def test_a_model_is_read_once_for_all_exports(spark, tmp_path):
    """Rows of each table pass once, however many exports are written."""
    seen = {name: spark.sparkContext.accumulator(0) for name in messages.TABLES}

    def counting(name, df: DataFrame) -> DataFrame:
        def count(batches):
            for b in batches:
                seen[name].add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema)

    m = small_model(spark, counting)
    assert writers.write_exports({name: partial(make, m) for name, make in M.EXPORTS.items()}, str(tmp_path / "out")) == {}
    assert {name: n.value for name, n in seen.items()} == {"modules": 1, "paths": 1, "declarations": 6, "call_sites": 3, "args": 2}
    m.forget()


def test_written_exports_are_the_exports(spark, tmp_path):
    m, to = small_model(spark), str(tmp_path / "out")
    exports = {name: make(m) for name, make in M.EXPORTS.items()}
    assert writers.write_exports({name: lambda e=e: e for name, e in exports.items()}, to) == {}
    for name, e in exports.items():
        columns = ", ".join(f"`{c}` string" for c in e.columns)
        got = [tuple(r) for r in readers.read_export(spark, to, name, columns).collect()]
        want = [tuple(r) for r in writers.encoded(e.rows).select(*(F.col(c).cast("string") for c in e.columns)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)) and got
    problems = {name: {r.message for r in readers.read_export(spark, to, name, PROBLEM, "problems").collect()} for name in ("declarations", "callsites")}
    assert problems == {"declarations": {"missing path gone", "missing declaration missing()."}, "callsites": {"missing declaration missing()."}}
    d = {r.declaration_id: r for r in exports["declarations"].rows.collect()}
    assert set(d) == {"W#", "toW().", "with().", "plain()."} and d["toW()."].is_companion and not d["W#"].is_companion
    assert d["with()."].github_url == "https://github.com/o/p/tree/c//src/A.scala#L2" and d["with()."].num_implicit_parameters == 1
    site = exports["callsites"].rows.where("callsite_id = 1").first()
    assert (site.nested_calls, site.nested_calls_count, site.nested_values_count, site.nested_declarations_length, site.local) == ("2", 1, 1, 16, "module")
    assert exports["conversions"].rows.first().to == "W#" and exports["parameters"].rows.first().parameter_id == "with().(x)"


def test_one_export_that_fails_leaves_the_others(spark, tmp_path):
    m, to = small_model(spark), str(tmp_path / "out")
    good = partial(M.export_declarations, m)
    broken = lambda: M.Export(good().judged.withColumn("name", F.raise_error(F.lit("no")).cast("string")), M.DECLARATION)
    failed = writers.write_exports({"a": good, "b": lambda: 1 / 0, "c": broken}, to)
    assert set(failed) == {"b", "c"} and "division" in failed["b"] and "no" in failed["c"]
    assert readers.read_export(spark, to, "a", ", ".join(f"`{c}` string" for c in M.DECLARATION)).count() == 4
    assert writers.write_exports({"b": lambda: 1 / 0}, to).keys() == {"b"}


def test_values_with_quotes_line_ends_and_nulls_come_back(spark, tmp_path):
    rows = [("p", "m", "d1", 'a "b", c\nd', None), ("p", "m", "d2", "", None), ("p", "m", "d3", None, None), ("p", "m", "d4", "x", "why\nnot")]
    judged = spark.createDataFrame(rows, "project_id string, module_id string, declaration_id string, name string, __problem string")
    assert writers.write_exports({"e": lambda: M.Export(judged, ["declaration_id", "name"])}, str(tmp_path / "o")) == {}
    got = {tuple(r) for r in readers.read_export(spark, str(tmp_path / "o"), "e", "declaration_id string, name string").collect()}
    assert got == {("d1", 'a "b", c\nd'), ("d2", None), ("d3", None)}
    assert readers.read_export(spark, str(tmp_path / "o"), "e", PROBLEM, "problems").first().message == "why\nnot"


def test_roots_by_doubling(spark):
    """Chains, a tree and a node alone; a cycle is an error."""
    chain = [("m", i, i - 1) for i in range(1, 70)]
    nodes = spark.createDataFrame([("m", i) for i in range(70)] + [("n", i) for i in range(5)], "module_id string, call_site_id int")
    owners = spark.createDataFrame(chain + [("n", 1, 0), ("n", 2, 0), ("n", 3, 2)], "module_id string, call_site_id int, owner int")
    got = {(r.module_id, r.call_site_id): r.root for r in M.roots_of(nodes, owners).collect()}
    assert got == {("m", i): 0 for i in range(70)} | {("n", 0): 0, ("n", 1): 0, ("n", 2): 0, ("n", 3): 0, ("n", 4): 4}
    with pytest.raises(ValueError, match="cycle"):
        M.roots_of(nodes, spark.createDataFrame([("m", 1, 2), ("m", 2, 1)], owners.schema))




def test_modules_and_places_are_joined_to_exported_rows_alone(spark):
    """What is written of all declarations and call sites has nothing of their places, and exports have it all the same."""
    m = small_model(spark)
    p = m.prepared()
    assert not {"link", "def_known", "m_group_id", "site_known"} & {*p.declarations.columns, *p.sites.columns}
    rows = {r.declaration_id: r for r in M.export_declarations(m).rows.collect()}
    assert {*rows} == {"W#", "toW().", "with().", "plain()."} and all(r.def_artifact_id == "a" and r.github_url for r in rows.values())
    m.forget()


def test_conversions_leave_no_tables_of_their_rounds(spark):
    """And follow the types of modules alone that have a declaration which may be a conversion."""
    from lodestone.operators import lineage

    m = small_model(spark)
    d = m.prepared().declarations
    alone = d.where("declaration_id = 'plain().'").withColumn("module_id", F.lit("other"))
    assert {r.module_id for r in M.in_modules_of(d.where("properties = 32"), d.unionByName(alone)).collect()} == {"m"}
    before = set(lineage._written)
    assert M.export_conversions(m).rows.count() > 0
    left = [set(spark.read.parquet(path).columns) for path in lineage._written if path not in before]
    assert left and not [columns for columns in left if columns & {"goes", "way", "place", "up", "itself"}]
    m.forget()


def test_shuffles_of_a_long_write_are_removed(spark, monkeypatch):
    import time

    from lodestone.operators import lineage

    monkeypatch.setattr(lineage, "LONG", 0.0)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {name for name in (disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())) if name.startswith("shuffle_")}
    before = shuffles()
    out = lineage.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    made = shuffles() - before
    assert made
    for _ in range(20):  # the last write's events may be under way still
        lineage.forget(lineage.materialise(spark.range(1)))
        if not shuffles() & made:
            break
        time.sleep(0.25)
    assert not shuffles() & made and out.count() == 7
    lineage.forget(out)
