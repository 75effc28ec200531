"""The code-corpus operators on small fixtures, golden values from FIXTURES.md."""

import random
import struct
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.feather
import pytest
from pyspark.sql import functions as F

from lodestone.functions import predicates as P
from lodestone.functions import rstats
from lodestone.functions import scalars as S
from lodestone.operators import clones, joins, model, ranks, types
from lodestone.sources import messages, readers, seeks, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("version", "compatible", "bucket"),
    [("0.13.5", True, ">= 0.13.5"), ("0.14.0", False, "Unknown"), ("1.0.0", True, ">= 1.0"), ("1.2.0-RC1", True, ">= 1.0"), ("1.2", None, "Unknown"), (None, None, "Unknown"), ("0.12.4", False, "< 0.13.5")],
)
def test_sbt_versions(spark, version, compatible, bucket):
    v = F.lit(version).cast("string")
    assert one(spark, S.is_compatible_sbt(v)) is compatible
    assert one(spark, S.sbt_bucket(v)) == bucket


@pytest.mark.parametrize(("x", "y", "r"), [(0, 0, 0.0), (0, 5, 0.0), (3, 0, float("inf")), (1, 2, 0.5), (None, 1, None)])
def test_ratio(spark, x, y, r):
    assert one(spark, S.ratio(F.lit(x).cast("int"), F.lit(y).cast("int"))) == r


@pytest.mark.parametrize(
    ("symbol", "owner", "unit"),
    [
        ("p/o.f().[T]", "p/o.f().", "p/o."), ("p/o.f().(x)", "p/o.f().", "p/o."), ("p/o.f(+1).", "p/o.", "p/o."), ("p/Semigroup.Ops#m().", "p/Semigroup.Ops#", "p/Semigroup."),
        ("p/A#", "p/", "p/A#"), ("p/q/", "p/", None), ("local1::2", "", None), ("p/`a.b`#x.", "p/`a.b`#", "p/`a.b`#"),
    ],
)
def test_symbols(spark, symbol, owner, unit):
    assert one(spark, S.symbol_owner(F.lit(symbol))) == owner
    assert one(spark, S.compilation_unit(F.lit(symbol))) == unit


def test_paths_and_scopes(spark):
    assert one(spark, S.patched_path(F.lit("../../a/b"))) == "/a/b" and one(spark, S.patched_path(F.lit("a/../b"))) == "a/../b"
    scope = lambda *x: one(spark, S.location_scope(*(F.lit(v).cast(t) for v, t in zip(x, ("string", "string", "boolean", "boolean", "boolean")))))
    assert scope("source", "compile", False, None, None) == "compile"
    assert scope("class", "test", True, False, True) == "test;managed;dependency;transitive"
    assert scope("class", "compile", True, True, False) == "compile;managed"
    assert scope(None, None, None, None, None) is None
    assert one(spark, S.code_snippet(F.lit("a\n" * 40))) == "a " * 25 + "..."
    assert one(spark, S.github_url(*map(F.lit, ("o--r", "c", "src", "A.scala")), F.lit(4))) == "https://github.com/o/r/tree/c//src/A.scala#L5"
    assert one(spark, S.github_url(*map(F.lit, ("o--r", "c", "src", "A.scala")), F.lit(None).cast("int"))).endswith("/A.scala")
    assert one(spark, S.without_version(F.lit("o--r::g:a:1.0:jvm"))) == "o--r::g:a:jvm"
    assert one(spark, S.format_size(F.lit(1536.0))) == "1.50 kB" and one(spark, S.format_size(F.lit(1024.0))) == "1024.00 B"


def test_path_features(spark):
    f = S.path_features(F.lit("x/node_modules/left/node_modules/pad/test/i.min.js"))
    got = spark.range(1).select(*(c.alias(n) for n, c in f.items())).first().asDict()
    assert got == {"depth": 7, "npm_depth": 2, "is_test": 1, "is_locale": 0, "module": "pad", "first_module": "left", "file_name": "i", "file_ext": "min.js", "in_module": "test/i.min.js"}


def test_failure_causes(spark):
    def cause(*lines):
        return tuple(one(spark, S.failure_cause(F.array(*map(F.lit, lines)).cast("array<string>"))))

    assert cause("[error] (a / b) sbt.librarymanagement.ResolveException: unresolved dependency: org#x;1: not found") == ("missing-dependencies", "org#x;1")
    assert cause("coursier.ResolutionException: 1", "[error]   not found: y ") == ("missing-dependencies", "not found: y")
    assert cause("[error] (x) Compilation failed", "java.lang.OutOfMemoryError") == ("out-of-memory", "java.lang.OutOfMemoryError")
    assert cause("[error] (x) a.b.SomeException: z") == ("java-exception", "a.b.SomeException: z")
    assert cause("[error] p", "ok", "[error] q") == ("unknown", "[error] p\n[error] q") and cause("ok") == ("unknown", None)


def test_sums_top_and_summaries(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3), ("c", 3), ("d", None)], "k string, v int")
    assert {r.k: r.s for r in df.groupBy("k").agg(rstats.sum_strict(F.col("v")).alias("s")).collect()} == {"a": None, "b": 5, "c": 3, "d": None}
    assert sorted(r.k for r in rstats.top_n(df, 1, "v").collect()) == ["b", "c"]
    assert rstats.add_num(df.where("k = 'c'"), "v", "x").first().asDict() == {"key": "x", "sum": 3.0, "n": 1, "mean": None, "median": None, "sd": None, "min": None, "max": None}


PARAM = f"array<array<struct<name: string, type: {types.REF}, is_implicit: boolean>>>"
DECL = f"module_id string, declaration_id string, kind string, sig_kind string, properties int, location_uri string, parameter_lists {PARAM}, type_parameters array<string>, parents array<{types.REF}>, upper {types.REF}, lower {types.REF}, result {types.REF}"


def test_conversion_rules(spark):
    one = lambda *ids: [(x, i) for i, x in enumerate(ids)]
    p, i = ("x", one("scala/Int#"), False), ("y", one("scala/Int#"), True)
    rows = [("g1", [[p]], "R#"), ("g2", [[p], [i]], "R#"), ("g3", [[p], [i, i]], "R#"), ("n1", [[p]], "scala/Unit#"), ("n2", [[p], [p]], "R#"), ("n3", [[p, p], [i]], "R#"), ("n4", [[p], [p], [i]], "R#"), ("n5", [[p]], "alias#"), ("g5", [[p]], "other#")]
    of = lambda n, kind, sig, bits, lists=(), params=(), parents=(), upper=None, lower=None, result=None: ("m", n, kind, sig, bits, "A.scala", list(lists), list(params), list(parents), upper, lower, result)
    decls = [of(f"p/o.{n}().", "DEF", "method", 32, lists, result=one(ret)) for n, lists, ret in rows]
    decls += [of("alias#", "TYPE", "type", 0, upper=one("alias2#")), of("alias2#", "TYPE", "type", 0, lower=one("scala/Unit#")), of("other#", "TYPE", "type", 0, upper=one("R#")), of("loop#", "TYPE", "type", 0, upper=one("loop#"))]
    f1 = lambda a, b: [(P.FUNCTION1, 0), (a, 1), (b, 1)]
    decls += [of("List#", "CLASS", "class", 0, params=["L"], parents=[[("Seq#", 0), ("L", 1)]]), of("Seq#", "TRAIT", "class", 0, params=["S"], parents=[f1("scala/Int#", "S")]), of("Proc#", "CLASS", "class", 0, parents=[f1("A#", P.UNIT)])]
    decls += [of("Fun#", "TYPE", "type", 0, params=["X"], upper=f1("X", "R#")), of(P.FUNCTION1, "TRAIT", "class", 0, params=["A", "B"]), of("R#", "CLASS", "class", 0), of("scala/Int#", "CLASS", "class", 0), of(P.UNIT, "CLASS", "class", 0)]
    decls += [of("p/o.deck.", "VAL", "method", 32, result=[("List#", 0), ("Card#", 1)]), of("p/o.bad.", "VAL", "method", 32, result=one("Proc#")), of("p/o.fun.", "VAR", "method", 32, result=[("Fun#", 0), ("Card#", 1)])]
    decls += [of("p/o.obj.", "OBJECT", "class", 32, parents=[one("R#"), [("Seq#", 0), ("Card#", 1)]]), of("p/o.plain.", "OBJECT", "class", 32, parents=[one("R#")]), of("p/o.not.", "VAL", "method", 0, result=[("List#", 0), ("Card#", 1)])]
    got = model.conversion_types(spark.createDataFrame(decls, DECL)).select("declaration_id", types.as_code(F.col("from")).alias("f"), types.as_code(F.col("to")).alias("t")).collect()
    defs = {(f"p/o.{n}().", "scala/Int#", dict((x, r) for x, _, r in rows)[n]) for n in ("g1", "g2", "g3", "g5")}
    assert {tuple(r) for r in got} == defs | {("p/o.deck.", "scala/Int#", "Card#"), ("p/o.fun.", "Card#", "R#"), ("p/o.obj.", "scala/Int#", "Card#")}


def test_companions_need_an_implicit_class(spark):
    d = spark.createDataFrame([("m", "A().", "DEF", "method", 32, [[("x", [("scala/Int#", 0)], False)]], [("A#", 0)]), ("m", "A#", "CLASS", "class", 32, [], None), ("m", "B().", "DEF", "method", 32, [[("x", [("scala/Int#", 0)], False)]], [("B#", 0)]), ("m", "B#", "CLASS", "class", 0, [], None)], f"module_id string, declaration_id string, kind string, sig_kind string, properties int, parameter_lists {PARAM}, result {types.REF}")
    assert [r.declaration_id for r in model.companions(d).collect()] == ["A()."]


SITES = "module_id string, call_site_id int, parent_id int, declaration_id string"
ARGS = "module_id string, call_site_id int, callsite_id int, declaration_id string"


@pytest.mark.parametrize(
    ("sites", "args", "want"),
    [
        ([(1, 2, "b"), (2, None, "f")], [(2, None, "a"), (2, 1, None)], {2: (1, 1, 2)}),
        ([(1, 2, "a"), (2, None, "f")], [(2, 1, None)], {2: (1, 0, 1)}),
        ([(1, 2, "tcSeq"), (2, 3, "tcSeq"), (3, None, "f")], [(1, None, "ta"), (2, 1, None), (3, 2, None)], {3: (2, 1, 12)}),
        ([(1, 2, "a"), (2, 3, "a2b"), (3, 4, "b2c"), (4, None, "f")], [(2, 1, None), (3, 2, None), (4, 3, None)], {4: (3, 0, 7)}),
        ([(1, None, "x"), (2, 3, "a1"), (3, None, "c")], [(1, None, "a2"), (3, 2, None)], {1: (0, 1, 2), 3: (1, 0, 2)}),
        ([(1, None, "x")], [], {}),
        ([(i, i + 1 if i < 150 else None, "c") for i in range(1, 151)], [(i + 1, i, None) for i in range(1, 150)], {150: (149, 0, 149)}),
    ],
)
def test_nested_statistics(spark, sites, args, want):
    s = spark.createDataFrame([("m", *x) for x in sites], SITES)
    a = spark.createDataFrame([("m", *x) for x in args], ARGS)
    names = sorted({x[2] for x in sites} | {x[2] for x in args if x[2]})
    n = spark.createDataFrame([("m", x, x) for x in names], "module_id string, declaration_id string, name string")
    assert {r.call_site_id: (r.calls, r["values"], r.chars) for r in model.nested_stats(s, a, n).collect()} == want


def test_call_sites_that_nest_in_a_cycle_are_an_error(spark):
    s = spark.createDataFrame([("m", 1, 2, "a"), ("m", 2, 1, "a")], SITES)
    with pytest.raises(ValueError, match="cycle"):
        model.nested_stats(s, spark.createDataFrame([("m", 1, 2, None), ("m", 2, 1, None)], ARGS), spark.createDataFrame([("m", "a", "a")], "module_id string, declaration_id string, name string"))


def test_quantiles_and_running_totals(spark):
    g = random.Random(1)
    rows = [(g.choice("ab"), g.choice([None, *range(40)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v int")
    for by in ([], ["k"]):
        got = {tuple(r[c] for c in by): (r.q0, r.q1, r.q2) for r in ranks.quantiles(df, "v", [0.25, 0.5, 0.9], by).collect()}
        groups = {}
        for k, v in rows:
            if v is not None:
                groups.setdefault((k,) if by else (), []).append(v)
        assert got == {k: tuple(map(float, np.quantile(v, [0.25, 0.5, 0.9]))) for k, v in groups.items()}
    ids = {r.v: r.id for r in clones.hash_ids(df.where("v IS NOT NULL").withColumn("o", F.col("v") * 2), "v", "o").collect()}
    assert ids == {v: i for i, v in enumerate(sorted({v for _, v in rows if v is not None}))}
    drawn = P.sample_strata(df, "k", 30, 7)
    assert {r.k: r["count"] for r in drawn.groupBy("k").count().collect()} == {"a": 30, "b": 30} and drawn.join(df.distinct(), ["k", "v"], "left_anti").where("v IS NOT NULL").count() == 0


def test_empty_last_list_is_implicit(spark):
    c = F.lit(None).cast(PARAM)
    assert one(spark, P.is_implicit_declaration(F.lit(0), c)) is False
    empty = F.array(F.array().cast(PARAM[len("array<") : -1]))
    assert one(spark, P.is_implicit_declaration(F.lit(0), empty)) is True and one(spark, F.size(P.implicit_parameters(empty))) == 0


def test_paths_kept(spark):
    rows = [("m", "a", "test", 0), ("m", "a", "compile", 1), ("m", "a", "compile", 2), ("m", "b", "test", 0), ("m", "b", "test", 1)]
    got = joins.effective_paths(spark.createDataFrame(rows, "module_id string, path string, scope string, ord int")).collect()
    assert {(r.path, r.scope, r.ord) for r in got} == {("a", "compile", 1), ("b", "test", 1)}


def test_joins(spark):
    uris = spark.createDataFrame([(1, "a/b/c"), (2, "a/x"), (3, "z"), (3, "z")], "id int, uri string")
    paths = spark.createDataFrame([("a/",), ("a/b/",), ("q",)], "path string")
    assert sorted((r.id, r.path) for r in joins.longest_prefix_join(uris, "uri", paths, "path").na.fill("-").collect()) == [(1, "a/b/"), (2, "a/"), (3, "-"), (3, "-")]
    left = spark.createDataFrame([("A",), (None,), ("c",)], "k string")
    marks = joins.mark_join(left, "k", spark.createDataFrame([("a",), ("a",), (None,)], "j string"), "j", "m", ignore_case=True).collect()
    assert {(r.k, r.m) for r in marks} == {("A", True), (None, True), ("c", False)}
    assert joins.same_sets(left, left) and not joins.same_sets(left, left.limit(1))


def test_duplication_needs_two_projects(spark):
    files = spark.createDataFrame([("p", 1, "h"), ("p", 2, "h"), ("q", 3, "i"), ("r", 4, "i"), ("r", 5, "j")], "project string, file_id int, hash string")
    got = {r.project: (r.n_files, r.n_duplicated_files, r.duplication) for r in clones.project_duplication(files).collect()}
    assert got == {"p": (2, 0, 0.0), "q": (1, 1, 1.0), "r": (2, 1, 0.5)}


def test_tokens(spark):
    texts = ["int x = y; // note\n\n/* a\nb */ x", "", None, "/* one\n\ntwo */\ncode // c\n// only\n", "a b a\r\n a;a", "/* never ends\n x", ";\n \t\n"]
    f = spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")
    got = {r.file_id: (r.lines, r.sloc, r.loc, r.total_tokens, r.unique_tokens) for r in clones.file_statistics(f).collect()}
    assert got == {0: (3, 3, 2, 4, 3), 1: (0, 0, 0, 0, 0), 2: (0, 0, 0, 0, 0), 3: (5, 5, 1, 1, 1), 4: (1, 2, 2, 5, 2), 5: (1, 2, 0, 0, 0), 6: (2, 1, 1, 0, 0)}
    bags = {r.file_id: r.line for r in clones.token_bags(f).collect()}
    assert set(bags) == {0, 3, 4} and bags[4].count("@@::@@4") == 1
    assert {(r.token, r.uses) for r in clones.token_counts(f.where("file_id = 4")).collect()} == {("a", 4), ("b", 1)}


def test_containment_against_brute_force(spark):
    g = random.Random(4)
    rows = [(f"p{p}", f"h{g.choice([0, *range(8 * (p % 3), 8 * (p % 3) + 6)])}", g.randint(1, 4)) for p in range(9) for _ in range(12)]
    df = spark.createDataFrame(rows, "project string, token_hash string, total_tokens int")
    count = Counter((p, h) for p, h, n in rows if n >= 2)
    total = Counter(p for p, h, n in rows if n >= 2)
    for least in (10, 50, 80, 100):
        want = set()
        for a in total:
            for b in total:
                shared = [h for h in {h for _, h, _ in rows} if count[a, h] and count[b, h]]
                x, y = sum(count[a, h] for h in shared), sum(count[b, h] for h in shared)
                if a < b and shared and max(x * 100 // total[a], y * 100 // total[b]) >= least:
                    want.add((a, b, x, y))
        assert {(r.clone, r.host, r.cloned_files, r.affected_files) for r in clones.project_clones(df, min_percent=least).collect()} == want


def test_absorbed_groups(spark):
    groups = {1: "abc", 2: "ab", 3: "abc", 4: "cd", 5: "d", 6: "x"}
    pairs = spark.createDataFrame([(k, f) for k, v in groups.items() for f in v], "group_id int, file_id string")
    assert {r.group_id for r in clones.absorbed_groups(pairs).collect()} == {1, 4, 6}


def test_frames(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"".join(struct.pack(">i", len(m)) + m for m in (b"abc", b"", b"z" * 300)))
    got = readers.unframed(spark.read.format("binaryFile").load(str(tmp_path / "x.bin")).select("path", "content")).orderBy("ordinal").collect()
    assert [bytes(r.message) for r in got] == [b"abc", b"", b"z" * 300]
    assert bytes(one(spark, writers.framed(F.lit(b"abc")))) == b"\0\0\0\3abc"
    assert list(readers.frames(b"\x03abc\x00", "varint")) == [b"abc", b""]
    with pytest.raises(OSError, match="within"):
        list(readers.frames(b"\0\0\0\5abc"))


def project(name):
    ref = lambda i, *a: {"id": i, "args": list(a)}
    place = {"path": "src", "uri": "A.scala", "position": {"start_line": 3, "start_col": 4, "end_line": 3, "end_col": 9}}
    method = {"method": {"type_parameters": [ref("f().[T]")], "parameter_lists": [{"parameters": [{"name": "x", "type": ref("List#", ref("f().[T]")), "is_implicit": True}]}], "result": ref("R#")}}
    d = {"f().": {"declaration_id": "f().", "module_id": f"{name}::m", "kind": 0, "properties": 32, "name": "f", "access": 6, "location": place, "language": 1, "annotations": [ref("a#")], "signature": method}}
    call = {"call_site_id": 2, "parent_id": 1, "module_id": f"{name}::m", "declaration_id": "f().", "code": "f", "location": {"path": "src", "uri": "B.scala"}, "type_arguments": [ref("R#")], "args": [{"call": {"callsite_id": 1}}, {"value": {"declaration_id": "v."}}]}
    paths = {"src": {"source": {"path": "src", "scope": "compile", "managed": False}}, "l.jar": {"class": {"path": "l.jar", "group_id": "g", "artifact_id": "a", "version": "1", "scope": "test", "internal": False, "managed": True, "transitive": True}}}
    m = {"module_id": f"{name}::m", "project_id": name, "group_id": "g", "artifact_id": "a", "version": "1", "commit": "c", "scala_version": "2.12", "paths": paths, "declarations": d, "call_sites": [call], "call_sites_count": 300, "test_call_sites_count": -1}
    return {"project_id": name, "sbt_version": "1.0.0", "modules": {f"{name}::m": m}}


def test_messages(spark, tmp_path):
    data = [messages.encode(project(n), "PROJECT") for n in ("o--a", "o--b")]
    assert messages.decode(data[0], "PROJECT")["modules"]["o--a::m"]["declarations"]["f()."]["signature"]["method"]["result"]["id"] == "R#"
    (tmp_path / "m.bin").write_bytes(b"".join(struct.pack(">i", len(m)) + m for m in data))
    got = messages.read_projects(spark, str(tmp_path / "m.bin"))
    assert sorted(map(tuple, got.modules.select("module_id", "project_id", "call_sites_count", "test_call_sites_count").collect())) == [("o--a::m", "o--a", 300, -1), ("o--b::m", "o--b", 300, -1)]
    d = got.declarations.where("module_id = 'o--a::m'").first()
    assert (d.kind, d.access, d.language, d.sig_kind, d.line, d.col, d.type_parameters, d.annotations) == ("DEF", "PUBLIC", "SCALA", "method", 3, 4, ["f().[T]"], ["a#"])
    assert [(n.id, n.depth) for n in d.parameter_lists[0][0].type] == [("List#", 0), ("f().[T]", 1)] and d.upper is None
    assert {(r.pos, r.callsite_id, r.declaration_id) for r in got.args.collect()} == {(0, 1, None), (1, None, "v.")}
    assert {(r.path, r.entry_kind, r.transitive) for r in got.paths.collect()} == {("src", "source", None), ("l.jar", "class", True)}
    assert model.export_declarations(got).rows.count() == 2 and model.export_parameters(got).problems.count() == 2
    size = writers.framed_size(spark.createDataFrame([(bytearray(m),) for m in data], "message binary")).first()
    assert (size.bytes, size.messages) == ((tmp_path / "m.bin").stat().st_size, 2)
    assert seeks.framed_messages(spark, str(tmp_path / "m.bin"), first=1).count() == 1


def test_jars_named_by_manifests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "lib").mkdir()
    for name, entries, others in (("in/a.jar", {"x.semanticdb": b"1", "B.semanticdb": b"2", "c.txt": b""}, "../lib/b.jar gone.jar ../lib/sub"), ("lib/b.jar", {"y.semanticdb": b"3"}, "c.jar ../in/a.jar"), ("lib/c.jar", {"z.semanticdb": b"4"}, None)):
        with zipfile.ZipFile(tmp_path / name, "w") as jar:
            for k, v in entries.items():
                jar.writestr(k, v)
            if others:
                jar.writestr("META-INF/MANIFEST.MF", f"Manifest-Version: 1.0\r\nClass-Path: {others[:9]}\r\n {others[9:]}\r\n\r\n")
    (tmp_path / "in" / "d.semanticdb").write_bytes(b"5")
    (tmp_path / "lib" / "sub").mkdir()
    (tmp_path / "lib" / "sub" / "e.semanticdb").write_bytes(b"6")
    got = readers.compiled_documents(spark, str(tmp_path / "in")).collect()
    assert sorted(bytes(r.content) for r in got) == [b"1", b"2", b"3", b"4", b"5", b"6"]


def test_dated_files_feather_and_lines(spark, tmp_path):
    logs = spark.createDataFrame([("p", "300\na.scala\nb.scala\n\n200\na.scala\nc.scala\n"), ("q", "")], "project string, value string")
    assert {tuple(r) for r in readers.dated_files(logs).collect()} == {("p", "a.scala", 300), ("p", "b.scala", 300), ("p", "c.scala", 200)}
    table = pa.table({"i": [1, 2, None], "s": ["a", None, "c"]})
    pa.feather.write_feather(table, tmp_path / "t.feather", compression="uncompressed")
    assert {tuple(r) for r in readers.feather(spark, str(tmp_path / "t.feather"), "i long, s string").collect()} == {(1, "a"), (2, None), (None, "c")}
    writers.write_lines(spark.createDataFrame([("x",), (None,), ("y",)], "v string"), "v", str(tmp_path / "lines"))
    assert sorted(r.value for r in readers.lines(spark, str(tmp_path / "lines")).collect()) == ["x", "y"]


def test_writers(spark, tmp_path):
    good, bad = spark.createDataFrame([("p", 1)], "project_id string, n int"), spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    failed = writers.write_all({"bad": bad, "good": good}, str(tmp_path / "all"))
    assert set(failed) == {"bad"} and spark.read.csv(str(tmp_path / "all/good"), header=True).count() == 1
    writers.write_compressed(str(tmp_path / "all/good"), str(tmp_path / "good"), spark)
    assert spark.read.parquet(str(tmp_path / "good.parquet")).first().project_id == "p" and spark.read.csv(str(tmp_path / "good.csv.gz"), header=True).first().n == "1"
    status = spark.createDataFrame([("p", None), ("q", "Error: x")], "project_id string, failure string")
    assert writers.write_extraction(status, status.limit(0), good, str(tmp_path / "ex")) == {}
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "ex/stats"), header=True).collect()} == {("p", "NA", "1"), ("q", "Error: x", "0")}
    writers.write_strided(spark.range(6).selectExpr("id", "id % 2 AS kind", "id % 3 AS stride"), str(tmp_path / "s"), "kind", "stride")
    assert spark.read.parquet(str(tmp_path / "s")).where("kind = 1 AND stride = 2").first().id == 5


def test_csv(spark, tmp_path):
    for name, text in (("o--a", 'x,y\n1,"q ""z"""\nNA,\n'), ("o--b", "x,y\n2,w\n")):
        (tmp_path / "in" / name / "m").mkdir(parents=True)
        (tmp_path / "in" / name / "m" / "t.csv").write_text(text)
    got = readers.project_csvs(spark, str(tmp_path / "in"), "m/t.csv", "x int, y string").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("o--a", 1, 'q "z"'), ("o--a", None, None), ("o--b", 2, "w")]))
    text = '1,"a\\"b","c\\nd"\n2,"q\\xz","a\\\\nb\\z"\nz,,"e\\\nf,g"\n3,"open\n4,u'
    (tmp_path / "b.csv").write_text(text)
    read = lambda decode: [tuple(r) for r in readers.backslash_csv(spark, str(tmp_path / "b.csv"), "i int, s string, t string", decode).collect()]
    assert read(True) == [(1, 'a"b', "c\nd"), (2, "qxz", "a\\nb\x1a"), (None, "", "e\nf,g"), (3, "open", None), (4, "u", None)]
    assert read(False)[:2] == [(1, 'a"b', "cnd"), (2, "qxz", "a\\nbz")]
    (tmp_path / "l.log").write_text("\n".join(map(str, range(30))) + "\n")
    assert seeks.log_tails(spark, str(tmp_path / "l.log")).first().lines == [str(i) for i in range(10, 30)]
    df = spark.createDataFrame([(True, ["a", "b"], None), (False, [], "x")], "t boolean, l array<string>, s string")
    writers.write_with_problems(df, df.limit(0), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert {tuple(r) for r in back.collect()} == {("TRUE", "a;b", "NA"), ("FALSE", "NA", "x")}
    assert writers.write_checked(df, str(tmp_path / "p")) == 2


def test_stream(spark):
    from lodestone.streaming.monthly import event_stream, windowed_counts

    q = windowed_counts(event_stream(spark, "/root/testdata/sf0.001/events.parque[t]")).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("days").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_queries_run(spark):
    import __spark_entry__ as entry

    core, _ = entry._core()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("dup_01_project_duplication", "exp_01_implicit_declarations"):
        assert core[name](spark, "/root/testdata/sf0.001").count() > 0


def test_tokens_of_a_text_are_made_once(spark):
    """Whatever reads the statistics, filters too."""
    files = spark.createDataFrame([(1, "a", "x y x"), (2, "b", "x x y"), (3, "b", " "), (4, "b", None)], "file_id long, project string, text string")
    bags = clones.file_statistics(files).select("project", "file_id", "token_hash", "total_tokens").where("total_tokens > 0").where("total_tokens >= 2")
    for rows in (bags, clones.token_bags(files)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert sorted((r.file_id, r.total_tokens) for r in bags.collect()) == [(1, 3), (2, 3)]
    assert [tuple(r) for r in clones.clone_pairs(bags).collect()] == [(2, 1)]
