"""Type references and declarations: resolution through aliases, bounds, parameters and cycles; parents in order."""

from pyspark.sql import functions as F

from lodestone.operators import types as T


def flat(tree, depth=0):
    return [(tree[0], depth), *(n for a in tree[1:] for n in flat(a, depth + 1))]


def code(tree):
    return tree[0] + ("[" + ",".join(map(code, tree[1:])) + "]" if tree[1:] else "")


INT, BOOL = ("Int",), ("Boolean",)
# id: signature, parameters, parents, upper, lower, result
ROWS = {
    "Nested": ("type", [], [], INT, INT, None),
    "A": ("type", ["A.T"], [], ("Person", ("A.T",), BOOL), None, None),
    "Id": ("type", ["Id.T"], [], ("Id.T",), None, None),
    "Id.T": ("type", [], [], None, None, None),
    "Low": ("type", [], [], None, INT, None),
    "Loop": ("type", [], [], ("Loop",), None, None),
    "Person": ("class", ["P.X", "P.Y"], [("Pair", ("P.Y",), ("P.X",)), ("Top",)], None, None, None),
    "Pair": ("class", ["Q.X", "Q.Y"], [("Function1", ("Q.X",), ("Q.Y",)), ("Top",)], None, None, None),
    "Deep": ("class", [], [("P1",), ("P2",)], None, None, None),
    "P1": ("class", [], [("Q1",)], None, None, None), "P2": ("class", [], [("Q2",)], None, None, None), "Q1": ("class", [], [("R1",)], None, None, None),
    "Q2": ("class", [], [("R1",), ("Q1",)], None, None, None), "R1": ("class", [], [], None, None, None),
    "Round": ("class", [], [("Back",)], None, None, None), "Back": ("class", [], [("Round",), ("R1",)], None, None, None),
    "v": ("value", [], [], None, None, ("A", ("Nested",))),
    **{k: ("class", [], [], None, None, None) for k in ("Int", "Boolean", "Top", "Function1")},
}
SCHEMA = f"module_id string, declaration_id string, kind string, sig_kind string, type_parameters array<string>, parents array<{T.REF}>, upper {T.REF}, lower {T.REF}, result {T.REF}"


def declarations(spark, rows=ROWS):
    tree = lambda t: t and flat(t)
    kind = {"type": "TYPE", "class": "CLASS", "value": "VAL"}
    return spark.createDataFrame([("m", i, kind[k], k, ps, [flat(p) for p in up], tree(u), tree(low), tree(r)) for i, (k, ps, up, u, low, r) in rows.items()], SCHEMA)


def refs(spark, *trees):
    return spark.createDataFrame([("m", flat(t)) for t in trees], f"module_id string, ref {T.REF}")


def test_references_as_columns(spark):
    tree = ("A", ("B", ("C",), ("D", ("E",))), ("F",), ("p/o.f().[T]",))
    rows = refs(spark, tree, ("X",))
    got = rows.select(T.as_code(F.col("ref")).alias("code"), F.transform(T.arguments(F.col("ref")), T.as_code).alias("args"), T.as_code(T.with_arguments(T.head(F.col("ref")), T.arguments(F.col("ref")))).alias("again")).collect()
    assert [(r.code, r.args, r.again) for r in got] == [(code(tree), ["B[C,D[E]]", "F", "p/o.f().[T]"], code(tree)), ("X", [], "X")]
    given = rows.limit(1).select(T.as_code(T.substitute(F.col("ref"), F.array(F.lit("F")), F.array(T.ref(F.lit("G"), T.ref(F.lit("F")))))).alias("c")).first().c
    assert given == "A[B[C,D[E]],G[G[F]],p/o.f().[T]]"


def test_resolution(spark):
    d = declarations(spark)
    wanted = [("A", ("Nested",)), ("v",), ("Low",), ("Loop",), ("gone",), ("Id", INT), ("Person", ("Nested",), ("Low",))]
    got = {code_: (once, full, missing) for code_, once, full, missing in (
        T.resolved_refs(d, refs(spark, *wanted)).withColumnRenamed("resolved", "once").drop("missing").join(T.fully_resolved_refs(d, refs(spark, *wanted)), ["module_id", "ref"])
        .select(T.as_code(F.col("ref")), T.as_code(F.col("once")), T.as_code(F.col("resolved")), "missing").collect()
    )}
    assert got["A[Nested]"] == ("Person[Nested,Boolean]", "Person[Int,Boolean]", None)
    assert got["v"][:2] == ("A[Nested]", "A[Int]") and got["Low"][0] == "Int" and got["Loop"][0] == "Loop"
    assert got["gone"] == ("gone", "gone", "gone") and got["Id[Int]"][0] == "Id.T"  # what stands for a parameter as a whole isn't replaced
    assert got["Person[Nested,Low]"][1] == "Person[Int,Int]"


def test_all_parents_in_order(spark):
    d = declarations(spark)
    resolved = T.declared_types(d)
    rows = T.all_parents(d, refs(spark, ("A", INT), ("Deep",), ("Round",), ("R1",)), resolved)
    got = rows.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("place", T.as_code(F.col("parent")).alias("c")))).alias("p")).select(T.as_code(F.col("ref")).alias("r"), "p.c").collect()
    got = {r.r: r.c for r in got}
    assert got["Deep"] == ["P1", "P2", "Q1", "R1", "Q2"]  # depth first behind the parents themselves
    assert got["Round"] == ["Back", "Round", "R1"] and "R1" not in got
    # an alias's own arguments are put in for its class's parameters
    assert got["A[Int]"][1] == "Top" and got["A[Int]"][2].startswith("Function1")


def links(spark, pairs):
    rows = [(0, i, "type" if to else "class", to, None) for i, to in pairs]
    return spark.createDataFrame(rows, "module_id int, declaration_id string, sig_kind string, upper string, lower string")


def test_long_chains_and_cycles_of_declarations(spark):
    pairs = [(f"k{i}", f"k{i + 1}") for i in range(300)] + [("k300", None)]
    pairs += [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("s", "s")]
    pairs += [(f"t{i}", f"t{i + 1}" if i < 9 else "b") for i in range(10)] + [("u", "s"), ("v", "gone")]
    target = dict(pairs)

    def resolve(i):
        seen = set()
        while target.get(i) and target[i] not in seen:
            seen.add(target[i])
            i = target[i]
        return i

    got = {r.declaration_id: r.resolved_id for r in T.resolved_types(links(spark, pairs)).collect()}
    assert got == {i: resolve(i) for i, _ in pairs}
    assert got["k0"] == "k300" and got["a"] == "a" and got["t0"] == "a" and got["u"] == "s" and got["v"] == "gone"


def test_long_inheritance(spark):
    parents = spark.createDataFrame([(0, f"c{i}", f"c{i + 1}") for i in range(40)] + [(0, "c40", "c38")], "module_id int, id string, parent_id string")
    got = {(r.id, r.ancestor_id): r.depth for r in T.ancestors(parents).collect()}
    assert got["c0", "c40"] == 40 and got["c38", "c38"] == 3 and len(got) == sum(40 - i for i in range(40)) + 3 + 2 + 1


def test_closure_doubles_its_reach(spark, monkeypatch):
    """A chain of 300 levels, a diamond with a long and a short way, in nine rounds."""
    rounds = []
    monkeypatch.setattr(T, "counted", lambda df, c, f=T.counted: rounds.append(1) or f(df, c))
    chain = [(0, i, i + 1) for i in range(300)]
    parents = spark.createDataFrame([*chain, (0, 0, 290), (1, 1, 2), (1, 2, 1), (1, 3, 3)], "module_id int, id int, parent_id int")
    got = {(r.module_id, r.id, r.ancestor_id): r.depth for r in T.ancestors(parents).collect()}
    want = {(0, i, j): j - i if i or j < 290 else 1 + j - 290 for i in range(301) for j in range(i + 1, 301)}
    want = {k: min(v, k[2] - k[1]) for k, v in want.items()} | {(1, 1, 2): 1, (1, 2, 1): 1, (1, 1, 1): 2, (1, 2, 2): 2, (1, 3, 3): 1}
    assert got == want and len(rounds) <= 9


def test_kinds_and_types_of(spark):
    rows = ROWS | {"Alias": ("type", [], [], ("Pair", INT, INT), None, None), "F": ("type", [], [], ("Function1", INT, INT), None, None), "Of": ("class", [], [("Alias",)], None, None, None)}
    d = declarations(spark, rows)
    resolved = T.declared_types(d)
    kinds = {r.declaration_id for r in T.kinds_of(d, "Function1", resolved).collect()}
    assert kinds == {"Function1", "Pair", "Person", "Alias", "F", "Of", "A"}
    closure = {r.declaration_id for r in T.kind_closure(d, resolved).where("kind_of = 'Function1'").collect()}
    assert closure == kinds - {"Function1"}
    assert {r.declaration_id for r in T.types_of(d, "Function1", resolved).collect()} == {"Function1", "F"}


def test_parameters_among_arguments(spark):
    d = declarations(spark).select("module_id", "declaration_id", F.when(F.col("declaration_id") == "Id.T", "TYPE_PARAMETER").otherwise("CLASS").alias("kind"))
    args = spark.createDataFrame([("m", "f", [flat(INT), flat(("Id.T",))]), ("m", "g", []), ("m", "h", [flat(("gone", INT))])], f"module_id string, owner string, args array<{T.REF}>")
    got = {r.owner: (r.num_type_arguments, r.num_type_argument_refs, r.missing) for r in T.count_parameters(args, d).collect()}
    assert got == {"f": (2, 1, 0), "g": (0, 0, 0), "h": (1, 0, 1)}


def test_lookups_by_module_are_not_broadcast(spark):
    """Tables whose ids repeat are small as files and large in memory: joins of them shuffle, whatever the size of the files."""
    d = spark.range(500).selectExpr("id AS module_id", "explode(array('A#', 'B#')) AS declaration_id", "'CLASS' AS kind", "'class' AS sig_kind", "CAST(array() AS array<string>) AS type_parameters", f"CAST(array() AS array<{T.REF}>) AS parents", f"CAST(null AS {T.REF}) AS upper", f"CAST(null AS {T.REF}) AS lower", f"CAST(null AS {T.REF}) AS result")
    d = T.materialise(d)
    refs = d.select("module_id", T.ref(F.col("declaration_id")).alias("ref"))
    full = T.fully_resolved_refs(d, refs)
    assert full.count() == 1000 and full.where("missing IS NOT NULL").count() == 0
    for df in (full, T.declared_types(d), T.count_parameters(refs.select("module_id", F.monotonically_increasing_id().alias("owner"), F.array("ref").alias("args")), d)):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
