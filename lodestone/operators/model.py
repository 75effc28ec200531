"""The code model and its flat fact tables.

Model tables: modules, paths, declarations, call_sites, args as in FIXTURES.md. Type references are arrays
as in operators/types.py; positions are a line and a column, null where the place isn't known.

All exports read the same few joins of these tables, so a model is prepared once: Model.prepared() reads each table a single time and
writes what the exports need of it. Most declarations are in no export, so modules, libraries and places are joined to those rows alone that
an export has. Preparing runs jobs, once for a model, when the first export is asked for; so do the rounds that follow aliases, parents and nesting.

Each export has its rows and, beside them, problems: (project_id, module_id, declaration_id, message) of the rows that can't be
made, because a declaration or a path is missing. Both are parts of one table, judged, in which each row is computed once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import predicates as P
from lodestone.functions import scalars as S
from lodestone.functions.names import free_names
from lodestone.operators import types as T
from lodestone.operators.lineage import counted, forget, gathered, held, made_in_place, materialise, settled

KEY = ["module_id", "declaration_id"]
LIBRARY = ["location_scope", "group_id", "artifact_id", "version"]


@dataclass
class Model:
    modules: DataFrame
    paths: DataFrame
    declarations: DataFrame
    call_sites: DataFrame
    args: DataFrame

    def prepared(self) -> Prepared:
        """What the exports read, made when first asked for and kept with this model."""
        if "_prepared" not in self.__dict__:
            self._prepared = Prepared(self)
        return self._prepared

    def forget(self) -> None:
        """Delete what was prepared, once no export of the model will run again."""
        prepared = self.__dict__.pop("_prepared", None)
        if prepared:
            forget(*(t for t in vars(prepared).values() if isinstance(t, DataFrame)))


class Prepared:
    """Tables of a model that all exports share, each written when first used.

    places: module_id, path (patched), known, local (a source or internal path of any module of the project), location_scope and the library.
    declarations: those of the model with implicit (the declaration or its last parameter list is) and companion_of (the class that a def of the
    shape of a conversion results in). sites: call sites with there (whether the module has the declaration), the path of it, decl_path, and
    kept (PRD-16). Rows get what is known of their module and of a path by of_module() and at_place().
    """

    def __init__(self, model: Model):
        self._model = model

    @cached_property
    def modules(self) -> DataFrame:
        return materialise(self._model.modules.select("module_id", "project_id", *(F.col(c).alias(f"m_{c}") for c in ("group_id", "artifact_id", "version")), "commit"))

    @cached_property
    def places(self) -> DataFrame:
        paths, own = self._model.paths, F.col("entry_kind") == "source"
        scope = S.location_scope(*map(F.col, ("entry_kind", "scope", "managed", "internal", "transitive")))
        library = [F.when(own, F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) for c in ("group_id", "artifact_id", "version")]
        inside = own | F.coalesce("internal", F.lit(False))
        rows = materialise(paths.join(held(self.modules), "module_id").select("module_id", "project_id", S.patched_path(F.col("path")).alias("path"), inside.alias("inside"), scope.alias("location_scope"), *library))
        local = materialise(rows.where("inside").select("project_id", "path").distinct().withColumn("local", F.lit(True)))
        out = materialise(rows.join(local, ["project_id", "path"], "left").select("module_id", "path", F.lit(True).alias("known"), F.coalesce("local", F.lit(False)).alias("local"), *LIBRARY))
        forget(rows, local)
        return out

    def at_place(self, df: DataFrame, path: str, to: str) -> DataFrame:
        """Adds {to}known, {to}local and {to} library columns of the module's path."""
        (at,) = free_names(df, "at")
        places = self.places.select("module_id", F.col("path").alias(at), *(F.col(c).alias(f"{to}{c}") for c in ("known", "local", *LIBRARY)))
        return df.withColumn(at, S.patched_path(F.col(path))).join(held(places), ["module_id", at], "left").drop(at).withColumn(f"{to}known", F.coalesce(f"{to}known", F.lit(False)))

    def of_module(self, df: DataFrame) -> DataFrame:
        """Adds project_id, commit and library (m_group_id ...) of the rows' modules."""
        return df.join(held(self.modules), "module_id")

    @cached_property
    def declarations(self) -> DataFrame:
        shape = (F.col("kind") == "DEF") & (F.col("sig_kind") == "method") & P.is_conversion_shape(F.col("parameter_lists"))
        added = {"implicit": P.is_implicit_declaration(F.col("properties"), F.col("parameter_lists")), "companion_of": F.when(shape, T.head(F.col("result")))}
        make = lambda d: d.withColumns(added)
        made = made_in_place(self._model.declarations, make)
        return gathered(self._model.declarations, make) if made is None else made

    @cached_property
    def sites(self) -> DataFrame:
        implicit = F.coalesce((F.col("sig_kind") == "method") & F.col("implicit"), F.lit(False))
        d = self.declarations.select(*KEY, F.lit(True).alias("there"), implicit.alias("implicit"), F.col("location_path").alias("decl_path"))
        rows = held(self._model.call_sites).join(d, KEY, "left")
        return materialise(rows.withColumn("kept", F.col("parent_id").isNotNull() | F.coalesce("implicit", F.lit(False))).drop("implicit"))

    @cached_property
    def used(self) -> DataFrame:
        """(module_id, declaration_id, there) that kept call sites use, each once."""
        return materialise(self.sites.where("kept").groupBy(*KEY).agg(F.max(F.coalesce("there", F.lit(False))).alias("there")))

    @cached_property
    def aliases(self) -> DataFrame:
        """(module_id, declaration_id, resolved_id) of types that are another's alias; all others are their own."""
        types = self.declarations.where("sig_kind = 'type'")
        return settled(lambda: T.declared_types(types).where("resolved_id <> declaration_id"))

    @cached_property
    def classes(self) -> DataFrame:
        """(module_id, companion_of, is_companion) of implicit classes."""
        d = self.declarations.where((F.col("kind") == "CLASS") & P.has_property(F.col("properties"), P.IMPLICIT))
        return materialise(d.select("module_id", F.col("declaration_id").alias("companion_of"), F.lit(True).alias("is_companion")))

    def exported(self) -> DataFrame:
        """Declarations that are implicit or that kept call sites use, each once: with is_companion, their module, def_* of their place, and link."""
        d = self.declarations
        used = self.used.where("there").select(*KEY, F.lit(True).alias("__used"))
        rows = d.join(held(used), KEY, "left").where("implicit OR __used").drop("__used")
        rows = self.at_place(self.of_module(self.with_companions(rows)), "location_path", "def_")
        return rows.withColumn("link", _link(F.col("def_local"))).drop("def_local")

    def named(self, ids: DataFrame) -> DataFrame:
        """The declarations of ids (module_id, declaration_id), of which there are few beside all: a lookup for joins that shuffles all once."""
        d = self.declarations.select(*KEY, "kind", "location_path", "location_uri", "line", "language")
        return materialise(d.join(held(ids.select(*KEY).distinct()), KEY, "left_semi"))

    def with_companions(self, rows: DataFrame) -> DataFrame:
        return rows.join(held(self.classes), ["module_id", "companion_of"], "left").withColumn("is_companion", F.coalesce("is_companion", F.lit(False)))

    def resolved(self) -> DataFrame:
        """(module_id, declaration_id, resolved_id) of all declarations."""
        rows = self.declarations.select(*KEY).join(held(self.aliases), KEY, "left")
        return rows.select(*KEY, F.coalesce("resolved_id", "declaration_id").alias("resolved_id"))


def _link(local: Column, path: str = "location_path", uri: str = "location_uri", line: str = "line") -> Column:
    """A link to a place in the repository, null if no module of the project has its path."""
    return F.when(local, S.github_url(F.col("project_id"), F.col("commit"), F.col(path), F.col(uri), F.col(line)))


@dataclass
class Export:
    """judged has the columns of rows and, where __problem isn't null, those of problems."""

    judged: DataFrame
    columns: list[str]

    @property
    def rows(self) -> DataFrame:
        return self.judged.where("__problem IS NULL").select(*self.columns)

    @property
    def problems(self) -> DataFrame:
        return self.judged.where("__problem IS NOT NULL").select("project_id", *KEY, F.col("__problem").alias("message"))


# ---- nested call sites -------------------------------------------------------------------------


def own_arguments(call_sites: DataFrame, args: DataFrame, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(module_id, call_site_id, calls, values, chars, missing) of call sites with arguments: over their own, how many are call sites, how
    many are values, the length of the names of what they refer to, and how many refer to nothing known. With aliases also
    nested_calls and arguments, the ids of both in order, and no_value, a value that isn't known.

    args: module_id, call_site_id, pos, callsite_id (the nested one, an argument of one call site) or declaration_id (the value).
    names: module_id, declaration_id, name."""
    callees = call_sites.select("module_id", F.col("call_site_id").alias("callsite_id"), F.col("declaration_id").alias("callee"))
    own = held(args).join(callees, ["module_id", "callsite_id"], "left").withColumn("refers_to", F.coalesce("callee", "declaration_id"))
    own = held(own).join(names.select("module_id", F.col("declaration_id").alias("refers_to"), F.length("name").alias("chars")), ["module_id", "refers_to"], "left")
    more = []
    if aliases is not None:
        own = own.join(held(aliases), KEY, "left").withColumn("value", F.when(F.col("callsite_id").isNull() & F.col("chars").isNotNull(), F.coalesce("resolved_id", "declaration_id")))
        more = [
            F.array_sort(F.collect_list(F.when(F.col("callsite_id").isNotNull(), F.struct("pos", "callsite_id"))))["callsite_id"].cast("array<string>").alias("nested_calls"),
            F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("pos", "value"))))["value"].alias("arguments"),
            F.min(F.when(F.col("callsite_id").isNull() & F.col("value").isNull(), F.col("declaration_id"))).alias("no_value"),
        ]
    sums = (F.count("callsite_id").alias("calls"), F.count_if(F.col("callsite_id").isNull()).alias("values"), F.sum(F.coalesce("chars", F.lit(0))).alias("chars"), F.count_if(F.col("chars").isNull()).alias("missing"))
    return own.groupBy("module_id", "call_site_id").agg(*sums, *more)


def roots_of(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """(module_id, call_site_id, root) of nodes: module_id, call_site_id, each of which may have one owner among them or outside; owners:
    module_id, call_site_id, owner. By pointer doubling, in as many rounds as the logarithm of the deepest nesting; a round rewrites the nodes
    that aren't at their root yet, and no others. Nesting in a cycle is an error."""
    key = ["module_id", "call_site_id"]
    at = nodes.select(*key).join(owners, key, "left").select(*key, F.coalesce("owner", "call_site_id").alias("root"), F.col("owner").isNull().alias("done"))
    at, left = counted(at, ~F.col("done"))
    done, opened, before, used = at.where("done"), at.where("NOT done"), None, [at]
    while left:
        if left == before:
            raise ValueError("call sites nest in a cycle")
        before = left
        step = done.unionByName(opened).select("module_id", F.col("call_site_id").alias("root"), F.col("root").alias("next"), F.col("done").alias("next_done"))
        moved, left = counted(held(opened).join(step, ["module_id", "root"], "left").select(*key, F.coalesce("next", "root").alias("root"), F.coalesce("next_done", F.lit(True)).alias("done")), ~F.col("done"))
        done, opened = done.unionByName(moved.where("done")), moved.where("NOT done")
        used.append(moved)
    out = materialise(done.select(*key, "root"))
    forget(*used)
    return out


def stats_of_roots(own: DataFrame, args: DataFrame, top: DataFrame) -> DataFrame:
    """(module_id, call_site_id, calls, values, chars, missing) of call sites of top (module_id, call_site_id) with arguments: sums over own_arguments() of
    themselves and of all that nests in them."""
    key, sums = ["module_id", "call_site_id"], ("calls", "values", "chars", "missing")
    owners = args.where("callsite_id IS NOT NULL").select("module_id", F.col("callsite_id").alias("call_site_id"), F.col("call_site_id").alias("owner")).distinct()
    at = own.select(*key, *sums).join(roots_of(own, owners), key).groupBy("module_id", F.col("root").alias("call_site_id")).agg(*(F.sum(c).alias(c) for c in sums))
    return at.join(top, key, "left_semi")


def nested_stats(call_sites: DataFrame, args: DataFrame, names: DataFrame) -> DataFrame:
    """own_arguments() of the top call sites with an argument, of their own and of all that nests in them."""
    args = materialise(args)
    own = materialise(own_arguments(call_sites, args, names))
    return stats_of_roots(own, args, call_sites.where("parent_id IS NULL").select("module_id", "call_site_id"))


# ---- problems ----------------------------------------------------------------------------------


def _missing(*checks: tuple[Column, Column]) -> Column:
    """The first message whose check is true."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), m) for c, m in checks))


def _no_declaration(ident: Column) -> Column:
    return F.concat(F.lit("missing declaration "), ident)


def _no_path(path: Column) -> Column:
    return F.concat(F.lit("missing path "), path)


def companions(declarations: DataFrame) -> DataFrame:
    """(module_id, declaration_id) of the defs that go with an implicit class: of the shape of a conversion, to that class."""
    classes = declarations.where((F.col("kind") == "CLASS") & P.has_property(F.col("properties"), P.IMPLICIT)).select("module_id", F.col("declaration_id").alias("__to"))
    defs = declarations.where((F.col("kind") == "DEF") & (F.col("sig_kind") == "method") & P.is_conversion_shape(F.col("parameter_lists")))
    return defs.select(*KEY, T.head(F.col("result")).alias("__to")).join(classes, ["module_id", "__to"], "left_semi").select(*KEY)


def implicit_declarations(declarations: DataFrame) -> DataFrame:
    return declarations.where(P.is_implicit_declaration(F.col("properties"), F.col("parameter_lists")))


def kept_call_sites(model: Model) -> DataFrame:
    """Call sites that are nested, or of a method that is implicit or has implicit parameters."""
    d = model.declarations.where("sig_kind = 'method'")
    marked = implicit_declarations(d).select(*KEY, F.lit(True).alias("__implicit"))
    return model.call_sites.join(marked, KEY, "left").where("parent_id IS NOT NULL OR __implicit").drop("__implicit")


# ---- the four exports --------------------------------------------------------------------------

DECLARATION = [
    "project_id", "module_id", "group_id", "artifact_id", "version", "kind", "declaration_id", "name", "location_path", "location_uri", "location_pos", "location_scope", "compilation_unit",
    "def_group_id", "def_artifact_id", "def_version", "is_implicit", "is_companion", "access", "annotations", "num_type_parameters", "num_parameter_lists", "num_parameters", "num_implicit_parameters", "github_url",
]


def _own_library(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({f"m_{c}": c for c in ("group_id", "artifact_id", "version")})


def export_declarations(model: Model) -> Export:
    """Implicit declarations, and those that call sites use, of each module once, in the columns of DECLARATION."""
    p = model.prepared()
    last = P.implicit_parameters(F.col("parameter_lists"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    rows = _own_library(p.exported()).withColumns(
        {
            "__problem": _missing((~F.col("def_known"), _no_path(F.col("location_path")))),
            "location_path": S.patched_path(F.col("location_path")), "location_pos": S.encode_position(F.col("line"), F.col("col")), "location_scope": F.col("def_location_scope"),
            "compilation_unit": S.compilation_unit(F.col("declaration_id")), "is_implicit": P.has_property(F.col("properties"), P.IMPLICIT), "github_url": F.col("link"),
            "annotations": S.encode_list(F.col("annotations")), "num_type_parameters": size("type_parameters"), "num_parameter_lists": size("parameter_lists"),
            "num_parameters": size(F.flatten("parameter_lists")), "num_implicit_parameters": F.when(last.isNotNull(), F.size(last)),
        }
    )
    gone = p.of_module(p.used.where("NOT there")).select("project_id", *KEY, _no_declaration(F.col("declaration_id")).alias("__problem"))
    return Export(rows.select(*DECLARATION, "__problem").unionByName(gone, allowMissingColumns=True), DECLARATION)


CALL_SITE = [
    "project_id", "module_id", "group_id", "artifact_id", "version", "callsite_id", "parent_id", "code", "nested_calls", "arguments", "nested_calls_count", "nested_values_count",
    "nested_declarations_length", "declaration_id", "local", "location_path", "location_uri", "location_pos", "location_scope", "num_type_arguments", "num_implicit_arguments", "github_url",
]


def call_site_base(model: Model, own: DataFrame | None = None, stats: DataFrame | None = None) -> Export:
    """Kept call sites in the columns of CALL_SITE, which without stats, of stats_of_roots(), has nulls for those about what nests in them and no
    problems of it. own: own_arguments() of all call sites, if made already. What needs no statistics of nesting starts here."""
    p, key = model.prepared(), ["module_id", "call_site_id"]
    own = own_arguments(p.sites, model.args, p.declarations, p.aliases) if own is None else own
    own = own.select(*key, (F.col("calls") + F.col("values")).cast("int").alias("num_implicit_arguments"), "nested_calls", "arguments", "no_value")
    named = {"calls": "nested_calls_count", "values": "nested_values_count", "chars": "nested_declarations_length", "missing": "lacks"}
    rows = p.sites.where("kept").join(held(own), key, "left")
    rows = rows.join(held(stats.withColumnsRenamed(named)), key, "left") if stats is not None else rows.withColumns({c: F.lit(None).cast("long") for c in named.values()})
    rows = p.at_place(p.at_place(p.of_module(rows), "location_path", "site_"), "decl_path", "def_")
    rows = _own_library(rows.withColumn("link", _link(F.col("site_local"))))
    library = lambda p: [F.col(f"{p}{c}") for c in ("group_id", "artifact_id", "version")]
    rows = rows.withColumns(
        {
            "__problem": _missing(
                (F.col("there").isNull(), _no_declaration(F.col("declaration_id"))), (~F.col("site_known"), _no_path(F.col("location_path"))), (~F.col("def_known"), _no_path(F.col("decl_path"))),
                (F.col("no_value").isNotNull(), _no_declaration(F.col("no_value"))), (F.col("lacks") > 0, F.lit("missing declaration of a nested argument")),
            ),
            "callsite_id": F.col("call_site_id"), "code": S.code_snippet(F.col("code")), "local": S.locality(*library("site_"), *library("def_")), "location_pos": S.encode_position(F.col("line"), F.col("col")),
            "location_path": S.patched_path(F.col("location_path")), "location_scope": F.col("site_location_scope"), "nested_calls": S.encode_list(F.col("nested_calls")), "arguments": S.encode_list(F.col("arguments")),
            "num_type_arguments": F.coalesce(F.size("type_arguments"), F.lit(0)), "num_implicit_arguments": F.coalesce("num_implicit_arguments", F.lit(0)), "github_url": F.col("link"),
        }
    )
    return Export(rows.select(*CALL_SITE, "__problem"), CALL_SITE)


def export_call_sites(model: Model) -> Export:
    """Call sites that are implicit or nested, in the columns of CALL_SITE; statistics of what nests in them for top ones with implicit
    arguments."""
    p = model.prepared()
    args = materialise(model.args)
    own = materialise(own_arguments(p.sites, args, p.declarations, p.aliases))
    return call_site_base(model, own, stats_of_roots(own, args, p.sites.where("parent_id IS NULL").select("module_id", "call_site_id")))


PARAMETER = [
    "project_id", "module_id", "group_id", "artifact_id", "version", "declaration_id", "declaration_kind", "declaration_is_implicit", "declaration_is_companion", "def_group_id", "def_artifact_id", "def_version",
    "def_location_scope", "def_location_path", "def_location_uri", "def_location_github", "parameter_id", "name", "code", "type_id", "type_kind", "type_group_id", "type_artifact_id", "type_version",
    "type_location_scope", "type_location_path", "type_location_uri", "type_location_github", "type_local", "resolved_type_id", "resolved_type_kind", "num_type_arguments", "num_type_argument_refs",
]


def export_parameters(model: Model) -> Export:
    """Implicit parameters of exported declarations, one row each, in the columns of PARAMETER."""
    p = model.prepared()
    last = P.implicit_parameters(F.col("parameter_lists"))
    rows = p.exported().where(last.isNotNull()).select(
        "project_id", "commit", *KEY, *(f"m_{c}" for c in ("group_id", "artifact_id", "version")), F.col("kind").alias("declaration_kind"), P.has_property(F.col("properties"), P.IMPLICIT).alias("declaration_is_implicit"),
        F.col("is_companion").alias("declaration_is_companion"), *(f"def_{c}" for c in ("known", *LIBRARY)), "location_path", F.col("location_uri").alias("def_location_uri"), F.col("link").alias("def_location_github"), F.posexplode(last).alias("position", "p"),
    )
    rows = materialise(rows.withColumns({"type": F.col("p.type"), "type_id": T.head(F.col("p.type")), "name": F.col("p.name")}).drop("p"))
    args = rows.select("module_id", F.struct("declaration_id", "position").alias("owner"), T.arguments(F.col("type")).alias("args"))
    ids = rows.select("module_id", "type_id").unionByName(args.select("module_id", F.explode("args").alias("a")).select("module_id", T.head(F.col("a")).alias("type_id")))
    # what an alias resolves to, with its kind; any other type is its own
    ends = p.aliases.select("module_id", F.col("declaration_id").alias("type_id"), "resolved_id")
    d = p.named(ids.unionByName(ends.select("module_id", F.col("resolved_id").alias("type_id"))).withColumnRenamed("type_id", "declaration_id"))
    counted_ = T.count_parameters(args, d)
    counted_ = counted_.select("module_id", "owner.declaration_id", "owner.position", "num_type_arguments", "num_type_argument_refs", F.col("missing").alias("lacks"))
    of_type = {"kind": "type_kind", "location_path": "type_path", "location_uri": "type_location_uri", "line": "type_line"}
    types = d.select("module_id", F.col("declaration_id").alias("type_id"), *(F.col(a).alias(b) for a, b in of_type.items()))
    ends = ends.join(held(d.select("module_id", F.col("declaration_id").alias("resolved_id"), F.col("kind").alias("end_kind"))), ["module_id", "resolved_id"], "left")
    rows = rows.join(held(types), ["module_id", "type_id"], "left").join(held(ends), ["module_id", "type_id"], "left").join(held(counted_), [*KEY, "position"])
    rows = p.at_place(rows, "type_path", "type_")
    rows = rows.withColumn("type_location_github", _link(F.col("type_local"), "type_path", "type_location_uri", "type_line"))
    library = lambda p: [F.col(f"{p}{c}") for c in ("group_id", "artifact_id", "version")]
    alias = F.col("resolved_id").isNotNull()
    rows = _own_library(rows).withColumns(
        {
            "__problem": _missing(
                (F.col("type_kind").isNull(), _no_declaration(F.col("type_id"))), (~F.col("def_known"), _no_path(F.col("location_path"))), (~F.col("type_known"), _no_path(F.col("type_path"))),
                (F.col("lacks") > 0, F.lit("missing declaration of a type argument")),
            ),
            "def_location_path": S.patched_path(F.col("location_path")), "parameter_id": F.concat("declaration_id", F.lit("("), "name", F.lit(")")), "code": T.as_code(F.col("type")),
            "type_location_path": S.patched_path(F.col("type_path")), "type_local": S.locality(*library("def_"), *library("type_")),
            "resolved_type_id": F.when(~alias, F.col("type_id")).when(F.col("end_kind").isNotNull(), F.col("resolved_id")), "resolved_type_kind": F.when(alias, F.col("end_kind")).otherwise(F.col("type_kind")),
        }
    )
    return Export(rows.select(*PARAMETER, "__problem"), PARAMETER)


CONVERSION = [
    "project_id", "module_id", "declaration_id", "is_local", "from", "from_groupId", "from_artifactId", "from_version", "from_scope", "from_compilation_unit", "from_language",
    "to", "to_groupId", "to_artifactId", "to_version", "to_scope", "to_compilation_unit", "to_language",
]


def in_modules_of(rows: DataFrame, declarations: DataFrame) -> DataFrame:
    """The declarations of modules that are among those of rows: references are resolved by their own module's."""
    return declarations.join(held(rows.select("module_id").distinct()), "module_id", "left_semi")


def conversion_types(declarations: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(module_id, declaration_id, from, to), the last two references: of implicit defs of the shape of a conversion the parameter's and
    the result's type; of implicit objects the arguments of the first of all their parents that is Function1, of implicit values, and
    objects that are methods, of their type or the first such parent of it; none to Unit. So a list is a conversion, as it is a function of its index.

    aliases: Prepared.aliases, if made already. Inheritance is followed for the distinct types of implicit objects and values only."""
    implicit = P.has_property(F.col("properties"), P.IMPLICIT)
    shape = (F.col("kind") == "DEF") & P.is_conversion_shape(F.col("parameter_lists"))
    first = F.get(F.get("parameter_lists", 0), 0)["type"]
    d = declarations.where(implicit)
    # every round reads this: types and classes alone, of modules with a declaration that may be a conversion
    types = declarations.where("sig_kind IN ('class', 'type')").select(*KEY, "kind", "sig_kind", "type_parameters", "parents", "upper", "lower", "result")
    types = materialise(in_modules_of(d.where(shape | F.col("kind").isin("VAL", "VAR", "OBJECT")), types))
    aliases = materialise(T.declared_types(types).where("resolved_id <> declaration_id")) if aliases is None else aliases
    unit = T.kinds_of(types, P.UNIT, aliases).withColumnRenamed("declaration_id", "__to")
    defs = d.where(shape).select(*KEY, first.alias("from"), F.col("result").alias("to"))
    objects = d.where("kind = 'OBJECT' AND sig_kind = 'class'").select(*KEY, T.ref(F.col("declaration_id")).alias("ref"), F.lit(False).alias("itself"))
    values = d.where("kind IN ('VAL', 'VAR', 'OBJECT') AND sig_kind = 'method'").select(*KEY, F.col("result").alias("ref"), F.lit(True).alias("itself"))
    roots = materialise(objects.unionByName(values))
    up = T.all_parents(types, roots, aliases)
    found = held(roots).join(up, ["module_id", "ref"]).select(*KEY, "parent", "place")
    found = found.unionByName(roots.where("itself").select(*KEY, F.col("ref").alias("parent"), F.array().cast("array<int>").alias("place")))
    functions = T.types_of(types, P.FUNCTION1, aliases).withColumnRenamed("declaration_id", "__head")
    first = found.withColumn("__head", T.head(F.col("parent"))).join(held(functions), ["module_id", "__head"]).groupBy(*KEY).agg(F.min_by("parent", "place").alias("ref"))
    first = materialise(first)
    args = T.resolved_refs(types, first).select("module_id", "ref", T.arguments(F.col("resolved")).alias("args")).where(F.size("args") == 2)
    of_functions = first.join(held(args), ["module_id", "ref"]).select(*KEY, F.col("args")[0].alias("from"), F.col("args")[1].alias("to"))
    return defs.unionByName(of_functions).withColumn("__to", T.head(F.col("to"))).join(held(unit), ["module_id", "__to"], "left_anti").drop("__to")


def export_conversions(model: Model) -> Export:
    """Implicit conversions in the columns of CONVERSION."""
    p = model.prepared()
    aliases, d = p.aliases, p.declarations
    found = settled(lambda: conversion_types(d, aliases))
    both = found.select("module_id", F.col("from").alias("ref")).unionByName(found.select("module_id", F.col("to").alias("ref"))).distinct()
    full = settled(lambda: T.fully_resolved_refs(materialise(in_modules_of(found, d.select(*KEY, "sig_kind", "type_parameters", "upper", "lower", "result"))), both))
    rows = p.with_companions(held(found).join(d.select(*KEY, "location_uri", "companion_of"), KEY))
    rows = _own_library(p.of_module(rows.withColumns({f"__{side}": T.head(F.col(side)) for side in ("from", "to")})))
    sides = p.named(both.select("module_id", T.head(F.col("ref")).alias("declaration_id")))
    problem = []
    for side in ("from", "to"):
        ends = sides.select("module_id", F.col("declaration_id").alias(f"__{side}"), F.col("location_path").alias(f"__{side}_path"), F.col("language").alias(f"{side}_language"))
        known = full.select("module_id", F.col("ref").alias(side), T.as_code(F.col("resolved")).alias(f"__{side}_code"), F.col("missing").alias(f"__{side}_lacks"))
        rows = rows.join(held(ends), ["module_id", f"__{side}"], "left").join(held(known), ["module_id", side], "left")
        rows = p.at_place(rows, f"__{side}_path", f"{side}_").withColumnRenamed(f"{side}_location_scope", f"{side}_scope")
        problem += [
            (F.col(f"__{side}_path").isNull(), _no_declaration(F.col(f"__{side}"))), (~F.col(f"{side}_known"), _no_path(F.col(f"__{side}_path"))),
            (F.col(f"__{side}_lacks").isNotNull(), _no_declaration(F.col(f"__{side}_lacks"))),
        ]
    added = {"__problem": _missing(*problem), "is_local": P.is_project_local(F.col("location_uri")) | F.col("is_companion")}
    for side in ("from", "to"):
        added |= {side: F.col(f"__{side}_code"), f"{side}_compilation_unit": S.compilation_unit(F.col(f"__{side}"))}
        added |= {f"{side}_groupId": F.col(f"{side}_group_id"), f"{side}_artifactId": F.col(f"{side}_artifact_id")}
    return Export(rows.withColumns(added).select(*CONVERSION, "__problem"), CONVERSION)


#: The exports of a model by name.
EXPORTS = {"declarations": export_declarations, "callsites": export_call_sites, "conversions": export_conversions, "parameters": export_parameters}


def extraction_statistics(model: Model, exceptions: DataFrame) -> DataFrame:
    """By project: declarations, implicit_declarations, implicit_local_declarations, callsites, test_callsites, implicit_callsites and
    failures. exceptions: module_id, a row for each failure."""
    modules = model.modules.select("module_id", "project_id", "call_sites_count", "test_call_sites_count")
    d = model.declarations.select("module_id", P.is_implicit_declaration(F.col("properties"), F.col("parameter_lists")).alias("i"), P.is_project_local(F.col("location_uri")).alias("l"))
    by_module = d.groupBy("module_id").agg(F.count("*").alias("declarations"), F.count_if("i").alias("implicit_declarations"), F.count_if(F.col("i") & F.col("l")).alias("implicit_local_declarations"))
    sites = kept_call_sites(model).groupBy("module_id").agg(F.count("*").alias("implicit_callsites"))
    failed = exceptions.groupBy("module_id").agg(F.count("*").alias("failures"))
    rows = modules.join(by_module, "module_id", "left").join(sites, "module_id", "left").join(failed, "module_id", "left")
    sums = {"declarations": "declarations", "implicit_declarations": "implicit_declarations", "implicit_local_declarations": "implicit_local_declarations", "callsites": "call_sites_count", "test_callsites": "test_call_sites_count", "implicit_callsites": "implicit_callsites", "failures": "failures"}
    return rows.groupBy("project_id").agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(name) for name, c in sums.items()))


def parameter_declaration(declarations: DataFrame, wanted: DataFrame) -> Export:
    """wanted: project_id, module_id, declaration_id, name. The id of the declaration of the named parameter's type, of any of
    the lists; a problem for a name that the declaration hasn't, or a type that the module lacks."""
    found = F.get(F.filter(F.flatten("parameter_lists"), lambda p: p["name"] == F.col("name")), 0)["type"]
    rows = wanted.join(declarations.select(*KEY, "parameter_lists"), KEY, "left").withColumn("type_id", T.head(found))
    known = declarations.select("module_id", F.col("declaration_id").alias("type_id"), F.lit(True).alias("__there"))
    rows = rows.join(known, ["module_id", "type_id"], "left")
    none = F.concat(F.lit("parameter "), F.col("name"), F.lit(" does not exist"))
    return Export(rows.withColumn("__problem", _missing((F.col("type_id").isNull(), none), (F.col("__there").isNull(), _no_declaration(F.col("type_id"))))), ["project_id", *KEY, "name", "type_id"])


def signature_parts(declarations: DataFrame) -> DataFrame:
    """(module_id, declaration_id, sig_kind, type_parameters, parameter_lists, return_id, declaring_id): what a signature has, empty lists for what it
    hasn't; the declaring symbol of methods and values, null of others."""
    method, value = F.col("sig_kind") == "method", F.col("sig_kind") == "value"
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(declarations.schema[c].dataType))
    return declarations.select(
        *KEY, "sig_kind", F.when(value, F.array().cast("array<string>")).otherwise(empty("type_parameters")).alias("type_parameters"),
        F.when(method, empty("parameter_lists")).otherwise(F.array().cast(declarations.schema["parameter_lists"].dataType)).alias("parameter_lists"),
        F.when(method, T.head(F.col("result"))).alias("return_id"), F.when(method | value, S.symbol_owner(F.col("declaration_id"))).alias("declaring_id"),
    )
