"""Predicates of the code model: declarations, call sites, projects, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import THREE_MONTHS, is_compatible_sbt
from lodestone.operators.lineage import materialise
from lodestone.operators.ranks import with_running_total

IMPLICIT, LAZY = 32, 64  # bits of a declaration's properties
KINDS = ("DEF", "VAL", "VAR", "TYPE", "CLASS", "TRAIT", "OBJECT", "INTERFACE", "ENUM", "MACRO", "TYPE_PARAMETER", "PARAMETER")
UNIT, FUNCTION1 = "scala/Unit#", "scala/Function1#"
TOP_OR_BOTTOM = ("scala/Any#", "scala/AnyRef#", "scala/Nothing#")
# Ids of primitive types.
PRIMITIVES = (
    "scala/Any#", "scala/AnyRef#", "scala/AnyVal#", "scala/Boolean#", "scala/Byte#", "scala/Char#", "scala/Double#", "scala/Float#",
    "scala/Int#", "scala/Long#", "scala/Short#", "scala/StringContext#", "scala/Unit#", "java/lang/String#",
)
TYPE_PROOFS = ("scala/Predef.`=:=`#", "scala/Predef.`<:<`#")
MANIFESTS = ("scala/reflect/ClassManifestFactory", "scala/reflect/ManifestFactory")


def is_kind(kind: Column, name: str) -> Column:
    """kind is one of KINDS' names; another name is an error."""
    if name not in KINDS:
        raise ValueError(f"no kind of declaration: {name}")
    return kind == name


def signature_field(sig_kind: Column, kind: str, field: Column) -> Column:
    """A field of a signature; an error at run time if the signature is of another kind."""
    return F.when(sig_kind == kind, field).otherwise(F.raise_error(F.concat(F.lit(f"not a {kind} signature: "), F.coalesce(sig_kind, F.lit("none")))))


def is_top_or_bottom(declaration_id: Column) -> Column:
    return declaration_id.isin(*TOP_OR_BOTTOM)


def of_scope(paths: DataFrame, scope: str) -> DataFrame:
    """Paths of compile or test scope."""
    return paths.where(F.col("scope") == scope)


def is_from_macro(def_library: Column, declaration_id: Column) -> Column:
    """Of a call site whose declaration's library isn't known, and that isn't of a manifest."""
    return def_library.isNull() & ~is_manifest(declaration_id)


def has_property(properties: Column, bit: int) -> Column:
    return properties.bitwiseAND(F.lit(bit)) != 0


def is_implicit_list(params: Column) -> Column:
    """All parameters implicit; so is an empty list."""
    return F.forall(params, lambda p: p["is_implicit"])


def implicit_parameters(lists: Column) -> Column:
    """The last parameter list if it is implicit, else null."""
    last = F.try_element_at(lists, F.lit(-1))
    return F.when(is_implicit_list(last), last)


def is_implicit_declaration(properties: Column, lists: Column) -> Column:
    return has_property(properties, IMPLICIT) | F.coalesce(implicit_parameters(lists).isNotNull(), F.lit(False))


def is_conversion_shape(lists: Column) -> Column:
    """One explicit parameter alone, or followed by one implicit list."""
    first = F.get(lists, 0)
    one = (F.size(first) == 1) & ~F.get(first, 0)["is_implicit"]
    return F.coalesce(one & ((F.size(lists) == 1) | ((F.size(lists) == 2) & is_implicit_list(F.get(lists, 1)))), F.lit(False))


def is_default_argument(sig_kind: Column, declaration_id: Column) -> Column:
    name = F.regexp_extract(declaration_id, r"([^/#.]*)\(\+?\d*\)\.$", 1)
    return (sig_kind == "method") & name.rlike(r".*\$default\$\d+$")


def is_project_local(uri: Column) -> Column:
    return uri.endswith(".scala")


def is_manifest(declaration_id: Column) -> Column:
    return declaration_id.startswith(MANIFESTS[0]) | declaration_id.startswith(MANIFESTS[1])


def is_type_class(refs: Column, resolved_kind: Column) -> Column:
    return (refs >= 1) & (resolved_kind != "TYPE_PARAMETER")


def is_context(refs: Column, resolved_kind: Column) -> Column:
    return (refs == 0) & (resolved_kind != "TYPE_PARAMETER")


def is_type_proof(type_id: Column, scope: Column) -> Column:
    return type_id.isin(*TYPE_PROOFS) & ~F.coalesce(scope.contains("dependency"), F.lit(False))


def select_corpus(projects: DataFrame, notebook: bool = False) -> DataFrame:
    """Projects with a compatible build, two commits or more, a life of over three months, and either
    under 75 % duplication or five stars. notebook: being listed in the index makes up for age."""
    old = F.col("last_commit_s") - F.col("first_commit_s") > THREE_MONTHS
    old = old | F.col("scaladex") if notebook else old
    return projects.where(is_compatible_sbt(F.col("sbt_version")) & (F.col("commits") >= 2) & old & ((F.col("duplication") < 0.75) | (F.col("stars") >= 5)))


def canonical_projects(projects: DataFrame) -> DataFrame:
    """Not forks, and known by the name their id spells."""
    return projects.where(~F.col("fork") & (F.lower("name") == F.lower(F.replace(F.col("project_id"), F.lit("--"), F.lit("/")))))


def tokenizer_input(projects: DataFrame, language: str, stride: int, strides: int) -> DataFrame:
    """Projects of a language, neither deleted nor forked, of one stride of their row numbers."""
    return projects.where((F.col("language") == language) & (F.col("deleted") == "0") & F.col("forked_from").isNull() & (F.pmod(F.col("row") - 1, F.lit(strides)) == stride))


def clean_chunk(projects: DataFrame, files: DataFrame, stats: DataFrame, n: int, least: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keeps files whose id modulo n is in range, of projects all of whose files are; and the statistics of hashes
    that are left."""
    inside = F.pmod("file_id", F.lit(n)).between(least, most)
    dropped = files.where(~inside).select("project_id").distinct()
    files = files.join(dropped, "project_id", "left_anti")
    return projects.join(dropped, "project_id", "left_anti"), files, stats.join(files, "file_hash", "left_semi")


def sample_strata(df: DataFrame, stratum: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum with replacement: draws are numbers among the stratum's rows, joined to them."""
    spark = df.sparkSession
    rows = with_running_total(df.withColumn("__h", F.xxhash64(F.lit(seed), *df.columns)), [stratum, "__h", *(c for c in df.columns if c != stratum)], F.lit(1).cast("long"), "__at")
    rows = materialise(rows)
    starts = rows.groupBy(stratum).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    sizes = starts.select(stratum, "__n")
    rows = rows.join(starts, stratum).withColumn("__i", (F.col("__at") - F.col("__first")).cast("long"))
    draws = sizes.crossJoin(F.broadcast(spark.range(n).withColumnRenamed("id", "__k")))
    draws = draws.select(stratum, F.pmod(F.xxhash64(F.lit(seed), F.col(stratum), "__k"), F.col("__n")).alias("__i"))
    return draws.join(rows, [stratum, "__i"]).select(*df.columns)
