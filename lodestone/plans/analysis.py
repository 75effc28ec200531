"""Analyses of the fact tables: what the notebooks of a corpus study ask of declarations, call sites, conversions and parameters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import analyses as A
from lodestone.operators import model as M
from lodestone.operators.lineage import gathered, held, materialise
from lodestone.plans import register, table
from lodestone.plans.model import CONVERSION_SQL, DECL_SQL, SCOPE_SQL, by_module, model

DSCOPE = SCOPE_SQL.format("path")
# exported declarations with the notebooks' flags; the shared implicit class beside the parts
FLAGS_SQL = f"""{DECL_SQL}, e AS (SELECT project_id, module_id, part, declaration_id, kind, is_implicit, is_companion, path, CASE WHEN part % 6 = 0 THEN 'scala/deprecated#;x/A#' END AS annotations FROM d JOIN keys USING (module_id, part) WHERE path <> 'nowhere'
  UNION ALL SELECT 'org--r' || o_custkey % 50, o_orderkey, NULL, 'p/W#', 'CLASS', true, false, 'src', NULL FROM orders),
g AS (SELECT *, path <> '../lib.jar' AS is_in_main, path = '../lib.jar' AS is_in_test, path = '../lib.jar' AS is_external, path <> '../lib.jar' AS is_local, path = '../lib.jar' AS is_managed, path = '../lib.jar' AS is_external_test, false AS is_local_test, path = '../lib.jar' AS is_managed_test FROM e)"""


#: What the analyses read of cleaned declarations.
CLEANED = (
    "project_id", "module_id", "declaration_id", "kind", "name", "annotations", "compilation_unit", "def_library", "is_implicit", "is_companion", "is_public",
    "is_local", "is_external", "is_managed", "is_in_main", "is_in_test", "is_from_scala",
)


def declarations(m, *columns):
    """Written, so that a task of what joins them holds the sides of those joins alone."""
    return materialise(A.cleaned_declarations(M.export_declarations(m).rows).select(*(columns or CLEANED)))


def conversions(m, *columns):
    rows = M.export_conversions(m).rows
    return materialise(rows.select(*columns).distinct() if columns else rows)


def projects(spark, sf_dir):
    """A corpus of all projects but one in ten, with columns as the notebooks join them."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("k")).distinct()
    return o.where("k % 10 > 0").select(F.concat(F.lit("org--r"), F.col("k").cast("string")).alias("project_id"), (F.col("k") % 2 == 0).alias("scaladex"), (F.col("k") * 100).cast("long").alias("callsites"), (F.col("k") * 30).cast("long").alias("test_callsites"))


CORPUS_SQL = "corpus AS (SELECT DISTINCT 'org--r' || o_custkey % 60 AS project_id, o_custkey % 60 % 2 = 0 AS scaladex, (o_custkey % 60 * 100)::BIGINT AS callsites, (o_custkey % 60 * 30)::BIGINT AS test_callsites FROM orders WHERE o_custkey % 60 % 10 > 0)"
SUMS = ("is_implicit", "is_in_main", "is_in_test", "is_local", "is_external", "is_managed")


@register(f"""
WITH {FLAGS_SQL}, {CORPUS_SQL}, s AS (SELECT project_id, count(*) AS is_all, {', '.join(f'sum({c}::INT)::BIGINT AS {c}' for c in SUMS)} FROM g WHERE NOT is_companion GROUP BY 1)
SELECT project_id, scaladex, callsites, test_callsites, coalesce(is_all, 0) AS is_all, {', '.join(f'coalesce({c}, 0) AS {c}' for c in SUMS)} FROM corpus LEFT JOIN s USING (project_id)""")
@by_module
def dec_01_project_declarations(spark, sf_dir):
    m = model(spark, sf_dir)
    d = declarations(m).where("NOT is_companion")
    return A.project_sums(d, ["is_all", *SUMS], projects(spark, sf_dir))


@register(f"""
WITH {DECL_SQL}, {CONVERSION_SQL}, c AS (SELECT DISTINCT declaration_id FROM conv), e AS (SELECT * FROM d JOIN keys USING (module_id, part) WHERE path <> 'nowhere')
SELECT project_id, module_id, declaration_id, declaration_id IN (SELECT declaration_id FROM c) AS is_conversion FROM e WHERE NOT is_companion
UNION ALL SELECT 'org--r' || o_custkey % 50, o_orderkey, 'p/W#', false FROM orders""")
@by_module
def joi_14_marked_conversions(spark, sf_dir):
    m = model(spark, sf_dir)
    d = declarations(m, "project_id", "module_id", "declaration_id", "is_companion").where("NOT is_companion")
    return A.marked_conversions(d, conversions(m, "module_id", "declaration_id")).select("project_id", "module_id", "declaration_id", "is_conversion")


@register(f"WITH {DECL_SQL}, {CONVERSION_SQL}, e AS (SELECT * FROM d JOIN keys USING (module_id, part) WHERE path <> 'nowhere' AND NOT is_companion) SELECT module_id, declaration_id FROM e WHERE declaration_id IN (SELECT declaration_id FROM conv)")
@by_module
def joi_13_conversions_by_declaration(spark, sf_dir):
    m = model(spark, sf_dir)
    d = declarations(m, "module_id", "declaration_id", "is_companion").where("NOT is_companion")
    return d.join(conversions(m, "module_id", "declaration_id").select("declaration_id").distinct(), "declaration_id", "left_semi").select("module_id", "declaration_id")


CALL_FLAGS = ("is_local", "is_external", "is_managed", "is_in_main", "is_in_test")


@register(f"""
WITH {FLAGS_SQL}, {CONVERSION_SQL}, k AS (SELECT DISTINCT module_id, declaration_id FROM conv),
c AS (SELECT kept.project_id, kept.module_id, kept.id, d.declaration_id FROM kept JOIN d USING (module_id, part) WHERE d.path <> 'nowhere')
SELECT c.project_id, c.module_id, c.id AS callsite_id, c.declaration_id, 'compile' AS location_scope, kind, annotations, CASE WHEN g.path IS NULL THEN NULL WHEN g.path = '../lib.jar' THEN CASE WHEN g.module_id % 3 = 0 THEN 'g:la' ELSE 'lg:la' END WHEN g.path = 'own/classes' THEN 'g:own' ELSE 'g:a' || g.module_id END AS def_library,
  g.is_in_test AS def_is_in_test, g.is_in_main AS def_is_in_main, is_implicit, is_companion, is_local, is_external, is_managed, false AS is_from_scala, true AS is_in_main, false AS is_in_test, false AS is_external_test, false AS is_local_test, false AS is_managed_test, false AS is_from_scala_test,
  (c.module_id, c.declaration_id) IN (SELECT module_id, declaration_id FROM k) AS is_conversion
FROM c LEFT JOIN g ON g.module_id = c.module_id AND g.declaration_id = c.declaration_id""")
@by_module
def joi_15_call_sites_with_declarations(spark, sf_dir):
    m = model(spark, sf_dir)
    sites = M.call_site_base(m).rows.select("project_id", "module_id", "callsite_id", "declaration_id", "location_scope")
    return A.expanded_call_sites(sites, declarations(m), conversions(m, "module_id", "declaration_id"))


@register(f"WITH {DECL_SQL}, {CONVERSION_SQL} SELECT kept.module_id, count(*) AS conversion_call_sites FROM kept JOIN d USING (module_id, part) WHERE d.path <> 'nowhere' AND (kept.module_id, d.declaration_id) IN (SELECT module_id, declaration_id FROM conv) GROUP BY 1")
@by_module
def joi_17_conversion_call_sites(spark, sf_dir):
    m = model(spark, sf_dir)
    c = M.call_site_base(m).rows.select("module_id", "declaration_id")
    return c.join(held(conversions(m, "module_id", "declaration_id")), ["module_id", "declaration_id"], "left_semi").groupBy("module_id").agg(F.count("*").alias("conversion_call_sites"))


SIDE = {"f": "from", "t": "to"}
IC_SQL = f"""{FLAGS_SQL}, {CONVERSION_SQL}, ic AS (SELECT c.project_id, c.module_id, c.declaration_id, {', '.join(f"{c} = 'scala/Int#' AS is_{n}_in_test, {c} <> 'scala/Int#' AS is_{n}_in_main, {c} = 'scala/Int#' AS is_{n}_external, {c} <> 'scala/Int#' AS is_{n}_local, false AS is_{n}_scala" for c, n in SIDE.items())},
  g.kind, g.is_local, g.is_in_main, g.is_in_test, g.is_external, g.is_companion, CASE WHEN g.declaration_id IS NOT NULL THEN false END AS is_from_scala_library, c.f, c.t, c.part FROM conv c LEFT JOIN g ON g.module_id = c.module_id AND g.declaration_id = c.declaration_id WHERE c.project_id <> 'org--r7')"""


def ic_declarations(m, d=None):
    return A.conversion_declarations(conversions(m).where("project_id <> 'org--r7'"), declarations(m) if d is None else d)


@register(f"WITH {IC_SQL} SELECT project_id, module_id, declaration_id, {', '.join(f'is_{n}_{x}' for n in SIDE.values() for x in ('in_main', 'in_test', 'external', 'local', 'scala'))}, kind, is_local, is_in_main, is_in_test, is_external, is_companion FROM ic")
@by_module
def joi_18_conversions_with_declarations(spark, sf_dir):
    m = model(spark, sf_dir)
    rows = ic_declarations(m)
    return rows.select("project_id", "module_id", "declaration_id", *(f"is_{n}_{x}" for n in SIDE.values() for x in ("in_main", "in_test", "external", "local", "scala")), "kind", "is_local", "is_in_main", "is_in_test", "is_external", "is_companion")


IC_SUMS = ("is_local", "is_in_main", "is_companion", "is_from_local", "is_to_external")


@register(f"""
WITH {IC_SQL}, {CORPUS_SQL}, s AS (SELECT project_id, count(*) AS is_all, {', '.join(f'CASE WHEN count({c}) = count(*) THEN sum({c}::INT) END::BIGINT AS {c}' for c in IC_SUMS)} FROM ic GROUP BY 1)
SELECT project_id, scaladex, callsites, test_callsites, coalesce(is_all, 0) AS is_all, {', '.join(f'coalesce({c}, 0) AS {c}' for c in IC_SUMS)} FROM corpus LEFT JOIN s USING (project_id)""")
@by_module
def con_01_project_conversions(spark, sf_dir):
    m = model(spark, sf_dir)
    return A.project_sums(ic_declarations(m), ["is_all", *IC_SUMS], projects(spark, sf_dir))


@register(f"""
WITH {IC_SQL} SELECT ic.declaration_id, count(*) AS n FROM ic JOIN d ON d.module_id = ic.module_id AND d.part = ic.part, range(1) WHERE ic.is_local AND d.has_implicit AND d.part % 7 > 0 AND d.part % 4 = 1 GROUP BY 1""")
@by_module
def joi_19_syntax_pattern(spark, sf_dir):
    m = model(spark, sf_dir)
    p = materialise(M.export_parameters(m).rows.select("project_id", "module_id", "declaration_id", "num_type_argument_refs", "resolved_type_kind"))
    return A.syntax_pattern(p, ic_declarations(m).where("is_local"))


@register(f"""
WITH {IC_SQL} SELECT project_id, module_id, declaration_id FROM ic WHERE is_local AND NOT is_companion AND 'p/O' || part % 7 NOT IN (rtrim(f, '#'), rtrim(t, '#'))""")
@by_module
def joi_20_unrelated_conversions(spark, sf_dir):
    m = model(spark, sf_dir)
    d = declarations(m)
    return A.unrelated_conversions(ic_declarations(m, d).where("is_local"), d.where("NOT is_companion")).select("project_id", "module_id", "declaration_id")


@register("""
WITH c AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'scala/reflect/ManifestFactory.classType().' WHEN 1 THEN 'scala/reflect/ClassManifestFactory.x().' WHEN 2 THEN 'org/scalactic/source/Position.apply().' ELSE 'scala/Option.apply().' END AS declaration_id, CASE WHEN event_id % 3 > 0 THEN 'g:a' END AS def_library FROM events)
SELECT event_id, CASE WHEN starts_with(declaration_id, 'scala/reflect/') THEN 'manifest' ELSE 'macro' END AS source FROM c WHERE def_library IS NULL""")
def joi_21_macros_and_manifests(spark, sf_dir):
    k = F.col("user_id") % 4
    ident = F.when(k == 0, "scala/reflect/ManifestFactory.classType().").when(k == 1, "scala/reflect/ClassManifestFactory.x().").when(k == 2, "org/scalactic/source/Position.apply().").otherwise("scala/Option.apply().")
    c = table(spark, sf_dir, "events").select("event_id", ident.alias("declaration_id"), F.when(F.col("event_id") % 3 > 0, "g:a").alias("def_library"))
    manifests, macros = A.unknown_call_sites(c)
    return manifests.select("event_id", F.lit("manifest").alias("source")).unionByName(macros.select("event_id", F.lit("macro").alias("source")))


@register(f"""
WITH {DECL_SQL}, {CORPUS_SQL}, c AS (SELECT kept.project_id, count(*) AS n, count(*) FILTER (d.path <> '../lib.jar') AS local, count(*) FILTER (d.path = '../lib.jar') AS external FROM kept JOIN d USING (module_id, part) WHERE d.path <> 'nowhere' GROUP BY 1),
w AS (SELECT project_id, scaladex, coalesce(n, 0) AS n, coalesce(local, 0) AS local, coalesce(external, 0) AS external, callsites FROM corpus LEFT JOIN c USING (project_id)),
r AS (SELECT project_id, scaladex, CASE WHEN n = 0 THEN 0 ELSE n / (n + callsites) END::DOUBLE AS r, CASE WHEN local = 0 THEN 0 ELSE local / n END::DOUBLE AS local, CASE WHEN external = 0 THEN 0 ELSE external / n END::DOUBLE AS external FROM w)
SELECT project_id, scaladex, k AS scope, CASE k WHEN 'r' THEN r WHEN 'local' THEN local ELSE external END AS ratio FROM r, (VALUES ('r'), ('local'), ('external')) v(k)""")
@by_module
def agg_24_call_site_ratios(spark, sf_dir):
    m = model(spark, sf_dir)
    d = declarations(m, "module_id", "declaration_id", "is_local", "is_external")
    c = held(M.call_site_base(m).rows.select("project_id", "module_id", "declaration_id")).join(d, ["module_id", "declaration_id"], "left")
    sums = A.project_sums(c, ["is_all", "is_local", "is_external"], projects(spark, sf_dir))
    wide = sums.select("project_id", "scaladex", S.ratio(F.col("is_all"), F.col("is_all") + F.col("callsites")).alias("r"), *(S.ratio(F.col(f"is_{k}"), F.col("is_all")).alias(k) for k in ("local", "external")))
    return wide.unpivot(["project_id", "scaladex"], ["r", "local", "external"], "scope", "ratio")


@register(f"WITH {IC_SQL} SELECT project_id, module_id, declaration_id FROM ic WHERE is_local AND (f = 'scala/Int#' OR t = 'scala/Int#')")
@by_module
def prd_24_primitive_conversions(spark, sf_dir):
    m = model(spark, sf_dir)
    return A.primitive_conversions(ic_declarations(m).where("is_local")).select("project_id", "module_id", "declaration_id")


@register(f"""
WITH {DECL_SQL}, p AS (SELECT *, unnest(range((part % 7)::INT)) AS i FROM d WHERE has_implicit AND path <> 'nowhere'),
r AS (SELECT *, CASE WHEN i = 0 THEN 'p/Box#' ELSE 'scala/Function1#' END AS t, i = 0 AND part % 4 = 1 AS is_class FROM p)
SELECT is_class AS type_class, t AS resolved_type_id, count(DISTINCT project_id) AS n FROM r GROUP BY 1, 2""")
@by_module
def par_01_types_of_parameters(spark, sf_dir):
    p = materialise(M.export_parameters(model(spark, sf_dir)).rows.select("project_id", "num_type_argument_refs", "resolved_type_id", "resolved_type_kind"))
    return A.projects_by_type(A.type_classes(p)).withColumn("type_class", F.lit(True)).unionByName(A.projects_by_type(A.contexts(p)).withColumn("type_class", F.lit(False)))


@register(f"""
WITH {DECL_SQL}, o AS (SELECT 'org--r' || o_custkey % 50 AS project_id, o_orderkey AS m, o_orderkey % 90 AS c, o_orderkey % 9 AS t FROM orders),
x AS (SELECT project_id, count(*) AS n, count(*) FILTER (is_implicit OR has_implicit) AS i, count(*) FILTER ((is_implicit OR has_implicit) AND uri = 'A.scala') AS l, count(*) FILTER (part % 4 = 1) AS tp FROM d GROUP BY 1),
k AS (SELECT project_id, count(*) AS n FROM kept GROUP BY 1), f AS (SELECT project_id, count(*) AS n FROM kept WHERE part % 50 = 0 GROUP BY 1), w AS (SELECT project_id, count(*) AS n, sum(c) AS c, sum(t) AS t FROM o GROUP BY 1)
SELECT project_id, (13 * w.n + coalesce(x.n, 0) + coalesce(x.tp, 0))::BIGINT AS declarations, (w.n + coalesce(x.i, 0))::BIGINT AS implicit_declarations, (w.n + coalesce(x.l, 0))::BIGINT AS implicit_local_declarations, w.c::BIGINT AS callsites, w.t::BIGINT AS test_callsites, coalesce(k.n, 0)::BIGINT AS implicit_callsites, coalesce(f.n, 0)::BIGINT AS failures
FROM w LEFT JOIN x USING (project_id) LEFT JOIN k USING (project_id) LEFT JOIN f USING (project_id)""")
@by_module
def agg_01_extraction_statistics(spark, sf_dir):
    m = model(spark, sf_dir)
    columns = ["module_id", "declaration_id", "sig_kind", "properties", "parameter_lists", "location_uri"]
    m = replace(m, declarations=gathered(m.declarations, lambda d: d.select(*columns)))
    failures = M.kept_call_sites(m).join(m.declarations, ["module_id", "declaration_id"], "left_anti").select("module_id")
    return M.extraction_statistics(m, failures)


@register(f"""
WITH {DECL_SQL}, {CORPUS_SQL}, c AS (SELECT project_id, count(*) AS n FROM kept GROUP BY 1), w AS (SELECT coalesce(n, 0)::BIGINT AS n, callsites FROM corpus LEFT JOIN c USING (project_id))
SELECT 'call sites' AS key, sum(n + callsites)::DOUBLE AS sum, count(*) AS n, avg(n + callsites) AS mean, median(n + callsites)::DOUBLE AS median, stddev_samp(n + callsites) AS sd, min(n + callsites)::DOUBLE AS min, max(n + callsites)::DOUBLE AS max FROM w
UNION ALL SELECT 'implicit call sites', sum(n)::DOUBLE, count(*), avg(n), median(n)::DOUBLE, stddev_samp(n), min(n)::DOUBLE, max(n)::DOUBLE FROM w
UNION ALL SELECT 'projects using implicits', count(*)::DOUBLE, 1, NULL, NULL, NULL, NULL, NULL FROM w WHERE n > 0""")
def agg_21_overview(spark, sf_dir):
    sites = M.kept_call_sites(model(spark, sf_dir)).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("module_id"), F.concat(F.lit("org--r"), (F.col("o_custkey") % 50).cast("string")).alias("project_id")), "module_id")
    return A.overview(materialise(A.project_sums(sites, ["is_all"], projects(spark, sf_dir))))


@register("""
WITH p AS (SELECT o_orderkey AS project_id, o_orderkey % 3 AS metadata, o_orderkey % 4 AS semanticdb, CASE o_custkey % 4 WHEN 0 THEN 'missing-dependencies' WHEN 1 THEN 'compilation-failed' WHEN 2 THEN 'project-loading-failed' ELSE 'unknown' END AS a, CASE WHEN o_custkey % 8 = 0 THEN 'org.scalajs' ELSE 'x-SNAPSHOT' END AS d FROM orders),
f AS (SELECT CASE WHEN metadata = 1 THEN a ELSE 'compilation-failed' END AS cause, CASE WHEN metadata = 1 THEN d END AS detail FROM p WHERE metadata = 1 OR semanticdb = 1)
SELECT 'cause' AS what, cause AS value, count(*) AS n FROM f GROUP BY cause UNION ALL SELECT 'dependency', detail, count(*) FROM f WHERE cause = 'missing-dependencies' GROUP BY detail""")
def agg_19_failure_causes(spark, sf_dir):
    k = F.col("o_custkey") % 4
    cause = F.when(k == 0, "missing-dependencies").when(k == 1, "compilation-failed").when(k == 2, "project-loading-failed").otherwise("unknown")
    detail = F.when(F.col("o_custkey") % 8 == 0, "org.scalajs").otherwise("x-SNAPSHOT")
    p = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("project_id"), (F.col("o_orderkey") % 3).cast("int").alias("metadata_exit_code"), (F.col("o_orderkey") % 4).cast("int").alias("semanticdb_exit_code"), cause.alias("metadata_failure"),
        detail.alias("metadata_failure_detail"), F.lit("compilation-failed").alias("semanticdb_failure"), F.lit(None).cast("string").alias("semanticdb_failure_detail"),
    )
    causes, dependencies = A.failure_counts(A.failed_projects(p))
    return causes.select(F.lit("cause").alias("what"), F.col("cause").alias("value"), "n").unionByName(dependencies.select(F.lit("dependency").alias("what"), F.col("cause_detail").alias("value"), "n"))
