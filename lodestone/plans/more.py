"""The smaller operators, each over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import predicates as P
from lodestone.functions import rstats
from lodestone.functions import scalars as S
from lodestone.operators import clones as C
from lodestone.operators import joins as J
from lodestone.operators import summaries as Y
from lodestone.operators.lineage import held, materialise
from lodestone.operators.model import kept_call_sites
from lodestone.plans import register, table
from lodestone.plans.clones import BAG_SQL, FILES_SQL, bags, files
from lodestone.plans.model import DECL_SQL, SITES_SQL, by_module, model
from lodestone.plans.scalars import VERSION_SQL, versions


@register("SELECT CASE WHEN p_size % 3 = 0 THEN 'DEF' WHEN p_size % 3 = 1 THEN 'VAL' ELSE 'CLASS' END AS kind, (p_partkey & 32) <> 0 AS is_implicit, (p_partkey & 64) <> 0 AS is_lazy, count(*) AS n FROM part GROUP BY ALL")
def prd_01_property_bits(spark, sf_dir):
    k = F.col("p_size") % 3
    kind = F.when(k == 0, "DEF").when(k == 1, "VAL").otherwise("CLASS")
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind"), P.has_property(F.col("p_partkey"), P.IMPLICIT).alias("is_implicit"), P.has_property(F.col("p_partkey"), P.LAZY).alias("is_lazy")).agg(F.count("*").alias("n"))


@register(r"SELECT doc_id, 'p/o.f$default$' || doc_id || '().' AS id, doc_id % 2 = 0 AS is_default, 'local' || doc_id || '::3' AS local_id FROM documents WHERE doc_id % 2 = 0")
def prd_10_names(spark, sf_dir):
    ident = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("p/o.f$default$")).otherwise(F.lit("p/o.f")), F.col("doc_id").cast("string"), F.lit("()."))
    local = F.concat(F.lit("local"), F.col("doc_id").cast("string"), F.lit("::3"))
    d = table(spark, sf_dir, "documents").select("doc_id", ident.alias("id"), P.is_default_argument(F.lit("method"), ident).alias("is_default"), local.alias("local_id"))
    return d.where(F.col("is_default") & S.is_block_local(F.col("local_id")))


@register(f"""WITH {DECL_SQL} SELECT module_id, declaration_id, path IN ('src', 'own/classes') AS in_module, path IN ('src', 'own/classes') AS in_project FROM d""")
@by_module
def prd_14_local_to_module_or_project(spark, sf_dir):
    m = model(spark, sf_dir)
    own = m.declarations.where("kind IN ('DEF', 'VAL', 'OBJECT')").select("module_id", "declaration_id", "location_path")
    entries = m.paths.select("module_id", F.col("path").alias("location_path"), F.when(F.col("entry_kind") == "source", True).otherwise(F.col("internal")).alias("inside"))
    rows = own.join(held(entries), ["module_id", "location_path"], "left").join(held(m.modules.select("module_id", "project_id")), "module_id").select("project_id", "module_id", "declaration_id", F.coalesce("inside", F.lit(False)).alias("in_module"))
    rows = materialise(rows)
    any_of = rows.groupBy("project_id", "declaration_id").agg(F.bool_or("in_module").alias("in_project"))
    return rows.join(any_of, ["project_id", "declaration_id"]).select("module_id", "declaration_id", "in_module", "in_project")


@register(f"WITH {DECL_SQL} SELECT module_id, id AS call_site_id FROM kept")
def prd_16_kept_call_sites(spark, sf_dir):
    return kept_call_sites(model(spark, sf_dir)).select("module_id", "call_site_id")


@register("SELECT c_custkey FROM customer WHERE c_nationkey % 4 > 0 AND c_custkey % 3 = 0")
def prd_21_canonical_projects(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Org/R"), F.col("c_custkey").cast("string"))).otherwise("Org/other")
    c = c.select("c_custkey", (F.col("c_nationkey") % 4 == 0).alias("fork"), name.alias("name"), F.concat(F.lit("org--r"), F.col("c_custkey").cast("string")).alias("project_id"))
    return P.canonical_projects(c).select("c_custkey")


@register("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0 AND c_nationkey % 3 > 0 AND (c_custkey - 1) % 4 = 1")
def prd_28_tokenizer_input(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("language"), (F.col("c_nationkey") % 2).cast("string").alias("deleted"), F.when(F.col("c_nationkey") % 3 == 0, 1).alias("forked_from"), F.col("c_custkey").alias("row"))
    return P.tokenizer_input(c, "BUILDING", 1, 4).select("c_custkey")


@register("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'type class' ELSE 'context' END AS pattern FROM part WHERE p_partkey % 4 > 0")
def prd_26_type_class_pattern(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).alias("refs"), F.when(F.col("p_partkey") % 4 == 0, "TYPE_PARAMETER").otherwise("TRAIT").alias("kind"))
    pattern = F.when(P.is_type_class(F.col("refs"), F.col("kind")), "type class").when(P.is_context(F.col("refs"), F.col("kind")), "context")
    return p.select("p_partkey", pattern.alias("pattern")).where("pattern IS NOT NULL")


@register("SELECT p_partkey, 'p/q/O' || p_size || '#m().' AS owner, 'p/q/O' || p_size || '#' AS unit, 'p/q/O' || p_size AS short FROM part")
def scl_13_compilation_units(spark, sf_dir):
    symbol = F.concat(F.lit("p/q/O"), F.col("p_size").cast("string"), F.lit("#m().(x)"))
    unit = S.compilation_unit(symbol)
    return table(spark, sf_dir, "part").select("p_partkey", S.symbol_owner(symbol).alias("owner"), unit.alias("unit"), S.strip_last(unit).alias("short"))


@register("SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'sbt' WHEN 1 THEN 'maven' ELSE 'make' END AS build_system, '1.' || o_custkey AS sbt_version, CASE o_custkey % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'js' ELSE 'jvm' END AS platform FROM orders")
def scl_32_build_systems(spark, sf_dir):
    k = F.col("o_custkey") % 3
    found = F.when(k == 0, F.array(F.lit("pom.xml"), F.lit("build.sbt"))).when(k == 1, F.array(F.lit("Makefile"), F.lit("pom.xml"))).otherwise(F.array(F.lit("Makefile")))
    lines = F.array(F.lit("sbt.version=0.13"), F.lit("# x"), F.concat(F.lit("sbt.version = 1."), F.col("o_custkey").cast("string")))
    libs = F.when(k == 0, F.array(F.lit("n1"), F.lit("n2"), F.lit("j"))).when(k == 1, F.array(F.lit("n1"), F.lit("j"))).otherwise(F.array(F.lit("n2")))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.build_system(found).alias("build_system"), S.sbt_version_of(lines).alias("sbt_version"), S.platform(libs, ["n1", "n2"], ["j"]).alias("platform"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '2.11.12' WHEN o_orderkey % 5 = 1 THEN '2.11.12' WHEN o_orderkey % 5 = 2 THEN '2.11.9' WHEN o_orderkey % 5 = 3 THEN '2.12.7' ELSE '2.12.4' END AS version FROM orders")
def scl_34_scala_versions(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    v = F.when(k == 0, "2.10.3").when(k == 1, "2.11.2").when(k == 2, "2.11.9").when(k == 3, "2.13.0").otherwise("2.12.4")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.supported_scala(v).alias("version"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0) AS transitive FROM lineitem")
def scl_36_transitive(spark, sf_dir):
    direct = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(S.bare_artifact(F.concat(F.lit("lib"), F.col("s_suppkey").cast("string"), F.lit("_2.12"))).alias("lib"), F.lit(True).alias("d"))
    used = table(spark, sf_dir, "lineitem").withColumn("lib", S.bare_artifact(F.concat(F.lit("lib"), F.col("l_suppkey").cast("string"), F.lit("_2.11"))))
    return used.join(direct, "lib", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("d").isNull().alias("transitive"))


@register(f"WITH {SITES_SQL} SELECT c.module_id, c.id AS call_site_id, 'f' || p.part AS parent_name FROM sites c JOIN sites p ON p.module_id = c.module_id AND p.id = c.id // 2 WHERE c.id > 1")
def joi_04_parents_of_call_sites(spark, sf_dir):
    s = model(spark, sf_dir).call_sites
    up = s.select("module_id", F.col("call_site_id").alias("parent_id"), F.regexp_extract("declaration_id", r"\.(f\d+)", 1).alias("parent_name"))
    return s.join(up, ["module_id", "parent_id"]).select("module_id", "call_site_id", "parent_name")


@register("""SELECT c_custkey, f.c AS f_cause, f.d AS f_detail, o.c AS o_cause, o.d AS o_detail, p.c AS p_cause, p.d AS p_detail FROM customer
LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS c, min(o_orderkey) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f ON f.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS c, min(o_orderkey) AS d FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS c, min(o_orderkey) AS d FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) p ON p.o_custkey = c_custkey""")
def joi_11_first_failure_by_phase(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("cause"), F.col("o_orderkey").alias("detail"))
    return J.first_failures(table(spark, sf_dir, "customer").select("c_custkey"), {s.lower(): o.where(F.col("o_orderstatus") == s) for s in "FOP"}, "c_custkey", "o_orderkey")


@register("SELECT c_custkey, count(o_orderkey) AS commits FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1")
def joi_29_commits_zero_filled(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("commits"))
    return J.zero_filled(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey")


@register(f"WITH f AS ({FILES_SQL}), h AS (SELECT hash FROM f GROUP BY hash HAVING count(*) > 1) SELECT f.file_id, f.project FROM f WHERE hash IN (SELECT hash FROM h)")
def joi_24_files_of_shared_hashes(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.join(f.groupBy("hash").count().where("count > 1"), "hash", "left_semi").select("file_id", "project")


@register(f"WITH f AS ({FILES_SQL}), m AS (SELECT min(file_id) AS file_id FROM f GROUP BY hash) SELECT file_id, hash FROM f WHERE file_id NOT IN (SELECT file_id FROM m)")
def joi_22_removed_duplicates(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.join(f.groupBy("hash").agg(F.min("file_id").alias("file_id")).select("file_id"), "file_id", "left_anti").select("file_id", "hash")


@register(f"WITH v AS (SELECT {VERSION_SQL} AS version FROM orders) SELECT version, count(*) AS n FROM v GROUP BY version")
def agg_17_version_breakdown(spark, sf_dir):
    return Y.breakdown(table(spark, sf_dir, "orders").select(versions().alias("v")), "v", "version")


@register("SELECT count(DISTINCT l_suppkey) AS projects, count(DISTINCT l_orderkey) AS modules, count(*) AS call_sites FROM lineitem")
def agg_02_merged_statistics(spark, sf_dir):
    return Y.corpus_sizes(table(spark, sf_dir, "lineitem"), {"projects": "l_suppkey", "modules": "l_orderkey"}, "call_sites")


@register(f"WITH {DECL_SQL} SELECT kind, count(*) AS n, count(*) FILTER (is_implicit) AS implicit, count(*) FILTER (has_implicit) AS with_implicit_parameters FROM d GROUP BY 1")
def agg_23_forms(spark, sf_dir):
    d = model(spark, sf_dir).declarations.where("kind IN ('DEF', 'VAL', 'OBJECT')")
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(P.has_property(F.col("properties"), P.IMPLICIT)).alias("implicit"), F.count_if(P.implicit_parameters(F.col("parameter_lists")).isNotNull()).alias("with_implicit_parameters"))


@register(f"WITH {BAG_SQL} SELECT token_hash, count(*) AS n, min(file_id) AS oldest FROM b GROUP BY token_hash")
def agg_25_unique_hashes(spark, sf_dir):
    return bags(spark, sf_dir).groupBy("token_hash").agg(F.count("*").alias("n"), F.min("file_id").alias("oldest"))


@register("SELECT lang AS language, count(*) AS projects, count(*) FILTER (n_chars % 2 = 0) AS forks, count(*) FILTER (n_chars % 3 = 0) AS deleted FROM documents GROUP BY lang")
def agg_34_snapshot(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("projects"), F.count_if(F.col("n_chars") % 2 == 0).alias("forks"), F.count_if(F.col("n_chars") % 3 == 0).alias("deleted"))


@register(f"""WITH f AS ({FILES_SQL}), k AS (SELECT project, hash, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT project, sum(n) AS files FROM k GROUP BY project),
p AS (SELECT x.project AS clone, y.project AS host, sum(x.n) AS a, sum(y.n) AS b FROM k x JOIN k y ON x.hash = y.hash AND x.project < y.project GROUP BY ALL)
SELECT count(*) AS full_clones FROM p JOIN t u ON u.project = clone JOIN t v ON v.project = host WHERE a = u.files AND b = v.files AND u.files >= 10""")
def agg_32_full_clones(spark, sf_dir):
    f = files(spark, sf_dir).select("project", F.col("hash").alias("token_hash"), F.lit(10).alias("total_tokens"))
    return C.project_clones(f, min_percent=100).where("total_files >= 10 AND clone_pct = 100 AND host_pct = 100").agg(F.count("*").alias("full_clones"))


@register("SELECT user_id AS path, max(ts) AS changed_at, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def win_07_newest_per_path(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return Y.first_by(e, ["user_id"], ["ts", "event_id"], {"changed_at": "ts", "newest": "event_id"}, last=True).select(F.col("user_id").alias("path"), "changed_at", F.col("newest").alias("event_id"))


@register("SELECT id, max(v) AS v FROM (SELECT p_partkey AS id, p_size AS v FROM part UNION ALL SELECT s_suppkey, s_nationkey FROM supplier) GROUP BY id ORDER BY id")
def srt_03_merged_in_order(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    return J.merged_in_order(a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("v")), "id", "v")


@register("SELECT p_partkey AS id, p_brand AS name, NULL::DOUBLE AS balance FROM part UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def set_02_bound_rows(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@register("""WITH g AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, list_has_all(['A', 'N'], f) AS inside FROM g""")
def set_08_containment(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return g.select("l_orderkey", (F.size(F.array_except("f", F.array(F.lit("A"), F.lit("N")))) == 0).alias("inside"))


@register("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'PRIVATE_THIS' ELSE 'PUBLIC' END AS access, c_nationkey % 2 = 1 AS is_public, c_nationkey % 2 = 0 AS is_private, false AS is_protected, c_nationkey % 3 = 0 AND c_nationkey % 2 = 0 AS is_from_scala FROM customer")
def scl_21_access_flags(spark, sf_dir):
    even = F.col("c_nationkey") % 2 == 0
    access = F.when(even, "PRIVATE_THIS").otherwise("PUBLIC")
    flags = S.access_flags(access)
    scala = S.from_scala_flags(even, F.when(F.col("c_nationkey") % 3 == 0, "org.scala-lang").otherwise("org.other"), F.lit(False))
    return table(spark, sf_dir, "customer").select("c_custkey", access.alias("access"), *(flags[k].alias(k) for k in ("is_public", "is_private", "is_protected")), scala["is_from_scala"].alias("is_from_scala"))


@register("""WITH n AS (SELECT o_orderstatus AS status, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1)
SELECT status, format('{:,}', n) AS shown, regexp_replace(printf('%.1f', round(p, 1)), '[.]0+$', '') || '%' AS share FROM n""")
def scl_25_formatted_counts(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    n = n.crossJoin(F.broadcast(total))  # one row
    return n.select("status", S.format_count(F.col("n")).alias("shown"), S.format_percent(F.col("n") * 100.0 / F.col("all")).alias("share"))


@register("""WITH o AS (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS price FROM orders GROUP BY 1)
SELECT 'orders' AS key, sum(orders)::DOUBLE AS sum, count(*) AS n, avg(orders) AS mean, median(orders)::DOUBLE AS median, stddev_samp(orders) AS sd, min(orders)::DOUBLE AS min, max(orders)::DOUBLE AS max FROM o
UNION ALL SELECT 'price', sum(price), count(*), avg(price), median(price), stddev_samp(price), min(price), max(price) FROM o""")
def agg_15_overview(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("price"))
    return rstats.make_stats([rstats.add_num(o, c, c) for c in ("orders", "price")])


@register(f"WITH f AS ({FILES_SQL}), g AS (SELECT hash, min(file_id) AS group_id FROM f GROUP BY hash HAVING count(*) > 1) SELECT file_id, group_id FROM f JOIN g USING (hash)")
def joi_28_group_memberships(spark, sf_dir):
    return C.memberships(files(spark, sf_dir), "hash")


@register(f"""WITH {DECL_SQL} SELECT module_id, declaration_id, kind = 'DEF' AS is_method, kind = 'VAL' AS is_val, kind = 'OBJECT' AS is_object, false AS is_class, uri = 'A.scala' OR uri = 'T.scala' AS is_local, false AS is_top, CASE WHEN kind <> 'OBJECT' THEN part % 7 < 3 AND kind = 'DEF' ELSE NULL END AS implicit_list FROM d
UNION ALL SELECT o_orderkey, 'p/W#', false, false, false, true, true, false, NULL FROM orders UNION ALL SELECT o_orderkey, 'p/Top#', false, false, false, true, true, false, NULL FROM orders""")
def prd_03_kinds_and_signatures(spark, sf_dir):
    d = model(spark, sf_dir).declarations.where("kind IN ('DEF', 'VAL', 'OBJECT') OR declaration_id IN ('p/W#', 'p/Top#')")
    last = P.implicit_parameters(P.signature_field(F.col("sig_kind"), "method", F.col("parameter_lists")))
    kinds = {"is_method": "DEF", "is_val": "VAL", "is_object": "OBJECT", "is_class": "CLASS"}
    return d.select("module_id", "declaration_id", *(P.is_kind(F.col("kind"), k).alias(n) for n, k in kinds.items()), P.is_project_local(F.col("location_uri")).alias("is_local"), P.is_top_or_bottom(F.col("declaration_id")).alias("is_top"), F.when(F.col("sig_kind") == "method", last.isNotNull()).alias("implicit_list"))


@register("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'scala/Any#' WHEN 1 THEN 'scala/Nothing#' WHEN 2 THEN 'scala/Int#' ELSE 'scala/AnyRef#' END AS id, event_id % 4 <> 2 AS top FROM events")
def prd_12_top_or_bottom(spark, sf_dir):
    k = F.col("event_id") % 4
    ident = F.when(k == 0, "scala/Any#").when(k == 1, "scala/Nothing#").when(k == 2, "scala/Int#").otherwise("scala/AnyRef#")
    return table(spark, sf_dir, "events").select("event_id", ident.alias("id"), P.is_top_or_bottom(ident).alias("top"))


@register("SELECT o_orderkey AS module_id, unnest(['src', 'own/classes']) AS path, 'compile' AS scope FROM orders UNION ALL SELECT o_orderkey, '../lib.jar', 'test' FROM orders")
def prd_17_paths_by_scope(spark, sf_dir):
    paths = model(spark, sf_dir).paths.select("module_id", "path", "scope")
    return P.of_scope(paths, "compile").unionByName(P.of_scope(paths, "test"))


@register("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 4 > 0")
def prd_22_final_corpus(spark, sf_dir):
    from lodestone.operators.analyses import final_corpus

    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("implicits_exit_code"), F.when(F.col("o_custkey") % 4 == 3, F.col("o_custkey")).otherwise(F.col("o_custkey") % 4).alias("metadata_scala_code"))
    return final_corpus(o).select("o_orderkey")


@register("""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN NULL ELSE CASE user_id % 3 WHEN 0 THEN 'manifest' ELSE 'macro' END END AS source FROM events""")
def prd_25_macros_and_manifests(spark, sf_dir):
    ident = F.when(F.col("user_id") % 3 == 0, "scala/reflect/ManifestFactory.Int().").otherwise("scala/Option.apply().")
    library = F.when(F.col("event_id") % 5 > 0, "g:a")
    source = F.when(P.is_from_macro(library, ident), "macro").when(library.isNull() & P.is_manifest(ident), "manifest")
    return table(spark, sf_dir, "events").select("event_id", source.alias("source"))


@register("SELECT event_id FROM events WHERE event_id % 3 < 2 AND user_id % 2 = 0")
def prd_27_type_proofs(spark, sf_dir):
    k = F.col("event_id") % 3
    ident = F.when(k == 0, "scala/Predef.`=:=`#").when(k == 1, "scala/Predef.`<:<`#").otherwise("p/T#")
    e = table(spark, sf_dir, "events").select("event_id", ident.alias("t"), F.when(F.col("user_id") % 2 == 0, "compile").otherwise("compile;managed;dependency").alias("s"))
    return e.where(P.is_type_proof(F.col("t"), F.col("s"))).select("event_id")


@register("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'UNKNOWN_LANGUAGE' WHEN 1 THEN 'SCALA' WHEN 2 THEN 'JAVA' END AS language, to_timestamp(event_id * 86400 + user_id)::TIMESTAMP AS at FROM events")
def scl_05_enums_and_epochs(spark, sf_dir):
    from lodestone.sources.messages import LANGUAGES

    at = S.from_epoch(F.col("event_id") * 86_400 + F.col("user_id")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", S.encode_enum((F.col("event_id") % 5).cast("int"), LANGUAGES).alias("language"), at.alias("at"))


@register("SELECT DISTINCT c_mktsegment, 20 AS drawn, true AS of_stratum FROM customer")
def prd_30_sample_sizes(spark, sf_dir):
    """How many rows are drawn of each stratum, and whether all are rows of it."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    drawn = P.sample_strata(c, "c_mktsegment", 20, 42)
    own = drawn.join(c.withColumn("own", F.lit(True)), ["c_mktsegment", "c_custkey"], "left")
    return own.groupBy("c_mktsegment").agg(F.count("*").cast("int").alias("drawn"), F.bool_and(F.coalesce("own", F.lit(False))).alias("of_stratum"))
