"""Scalar functions and predicates over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import predicates as P
from lodestone.functions import scalars as S
from lodestone.plans import register, table


@register("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END AS solvent, c_custkey || ':' || c_nationkey AS position, CASE WHEN c_custkey % 3 > 0 THEN array_to_string(list_transform(range(c_custkey % 3), lambda i: 'a'), ';') END AS tags FROM customer""")
def scl_01_encoders(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    tags = F.array_repeat(F.lit("a"), (F.col("c_custkey") % 3).cast("int"))
    return c.select("c_custkey", S.encode_bool(F.col("c_acctbal") > 0).alias("solvent"), S.encode_position(F.col("c_custkey"), F.col("c_nationkey")).alias("position"), S.encode_list(tags).alias("tags"))


@register("""
WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '../../' || url WHEN 1 THEN url ELSE 'a/../' || url END AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '../') THEN '/' || replace(path, '../', '') ELSE path END AS patched FROM p""")
def scl_06_patched_path(spark, sf_dir):
    k, url = F.col("page_id") % 3, F.col("url")
    path = F.when(k == 0, F.concat(F.lit("../../"), url)).when(k == 1, url).otherwise(F.concat(F.lit("a/../"), url))
    return table(spark, sf_dir, "pages").select("page_id", S.patched_path(path).alias("patched"))


@register("SELECT doc_id, replace(CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END, chr(10), ' ') AS code FROM documents")
def scl_11_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.code_snippet(F.col("text")).alias("code"))


@register("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 0.0 WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE l_discount / l_tax END::DOUBLE AS ratio FROM lineitem""")
def scl_16_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio"))


VERSION_SQL = "CASE o_orderkey % 6 WHEN 0 THEN '0.13.5' WHEN 1 THEN '0.14.0' WHEN 2 THEN '1.0.0' WHEN 3 THEN '1.2.0-RC1' WHEN 4 THEN '1.2' ELSE '0.12.4' END"


def versions():
    k = F.col("o_orderkey") % 6
    return F.when(k == 0, "0.13.5").when(k == 1, "0.14.0").when(k == 2, "1.0.0").when(k == 3, "1.2.0-RC1").when(k == 4, "1.2").otherwise("0.12.4")


@register(f"""
WITH v AS (SELECT o_orderkey, {VERSION_SQL} AS version FROM orders), p AS (SELECT *, list_transform(string_split(regexp_replace(version, '-.*', ''), '.'), lambda x: x::INT) AS n FROM v)
SELECT o_orderkey, CASE WHEN len(n) = 3 THEN (n[1] >= 1) OR (n[1] >= 0 AND n[2] >= 13 AND n[3] >= 5) END :: VARCHAR AS compatible,
  CASE WHEN len(n) <> 3 THEN 'Unknown' WHEN n[1] >= 1 THEN '>= 1.0' WHEN n[2] >= 13 AND n[3] >= 5 THEN '>= 0.13.5' WHEN n[1] = 0 AND n[2] < 13 AND n[3] < 5 THEN '< 0.13.5' ELSE 'Unknown' END AS bucket FROM p""")
def prd_19_sbt_versions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.is_compatible_sbt(versions()).cast("string").alias("compatible"), S.sbt_bucket(versions()).alias("bucket"))


@register(f"""
WITH v AS (SELECT o_orderkey, {VERSION_SQL} AS version, o_custkey % 5 AS commits, epoch(o_orderdate) AS age, o_totalprice FROM orders)
SELECT o_orderkey FROM v WHERE version IN ('0.13.5', '1.0.0', '1.2.0-RC1') AND commits >= 2 AND age - 852076800 > 7889400 AND ((o_orderkey % 100) / 100.0 < 0.75 OR o_totalprice > 200000)""")
def prd_20_corpus_selection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", versions().alias("sbt_version"), (F.col("o_custkey") % 5).alias("commits"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("last_commit_s"), F.lit(852_076_800).alias("first_commit_s"),
        (F.col("o_orderkey") % 100 / 100).alias("duplication"), F.when(F.col("o_totalprice") > 200_000, 5).otherwise(0).alias("stars"),
    )
    return P.select_corpus(o).select("o_orderkey")


@register(r"""SELECT o_orderkey, regexp_replace('o--r::g:a' || o_custkey || ':' || o_orderkey || ':jvm', '^(.*)::([^:]*):([^:]*):[^:]*:([^:]*)$', '\1::\2:\3:\4') AS module FROM orders""")
def scl_23_module_without_version(spark, sf_dir):
    m = F.concat(F.lit("o--r::g:a"), F.col("o_custkey").cast("string"), F.lit(":"), F.col("o_orderkey").cast("string"), F.lit(":jvm"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.without_version(m).alias("module"))


@register("""WITH e AS (SELECT event_id, ((event_id % 40) ** 6)::DOUBLE AS x FROM events) SELECT event_id, CASE WHEN x / 1024 <= 1 THEN printf('%.2f B', x) WHEN x / 1048576 <= 1 THEN printf('%.2f kB', x / 1024)
WHEN x / 1073741824 <= 1 THEN printf('%.2f MB', x / 1048576) ELSE printf('%.2f GB', x / 1073741824) END AS size FROM e""")
def scl_24_sizes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.format_size(F.pow(F.col("event_id") % 40, F.lit(6.0))).alias("size"))


SCOPE_SQL = "CASE event_id % 5 WHEN 0 THEN 'compile' WHEN 1 THEN 'test;managed' WHEN 2 THEN 'compile;managed;dependency;transitive' WHEN 3 THEN 'test;dependency' END"


def scopes():
    k = F.col("event_id") % 5
    return F.when(k == 0, "compile").when(k == 1, "test;managed").when(k == 2, "compile;managed;dependency;transitive").when(k == 3, "test;dependency")


@register(f"""
WITH e AS (SELECT event_id, {SCOPE_SQL} AS s FROM events), f AS (SELECT event_id, contains(s, 'compile') AS is_in_main, contains(s, 'test') AS is_in_test, contains(s, 'dependency') AS is_external, contains(s, 'managed') AS is_managed FROM e)
SELECT event_id, is_in_main::VARCHAR AS is_in_main, is_in_test::VARCHAR AS is_in_test, is_external::VARCHAR AS is_external, is_managed::VARCHAR AS is_managed, (NOT is_external)::VARCHAR AS is_local,
  (is_external AND is_in_test)::VARCHAR AS is_external_test, (NOT is_external AND is_in_test)::VARCHAR AS is_local_test, (is_managed AND is_in_test)::VARCHAR AS is_managed_test FROM f""")
def scl_19_scope_flags(spark, sf_dir):
    flags = S.scope_flags(scopes())
    return table(spark, sf_dir, "events").select("event_id", *(c.cast("string").alias(n) for n, c in flags.items()))


@register(r"""
WITH l AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[error] (compile) Compilation failed' WHEN 1 THEN '[error] (x) sbt.ResolveException: unresolved dependency: ' || event_type || ': not found'
  WHEN 2 THEN '[error] something ' || event_type ELSE 'java.lang.OutOfMemoryError: ' || event_type END AS line, event_type FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'compilation-failed' WHEN 1 THEN 'missing-dependencies' WHEN 2 THEN 'unknown' ELSE 'out-of-memory' END AS cause,
  CASE WHEN event_id % 4 = 1 THEN event_type ELSE line END AS detail FROM l""")
def scl_28_failure_causes(spark, sf_dir):
    k, e = F.col("event_id") % 4, F.col("event_type")
    line = F.when(k == 0, "[error] (compile) Compilation failed").when(k == 1, F.concat(F.lit("[error] (x) sbt.ResolveException: unresolved dependency: "), e, F.lit(": not found")))
    line = line.when(k == 2, F.concat(F.lit("[error] something "), e)).otherwise(F.concat(F.lit("java.lang.OutOfMemoryError: "), e))
    out = table(spark, sf_dir, "events").select("event_id", S.failure_cause(F.array(F.lit("[info] begins"), line)).alias("f"))
    return out.select("event_id", "f.cause", "f.detail")


@register("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'missing-local-symbol' WHEN 1 THEN 'missing-module' WHEN 2 THEN 'unextractable-callsite-missing-term' ELSE 'unclassified' END AS class,
  CASE WHEN event_id % 4 = 0 THEN 'local' || user_id END AS symbol FROM events""")
def scl_29_exception_classes(spark, sf_dir):
    k = F.col("event_id") % 4
    exception = F.when(k == 0, "SymbolNotFoundException").when(k == 1, "LoadingMetadataException").when(k == 2, "UnExtractableCallSiteException").otherwise("Exception")
    message = F.when(k == 0, F.concat(F.lit("no symbol: local"), F.col("user_id").cast("string"))).when(k == 1, "No module found").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", S.exception_class(exception, message, F.lit("SymbolNotFoundException")).alias("class"), S.missing_symbol(message).alias("symbol"))


@register("SELECT event_type AS phase, sum(user_id) FILTER (event_id % 3 = 0)::BIGINT AS spans, sum(event_id + 0.5) FILTER (event_id % 3 = 0) AS ms, sum(event_id + 0.5) FILTER (event_id % 3 = 1) AS total_ms FROM events GROUP BY event_type")
def scl_31_phase_timings(spark, sf_dir):
    numbers = F.concat(F.col("user_id").cast("string"), F.lit(" spans, ()"), F.col("event_id").cast("string"), F.lit(".5ms (32.4%)"))
    k = F.col("event_id") % 3
    line = F.when(k == 0, F.concat(F.lit("[info]   typer   : "), numbers)).when(k == 1, F.concat(F.lit("[info] #total compile time           : "), numbers)).otherwise(F.concat(F.lit("[warn] typer : "), numbers))
    spans, ms = S.phase_timing(line, "typer")
    _, total = S.phase_timing(line, "#total compile time")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), spans.alias("s"), ms.alias("m"), total.alias("t"))
    return rows.groupBy("phase").agg(F.sum("s").alias("spans"), F.sum("m").alias("ms"), F.sum("t").alias("total_ms"))


@register(r"""
WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN rtrim(url, '/') WHEN 1 THEN 'a/node_modules/left/node_modules/pad/test/i.min.js' WHEN 2 THEN 'node_modules/left/locales/x.js' ELSE 'b/locale-de.js' END AS p FROM pages), s AS (SELECT page_id, string_split(p, '/') AS s, page_id % 4 AS k FROM u)
SELECT page_id, len(s)::INTEGER AS depth, CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END::INTEGER AS npm_depth, (list_contains(s, 'test') OR list_contains(s, 'tests'))::INTEGER AS is_test, CASE WHEN k IN (2, 3) THEN 1 WHEN contains(s[-1], 'locale-') OR list_contains(s, 'locale') OR list_contains(s, 'locales') THEN 1 ELSE 0 END::INTEGER AS is_locale,
  CASE k WHEN 1 THEN 'pad' WHEN 2 THEN 'left' ELSE '' END AS module, CASE WHEN k IN (1, 2) THEN 'left' ELSE '' END AS first_module, CASE k WHEN 1 THEN 'i' WHEN 2 THEN 'x' WHEN 3 THEN 'locale-de' ELSE regexp_replace(s[-1], '(\.min)?\.js$', '') END AS file_name,
  CASE k WHEN 1 THEN 'min.js' WHEN 2 THEN 'js' WHEN 3 THEN 'js' ELSE '' END AS file_ext, CASE k WHEN 1 THEN 'test/i.min.js' WHEN 2 THEN 'locales/x.js' ELSE '' END AS in_module FROM s""")
def scl_39_path_features(spark, sf_dir):
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.rtrim(F.col("url"), F.lit("/"))).when(k == 1, "a/node_modules/left/node_modules/pad/test/i.min.js").when(k == 2, "node_modules/left/locales/x.js").otherwise("b/locale-de.js")
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(n) for n, c in S.path_features(path).items()))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey ELSE o_orderkey * 4 + 1 END AS id FROM orders")
def scl_43_chunk_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.chunk_id(F.col("o_orderkey"), 1, 4).alias("id"))


@register(f"SELECT o_orderkey, (year(o_orderdate) - 1999) * 12 + month(o_orderdate) - 1 AS month, epoch(o_orderdate)::BIGINT AS epoch_s FROM orders")
def scl_38_month_index(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.month_index(F.col("o_orderdate")).alias("month"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("epoch_s"))


@register(r"""SELECT doc_id, replace(replace(regexp_replace(text, '(["''\\])', '\\\1', 'g'), chr(10), '\n'), chr(9), '\t') AS escaped FROM documents""")
def scl_40_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.escape_csv(F.col("text")).alias("escaped"))


@register("""WITH f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 10 NOT BETWEEN 2 AND 9), o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM f))
SELECT 'file' AS what, o_orderkey AS id FROM o UNION ALL SELECT 'project', c FROM (SELECT DISTINCT o_custkey AS c FROM orders) WHERE c NOT IN (SELECT o_custkey FROM f) UNION ALL SELECT 'statistics', o_orderkey FROM o""")
def prd_29_clean_chunk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("project_id"), F.md5(F.col("o_orderkey").cast("string")).alias("file_hash"))
    projects, files, stats = P.clean_chunk(o.select("project_id").distinct(), o, o.select("file_hash", "file_id"), 10, 2, 9)
    part = lambda what, df, c: df.select(F.lit(what).alias("what"), F.col(c).alias("id"))
    return part("file", files, "file_id").unionByName(part("project", projects, "project_id")).unionByName(part("statistics", stats, "file_id"))


@register(None)
def prd_30_sample_of_strata(spark, sf_dir):
    return P.sample_strata(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", 20, 42)
