"""Joins over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import joins as J
from lodestone.operators import ledger as L
from lodestone.plans import new_folder, register, table


@register("""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^?#]*') AS uri FROM pages),
x AS (SELECT DISTINCT unnest([regexp_extract(uri, '^[a-z]+://[^/]*'), regexp_extract(uri, '^[a-z]+://[^/]*/[^/]*')]) AS path FROM u),
m AS (SELECT page_id, uri, path, row_number() OVER (PARTITION BY page_id ORDER BY length(path) DESC) AS k FROM u LEFT JOIN x ON starts_with(uri, path) AND path <> '')
SELECT page_id, path, length(path)::INTEGER AS path_length FROM m WHERE k = 1""")
def joi_05_longest_prefix(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^?#]*", 0).alias("uri"))
    cuts = F.array(F.regexp_extract("uri", "^[a-z]+://[^/]*", 0), F.regexp_extract("uri", "^[a-z]+://[^/]*/[^/]*", 0))
    x = u.select(F.explode(cuts).alias("path")).where("path <> ''").distinct()
    return J.longest_prefix_join(u, "uri", x.withColumn("path_length", F.length("path")), "path").select("page_id", "path", "path_length")


@register("""
SELECT c_custkey, c_name, n_name AS nation_name, r_name AS region_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def joi_08_left_chain(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    out = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", "c_name", F.col("n_name").alias("nation_name"), F.col("r_name").alias("region_name"))


@register("""
SELECT c_custkey AS k, o.n AS orders_n, o.total AS orders_total, p.n AS pending_n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey AS ck, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) p ON ck = c_custkey""")
def joi_10_prefixed_chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    parts = [(o.groupBy("k").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "orders_"), (o.where("o_orderstatus = 'P'").groupBy("k").agg(F.count("*").alias("n")), "pending_")]
    return J.left_chain(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), parts, "k")


@register("SELECT c_custkey, lower(c_mktsegment) IN (SELECT lower(p_brand) FROM part UNION SELECT 'building') AS listed FROM customer")
def joi_09_mark(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("x")).union(spark.createDataFrame([("building",)], "x string"))
    return J.mark_join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", names, "x", "listed", ignore_case=True).select("c_custkey", "listed")


@register("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def joi_07_anti(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").join(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@register("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 11 > 0 THEN 2 ELSE 1 END AS attempt, CASE WHEN p_partkey % 11 = 0 THEN 'Status 404' END AS error FROM part""")
def joi_07_resumed(spark, sf_dir):
    """Parts looked up in batches, of which some fail for good and some at the first try: a second run does the latter alone."""
    to, parts = new_folder(spark), table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")

    def look_up(attempt: int):
        failing = F.when(k % 11 == 0, "Status 404").when((k % 7 == 0) & F.lit(attempt == 1), "Status 500")
        return lambda keys: keys.select("p_partkey", F.lit(attempt).alias("attempt"), failing.alias("error"))

    for attempt in (1, 2):
        L.resume(parts, ["p_partkey"], look_up(attempt), to, batches=3, lasting=("Status 404",))
    return L.results(spark, to, ("Status 404",))


@register("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_shipdate > o_orderdate)")
def joi_12_semi(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_shipdate")
    return o.join(l, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")), "left_semi").select("o_orderkey")


@register("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0)::DOUBLE AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def joi_16_all_of_the_corpus(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return J.zero_filled(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey")


@register("SELECT l_partkey, 'missing part' AS message FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def joi_01_lookup_errors(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return J.lookup(table(spark, sf_dir, "lineitem"), p, ["l_partkey"], "part")[1]


@register("""
WITH p AS (SELECT l_orderkey AS module_id, l_partkey % 7 AS path, CASE WHEN l_returnflag = 'N' THEN 'test' ELSE 'compile' END AS scope, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::INTEGER AS ord FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY module_id, path ORDER BY scope = 'test', CASE WHEN scope = 'test' THEN -ord ELSE ord END) AS n FROM p)
SELECT module_id, path, scope, ord FROM k WHERE n = 1""")
def win_05_effective_paths(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    ord_ = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
    scope = F.when(F.col("l_returnflag") == "N", "test").otherwise("compile")
    return J.effective_paths(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module_id"), (F.col("l_partkey") % 7).alias("path"), scope.alias("scope"), ord_.alias("ord")))


@register("SELECT r_name, n_regionkey, count(*) AS n FROM region CROSS JOIN nation GROUP BY ALL")
def src_14_cross_product(spark, sf_dir):
    return F.broadcast(table(spark, sf_dir, "region").select("r_name")).crossJoin(table(spark, sf_dir, "nation").select("n_regionkey")).groupBy("r_name", "n_regionkey").agg(F.count("*").alias("n"))


@register("""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^?#]*') AS uri FROM pages), x AS (SELECT DISTINCT regexp_extract(uri, '^[a-z]+://[^/]*') AS path FROM u WHERE uri <> ''),
k AS (SELECT path, length(path) % 2 = 0 AS source, length(path) % 3 = 0 AS test FROM x WHERE path <> '')
SELECT page_id, coalesce(source AND test, false) AS is_test FROM u LEFT JOIN k ON starts_with(uri, path) AND NOT EXISTS (SELECT 1 FROM k z WHERE starts_with(uri, z.path) AND length(z.path) > length(k.path))""")
def joi_06_documents_in_tests(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^?#]*", 0).alias("uri"))
    paths = u.select(F.regexp_extract("uri", "^[a-z]+://[^/]*", 0).alias("path")).where("path <> ''").distinct()
    n = F.length("path")
    paths = paths.select("path", F.when(n % 2 == 0, "source").otherwise("class").alias("entry_kind"), F.when(n % 3 == 0, "test").otherwise("compile").alias("scope"))
    return J.in_tests(u, "uri", paths).select("page_id", "is_test")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def joi_12_listed_only(spark, sf_dir):
    """Orders of the listed customers, each of whom must have one."""
    listed = table(spark, sf_dir, "orders").select("o_custkey").distinct().join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return J.listed_only(table(spark, sf_dir, "orders"), listed, "o_custkey").select("o_orderkey", "o_custkey")
