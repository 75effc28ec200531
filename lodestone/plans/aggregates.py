"""Aggregates, windows, sorts and sets over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import rstats
from lodestone.functions import scalars as S
from lodestone.operators import joins
from lodestone.operators import summaries as Y
from lodestone.plans import register, table

MONTH_SQL = "(year(o_orderdate) - 1999) * 12 + month(o_orderdate) - 1"


@register(f"""
WITH o AS (SELECT o_orderstatus AS bucket, {MONTH_SQL} AS month FROM orders), f AS (SELECT bucket, min(month) AS lo FROM o WHERE month <= 40 GROUP BY bucket),
g AS (SELECT bucket, unnest(range(lo, 41))::INTEGER AS month FROM f), c AS (SELECT bucket, month, count(*) AS c FROM o GROUP BY ALL)
SELECT month, bucket, (sum(coalesce(c, 0)) OVER (PARTITION BY bucket ORDER BY month))::BIGINT AS n FROM g LEFT JOIN c USING (bucket, month)""")
def agg_29_cumulative_monthly(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("bucket"), S.month_index(F.col("o_orderdate")).alias("month"))
    return rstats.cumulative(o, "bucket", "month", 40)


@register("""
WITH u AS (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) = 1),
l AS (SELECT (l_returnflag = 'R')::INT + 2 * (l_linestatus = 'O')::INT + 4 * (l_discount > 0.05)::INT + 8 * ((l_suppkey, l_partkey) IN (SELECT (l_suppkey, l_partkey) FROM u))::INT + 16 * (l_quantity > 25)::INT AS f,
        greatest((year(l_shipdate) - 1999) * 12 + month(l_shipdate) - 1, -84) AS m FROM lineitem),
c AS (SELECT f, m, count(*) AS c FROM l GROUP BY ALL),
b AS (SELECT b::INTEGER AS bucket, m::INTEGER AS month FROM range(32) x(b), range(-84, 216) y(m))
SELECT month, bucket, sum(CASE WHEN f = bucket THEN c ELSE 0 END)::BIGINT AS n, sum(CASE WHEN f & bucket = bucket THEN c ELSE 0 END)::BIGINT AS n_with FROM b, c WHERE m <= month GROUP BY month, bucket
UNION ALL SELECT month, bucket, 0, 0 FROM b WHERE month < (SELECT min(m) FROM c)""")
def agg_29_flag_buckets(spark, sf_dir):
    """Lines up to each month in the 32 buckets of five flags, one of which is that no other line has its part and supplier."""
    l = table(spark, sf_dir, "lineitem")
    once = l.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).where("n = 1").select("l_suppkey", "l_partkey", F.lit(True).alias("once"))
    flags = [F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_discount") > 0.05, F.col("once"), F.col("l_quantity") > 25]
    return rstats.cumulative_buckets(l.join(once, ["l_suppkey", "l_partkey"], "left"), flags, S.month_index(F.col("l_shipdate")), -84, 215)


@register("""
SELECT l_suppkey AS project, CASE WHEN count(l_discount) = count(*) THEN sum((l_discount > 0.05)::INT)::BIGINT END AS n_discounted,
  CASE WHEN count(nullif(l_returnflag, 'A')) = count(*) THEN count(*) END AS n_flagged FROM lineitem GROUP BY l_suppkey""")
def agg_11_strict_sums(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") > 0.05).cast("int").alias("x"), F.when(F.col("l_returnflag") != "A", 1).alias("y"))
    return d.groupBy(F.col("l_suppkey").alias("project")).agg(rstats.sum_strict(F.col("x")).alias("n_discounted"), rstats.sum_strict(F.col("y")).alias("n_flagged"))


STATS_SQL = "SELECT '{1}' AS key, sum({0})::DOUBLE AS sum, count(*) AS n, avg({0}) AS mean, median({0}) AS median, stddev_samp({0}) AS sd, min({0})::DOUBLE AS min, max({0})::DOUBLE AS max FROM {2}"


@register(" UNION ALL ".join((STATS_SQL.format("l_extendedprice", "price", "lineitem"), STATS_SQL.format("c_acctbal", "balance", "customer"))))
def agg_14_number_summaries(spark, sf_dir):
    return rstats.make_stats([rstats.add_num(table(spark, sf_dir, t), c, k) for t, c, k in (("lineitem", "l_extendedprice", "price"), ("customer", "c_acctbal", "balance"))])


@register("""
WITH q AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.25) AS lo, quantile_cont(c_acctbal, 0.75) AS hi FROM customer GROUP BY c_nationkey)
SELECT c_custkey, (c_acctbal < lo - 1.5 * (hi - lo) OR c_acctbal > hi + 1.5 * (hi - lo)) AS is_outlier FROM customer JOIN q USING (c_nationkey)""")
def scl_17_outliers(spark, sf_dir):
    return rstats.with_outliers(table(spark, sf_dir, "customer"), "c_acctbal", ["c_nationkey"]).select("c_custkey", "is_outlier")


@register("""
WITH p AS (SELECT l_suppkey AS project_id, l_partkey AS path, CASE WHEN l_returnflag = 'N' THEN 'test' ELSE 'compile' END AS scope, l_linestatus = 'F' AS managed, CASE WHEN l_linenumber < 7 THEN l_quantity END AS code,
  row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag = 'N', l_linestatus ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate, coalesce(CASE WHEN l_linenumber < 7 THEN l_quantity END, -1)) AS k FROM lineitem),
f AS (SELECT project_id, scope, managed, coalesce(code, 0) AS code FROM p WHERE k = 1), s AS (SELECT project_id, coalesce(sum(code) FILTER (scope = 'test' AND managed), 0)::DOUBLE AS tm, coalesce(sum(code) FILTER (scope = 'test' AND NOT managed), 0)::DOUBLE AS tu,
  coalesce(sum(code) FILTER (scope = 'compile' AND managed), 0)::DOUBLE AS cm, coalesce(sum(code) FILTER (scope = 'compile' AND NOT managed), 0)::DOUBLE AS cu FROM f GROUP BY project_id)
SELECT project_id, tm AS code_test_managed, tm + tu AS code_test, cm AS code_compile_managed, cm + cu AS code_compile, tm + tu + cm + cu AS code FROM s""")
def agg_08_pivot(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_linenumber") < 7, F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", F.coalesce(code, F.lit(-1.0)).alias("c"))
    paths = l.select(F.col("l_suppkey").alias("project_id"), F.col("l_partkey").alias("path"), F.when(F.col("l_returnflag") == "N", "test").otherwise("compile").alias("scope"), (F.col("l_linestatus") == "F").alias("managed"), code.alias("code"), order.alias("ord"))
    return Y.code_by_scope(paths)


STATUS_SQL = "CASE WHEN x = 0 THEN 'success' WHEN x = -1 THEN 'not_run' WHEN x = 1 THEN 'failed' WHEN x >= 130 THEN 'timed_out' END"


@register(f"""
WITH e AS (SELECT event_type AS phase, CASE user_id % 5 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN 1 WHEN 3 THEN 137 ELSE 7 END AS x FROM events), s AS (SELECT phase, {STATUS_SQL} AS status FROM e)
SELECT phase, count(*) AS "all", count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'not_run') AS not_run, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'timed_out') AS timed_out
FROM s GROUP BY phase""")
def agg_12_phase_status(spark, sf_dir):
    k = F.col("user_id") % 5
    x = F.when(k == 0, 0).when(k == 1, -1).when(k == 2, 1).when(k == 3, 137).otherwise(7)
    return Y.phase_status(table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), x.alias("x")), "phase", "x")


@register("SELECT 'orders' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'price', round(sum(o_totalprice), 0) FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM orders")
def agg_13_unpivoted_totals(spark, sf_dir):
    return Y.totals(table(spark, sf_dir, "orders"), {"orders": F.count("*"), "price": F.round(F.sum("o_totalprice"), 0), "customers": F.countDistinct("o_custkey")})


@register("SELECT p_type AS type, count(DISTINCT l_suppkey) AS n_projects FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def agg_22_projects_per_type(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    d = d.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("type")), "l_partkey")
    return Y.projects_with(d, "type", "l_suppkey")


@register("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY GROUPING SETS ((user_id), (event_type), (user_id, event_type))")
def agg_20_counts_by_grouping_sets(spark, sf_dir):
    return Y.counts_by_sets(table(spark, sf_dir, "events"), [["user_id"], ["event_type"], ["user_id", "event_type"]])


@register("""SELECT c_mktsegment AS segment, count(*) AS n, sum(c_acctbal) AS balance, 'all' AS step FROM customer GROUP BY ALL
UNION ALL SELECT c_mktsegment, count(*), sum(c_acctbal), 'solvent' FROM customer WHERE c_acctbal > 0 GROUP BY ALL""")
def agg_18_funnel(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return Y.funnel([("all", c), ("solvent", c.where("c_acctbal > 0"))], "c_mktsegment", "segment", {"balance": "c_acctbal"})


@register("SELECT coalesce(nullif(o_orderpriority, '5-LOW'), 'unknown') AS build_system, count(*) AS n FROM orders GROUP BY 1")
def agg_16_breakdown(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("b"))
    return Y.breakdown(o, "b", "build_system", "unknown")


@register("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)
SELECT l_orderkey AS project, l_returnflag AS scope, sum(l_quantity)::DOUBLE AS sloc FROM p WHERE k = 1 GROUP BY ALL""")
def agg_07_sloc_of_first_rows(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("at"))
    first = d.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.min_by("l_quantity", "at").alias("q"))
    return first.groupBy(F.col("l_orderkey").alias("project"), F.col("l_returnflag").alias("scope")).agg(F.sum("q").alias("sloc"))


@register("SELECT user_id, count(*) AS n, arg_min(event_type, (ts, event_id)) AS first_cause FROM events GROUP BY user_id")
def agg_09_first_of_group(spark, sf_dir):
    return Y.first_by(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], {"first_cause": "event_type"})


@register("WITH r AS (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) SELECT p_partkey, p_size FROM r WHERE r <= 20")
def win_01_top_n(spark, sf_dir):
    return rstats.top_n(table(spark, sf_dir, "part").select("p_partkey", "p_size"), 20, "p_size")


@register("WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM k WHERE n = 1")
def win_02_first_per_key(spark, sf_dir):
    return rstats.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@register("SELECT user_id, arg_min(event_id, (ts, event_id)) AS oldest FROM events GROUP BY user_id")
def win_04_oldest_in_group(spark, sf_dir):
    return Y.first_by(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], {"oldest": "event_id"}).drop("n")


@register("WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS largest FROM orders GROUP BY o_custkey")
def win_06_best_per_key(spark, sf_dir):
    return Y.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"], {"largest": "o_orderkey"}, last=True).drop("n")


@register("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events")
def win_08_previous(spark, sf_dir):
    return rstats.with_previous(table(spark, sf_dir, "events"), ["user_id"], "event_id", "previous").select("event_id", "previous")


TOP_SQL = "SELECT p_partkey FROM (SELECT p_partkey, rank() OVER (ORDER BY {0} DESC) AS r FROM part) WHERE r <= 50"


@register(" UNION ".join(TOP_SQL.format(c) for c in ("p_size", "p_retailprice", "p_partkey")))
def srt_05_top_of_three_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a, b, c = (rstats.top_n(p.select("p_partkey", F.col(x).alias("m")), 50, "m").select("p_partkey") for x in ("p_size", "p_retailprice", "p_partkey"))
    return a.union(b).union(c).distinct()


@register("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand")
def srt_01_counts_in_order(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@register("SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 25 UNION SELECT p_partkey FROM part WHERE p_size > 25")
def set_01_union_distinct(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("id"))
    return a.union(table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey")).distinct()


@register("""SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_size < 30) a
FULL JOIN (SELECT p_partkey AS k, p_size + 1000 AS v FROM part WHERE p_size > 20) b USING (k)""")
def set_03_right_wins(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.where("p_size < 30").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return joins.right_wins(a, p.where("p_size > 20").select(F.col("p_partkey").alias("k"), (F.col("p_size") + 1000).alias("v")), "k")


@register("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_05_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(o)
