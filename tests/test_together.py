"""Tables kept together by module: no join by module shuffles them, and what is asked for is what was asked for before."""

from pyspark.sql import functions as F

from lodestone.operators import types as T
from lodestone.operators.lineage import gathered, held, kept_together, made_in_place, materialise, pieces, whole

CLASSES = "module_id long, declaration_id string, sig_kind string, parents array<array<struct<id: string, depth: int>>>, upper array<struct<id: string, depth: int>>, lower array<struct<id: string, depth: int>>"


def classes(spark):
    r = lambda i: [(i, 0)]
    rows = [(m, *x) for m in (1, 2, 3) for x in (("a", "class", [r("b"), r("x")], None, None), ("b", "class", [r("c")], None, None), ("c", "class", [], None, None), ("t", "type", [], r("b"), None), ("x", "class", [], None, None))]
    return spark.createDataFrame(rows, CLASSES)


def test_joins_by_module_and_more_shuffle_nothing(spark):
    rows = spark.range(300).select((F.col("id") % 20).alias("module_id"), F.col("id").cast("string").alias("d"))
    with kept_together(spark, "module_id", 3):
        all_rows = gathered(pieces(rows.where("d < 100"), rows.where("d >= 100")))
        some = materialise(rows.where("d % 3 = 0"))
        joined = all_rows.join(some.withColumn("there", F.lit(True)).hint("merge"), ["module_id", "d"], "left")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.where("there").count() == 100 and joined.count() == 300


def test_small_files_of_many_rows_are_not_broadcast(spark):
    """A million rows of the same ids are 8 KB of Parquet."""
    before = spark.conf.getAll
    with kept_together(spark, "module_id", 2):
        many = materialise(spark.range(1_000_000).select((F.col("id") % 3).alias("module_id"), F.lit("src").alias("path")))
        joined = spark.range(3).withColumnRenamed("id", "module_id").join(many, "module_id")
        assert joined.count() == 1_000_000 and "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.getAll == before


def test_rows_made_in_place_are_where_their_modules_are(spark):
    modules = spark.range(40).withColumnRenamed("id", "module_id")
    with kept_together(spark, "module_id", 3):
        modules = materialise(modules)
        own = materialise(modules.select("module_id", F.lit("a").alias("d"))).select("module_id", F.upper("d").alias("d"))
        both = pieces(own, modules.select("module_id", F.inline(F.array(F.struct(F.lit("b").alias("d")), F.struct(F.lit("c").alias("d"))))))
        assert made_in_place(both, lambda d: d) is None
        both.cheap = True
        joined = made_in_place(both, lambda d: d.withColumn("there", F.lit(True))).join(held(own), ["module_id", "d"], "left_semi")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan
        assert joined.count() == 40
    assert made_in_place(both, lambda d: d) is None


def test_whole_leaves_its_result_alone(spark):
    made = []

    def make():
        made.append(materialise(spark.range(10).withColumnRenamed("id", "module_id")))
        return made[0].where("module_id > 4")

    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    out = whole(make, spark, "module_id", 2)
    assert sorted(r.module_id for r in out.collect()) == [5, 6, 7, 8, 9]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    assert not spark.catalog.tableExists(made[0].materialised_at.rsplit("/", 1)[1].replace("-", "_"))


def test_kinds_of_targets_are_those_of_the_closure(spark):
    d = classes(spark)
    resolved = T.declared_types(d)
    every = {tuple(r) for r in T.kind_closure(d, resolved).where("kind_of IN ('c', 'x')").collect()}
    assert {tuple(r) for r in T.kind_closure(d, resolved, ("c", "x")).collect()} == every and (1, "t", "c") in every


def test_parents_of_the_classes_asked_for(spark):
    d = classes(spark)
    every = {tuple(r) for r in T.grandparent_declarations(d).where("declaration_id = 'a'").collect()}
    asked = d.where("declaration_id = 'a'").select("module_id", "declaration_id")
    assert {tuple(r) for r in T.grandparent_declarations(d, asked).collect()} == every and len(every) == 9
