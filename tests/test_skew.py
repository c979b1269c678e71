from pyspark.sql import functions as F

from tablecheck.operators import skew


def test_salted_join_gives_what_a_plain_join_gives(spark):
    # A third of the rows share key 0, some of them exact copies, and some keys are missing.
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
        (F.col("id") % 5).alias("v"),
    )
    keyed = spark.range(0, 30, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("left", "inner"):
        plain = skew.keyed_join(rows, keyed, ["k"], how)
        salted = skew.keyed_join(rows, keyed, ["k"], how, hot_bytes=3000, force_salt=True)
        assert plain.columns == salted.columns == ["k", "v", "w"]
        assert plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty()
        assert plain.count() == salted.count()


def test_hot_rows_are_spread(spark):
    rows = spark.range(0, 4000, 1, 4).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    keyed = spark.createDataFrame([(1, "x")], "k INT, w STRING")
    joined = skew.keyed_join(rows, keyed, ["k"], hot_bytes=16000, force_salt=True)
    assert joined.filter("w = 'x'").count() == 4000
    assert "__salt" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_salting_reads_only_the_columns_in_use(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    keys = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey")
    joined = skew.lookup(rows, ["l_orderkey"], keys, "known", hot_bytes=200, force_salt=True).select("l_orderkey", "l_tax", "known")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" in plan and "l_shipdate" not in plan


def test_lookup_of_compound_keys(spark, rows):
    left = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, None)], "x INT, y STRING")
    keys = spark.createDataFrame([(1, "a"), (3, "c")], "p INT, q STRING")
    expected = [(1, "a", True), (1, None, False), (2, "b", False), (None, None, False)]
    for force in (False, True):
        got = skew.lookup(left, ["x", "y"], keys, "known", hot_bytes=1, force_salt=force)
        assert sorted(rows(got), key=repr) == sorted(expected, key=repr)


def test_small_tables_are_joined_plainly(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    keys = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey")
    plan = skew.lookup(rows, ["l_orderkey"], keys, "known")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "__salt" not in plan


def test_nothing_runs_before_the_result_is_asked_for(spark):
    broken = spark.range(10).select(F.expr("CAST(id AS INT)").alias("k"), F.expr("raise_error('ran')").cast("string").alias("v"))
    skew.keyed_join(broken, broken.withColumnRenamed("v", "w"), ["k"], force_salt=True)


def test_wide_rows_count_by_their_bytes(spark):
    rows = spark.range(0, 400, 1, 4).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("x"), 1000)).alias("v"))
    hot = skew._hot_keys(rows, ["k"], 50_000).collect()
    assert [h["__salts"] for h in hot] == [5]


def test_hot_keys_of_unlike_types_find_their_parent(spark):
    for child, parent in (("int", "bigint"), ("bigint", "int"), ("decimal(10,2)", "decimal(18,4)"), ("int", "double"), ("string", "int")):
        rows = spark.range(0, 2000, 1, 4).select((F.col("id") % 2).cast("int").cast(child).alias("k"))
        if child == "string":
            rows = rows.select(F.concat(F.lit("0"), "k").alias("k"))
        keys = spark.createDataFrame([(0,), (1,)], "p INT").select(F.col("p").cast(parent))
        found = skew.lookup(rows, ["k"], keys, "known", hot_bytes=2000, force_salt=True)
        assert found.filter("known").count() == found.count() == 2000, (child, parent)
        assert found.schema["k"].dataType == rows.schema["k"].dataType
