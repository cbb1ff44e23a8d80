"""Building blocks against plain windows and joins, with one key holding most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.plans.scale import Running, lookup_join, running_values, top_k_per_group


def skewed(spark, n=600):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.6 else rng.randint(2, 9), rng.randint(0, 5000), i, rng.choice([None, "a", "b", "c"]),
             rng.randint(-5, 5)) for i in range(n)]
    return spark.createDataFrame(rows, "k long, at long, id long, v string, x long").withColumn(
        "b1", F.shiftright("at", 4)).withColumn("b2", F.shiftright("at", 8))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_running_values_equal_plain_windows(spark):
    df = skewed(spark)
    specs = {"last_v": Running("last", F.col("v")), "sum_x": Running("sum", F.col("x"), inclusive=True), "max_x": Running("max", F.col("x"))}
    for reverse in (False, True):
        order = [F.col("at").desc(), F.col("id").desc()] if reverse else ["at", "id"]
        w = Window.partitionBy("k").orderBy(*order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        want = df.select("id", F.last("v", True).over(before).alias("last_v"),
                         F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum_x"),
                         F.max("x").over(before).alias("max_x"))
        for levels in ([], [["b2"]], [["b2", "b1"], ["b2"]]):
            got = running_values(df, ["k"], ["at", "id"], specs, levels, reverse)
            assert got.columns == [*df.columns, *specs]
            assert rows_of(got.select("id", "last_v", "sum_x", "max_x")) == rows_of(want)


def test_missing_buckets_are_buckets(spark):
    rows = [(1, None, 1, "a"), (1, None, 2, "b"), (1, 5, 3, "c"), (1, 900, 4, None), (None, 5, 5, "d"), (None, None, 6, "e"), (None, 9, 7, None)]
    df = spark.createDataFrame(rows, "k long, at long, id long, v string").withColumn("b1", F.shiftright("at", 4)).withColumn("b2", F.shiftright("at", 8))
    for reverse in (False, True):
        order = [F.col("at").desc(), F.col("id").desc()] if reverse else ["at", "id"]
        w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        want = rows_of(df.select("id", F.last("v", True).over(w).alias("x"), F.count("v").over(w).alias("n")))
        spec = {"x": Running("last", F.col("v")), "n": Running("sum", F.when(F.col("v").isNotNull(), 1).otherwise(0))}
        for levels in ([["b2"]], [["b2", "b1"], ["b2"]]):
            got = running_values(df, ["k"], ["at", "id"], spec, levels, reverse)
            assert rows_of(got.select("id", "x", F.coalesce("n", F.lit(0)).alias("n"))) == want


def test_a_hot_key_is_sorted_in_buckets(spark):
    df = running_values(skewed(spark), ["k"], ["at", "id"], {"last_v": Running("last", F.col("v"))}, [["b2"]])
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "__carry_last_v" in plan


def test_running_values_do_not_depend_on_partitions(spark):
    df = skewed(spark)
    spec = {"last_v": Running("last", F.col("v"))}
    results = [rows_of(running_values(df.repartition(n), ["k"], ["at", "id"], spec, [["b2"]]).select("id", "last_v")) for n in (1, 7)]
    assert results[0] == results[1]


def test_lookup_join_equals_join(spark):
    fact = skewed(spark)
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(1, 6)], "k long, name string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = lookup_join(fact, dim, ["k"], ["id"], how)
        assert rows_of(got) == rows_of(fact.join(dim, "k", how).select(*got.columns))


def test_top_k_is_cut_before_the_shuffle(spark):
    df = top_k_per_group(skewed(spark), ["k"], [F.col("x").desc(), F.col("id").asc()], 3)
    assert df.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert plan.count("WindowGroupLimit") == 2


def test_values_are_made_after_the_exchange(spark):
    """A row meets what earlier buckets carry without the running values beside the columns they are made of."""
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), "id", F.floor(F.col("id") / 10).alias("b"), F.lit("text").alias("t"))
    out = running_values(rows, ["k"], ["id"], {"last": Running("last", F.struct("t"))}, [["b"]])
    plan = out._jdf.queryExecution().analyzed().toString().splitlines()
    below = plan[next(n for n, row in enumerate(plan) if "Join LeftOuter" in row) + 1]
    assert "__in_" not in below
    assert out.where("last.t = 'text'").count() == 97
