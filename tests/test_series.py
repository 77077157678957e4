"""The two distributed window tools against plain single-partition windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickframe.operators.series import Running, in_blocks, number_rows, running


def walk(spark, n=300, symbols=3, seed=1):
    rnd = random.Random(seed)
    rows = []
    for s in range(symbols):
        t = 1_704_067_200
        for i in range(n):
            t += rnd.choice([60, 60, 60, 3600, 200_000])
            rows.append((f"s{s}", t, rnd.choice([None, rnd.randint(-9, 9)]), rnd.randint(0, 99)))
    return spark.createDataFrame(rows, "symbol string, t long, maybe long, v long").withColumn(
        "ts", F.timestamp_seconds("t"))


@pytest.mark.parametrize("span", [120, 86400, 10**9])
def test_running_equals_one_window(spark, span):
    df = walk(spark)
    got = running(df, ["symbol"], ["ts"], {
        "s": Running("sum", F.col("v")), "hi": Running("max", F.col("maybe")),
        "lo": Running("min", F.col("maybe")), "last": Running("last", F.col("maybe")),
        "seen": Running("last", F.col("maybe"), before=True),
        "earlier": Running("sum", F.col("v"), before=True),
        "was": Running("prev", F.col("maybe"))}, span=span)
    w = Window.partitionBy("symbol").orderBy("ts")
    up_to, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", F.sum("v").over(up_to).alias("s"), F.max("maybe").over(up_to).alias("hi"),
        F.min("maybe").over(up_to).alias("lo"), F.last("maybe", True).over(up_to).alias("last"),
        F.last("maybe", True).over(before).alias("seen"), F.sum("v").over(before).alias("earlier"),
        F.lag("maybe").over(w).alias("was"))
    cols = ["symbol", "t", "s", "hi", "lo", "last", "seen", "earlier", "was"]
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))


@pytest.mark.parametrize("block", [7, 50, 10**6])
def test_blocks_equal_one_window(spark, block):
    df = number_rows(walk(spark), ["symbol"])

    def compute(rows, by):
        w = Window.partitionBy(*by).orderBy("bar_no").rowsBetween(-6, 0)
        return rows.withColumn("x", F.sum("v").over(w))

    got = in_blocks(df, ["symbol"], 6, compute, block=block)
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-6, 0)
    want = df.withColumn("x", F.sum("v").over(w))
    assert got.count() == df.count()
    assert sorted(got.select("symbol", "bar_no", "x").collect()) == sorted(want.select("symbol", "bar_no", "x").collect())


def test_order_with_ties_follows_seq(spark):
    rows = [("a", 100, i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, t long, seq long, v long").withColumn(
        "ts", F.timestamp_seconds("t"))
    got = running(df.repartition(7), ["symbol"], ["ts", "seq"], {"last": Running("last", F.col("v"))})
    assert all(r.last == r.seq for r in got.collect())
