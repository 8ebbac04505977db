"""Ranks, running sums, totals and tiles by blocks against windows over whole groups."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.operators.kpi import picked
from glossa.operators.ranking import letters, running, tiles, with_total


def test_blocks_equal_windows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), "".join(rng.choice("abé") for _ in range(rng.randint(0, 4))), i, rng.randint(0, 9)) for i in range(300)] + [("one", "x", 301, 3)]
    df = spark.createDataFrame(rows, "g string, k string, i int, v int")
    w = Window.partitionBy("g").orderBy("k", "i")
    got = running(df, ["g"], [letters(F.col("k"))], [F.col("k"), F.col("i")], "place")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.withColumn("place", F.row_number().over(w).cast("long")).collect()))
    got = running(df, ["g"], [letters(F.col("k"), 1)], [F.col("k"), F.col("i")], "upto", "v")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.withColumn("upto", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).collect()))
    for k in (1, 6, 400):
        got = tiles(df, ["g"], [letters(F.col("k"))], [F.col("k"), F.col("i")], k, "tile")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, df.withColumn("tile", F.ntile(k).over(w).cast("long")).collect()))
    assert sorted(map(repr, with_total(df, "g", "v", "t").collect())) == sorted(map(repr, df.withColumn("t", F.sum("v").over(Window.partitionBy("g"))).collect()))
    half = {r.g: r.m for r in picked(df.where("g is not null"), "g", "v", 0.5, "m").collect()}
    for g in ("a", "b", "one"):
        vs = sorted(r[3] for r in rows if r[0] == g)
        assert half[g] == vs[len(vs) // 2]
    assert running(df.where("i < 0"), ["g"], [letters(F.col("k"))], [F.col("k")], "place").count() == 0
