"""Quality figures of extraction runs: repetition, duplicates, overlap, latency, cost, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.ranking import running, with_total


def repetition(each: DataFrame, cell: list[str], n: str = "n") -> DataFrame:
    """cell, most (greatest multiplicity of a key), dup_ratio (1 - distinct / all), from one row per cell and key with its count."""
    return each.groupBy(*cell).agg(F.max(n).alias("most"), (1 - F.count("*") / F.sum(n)).alias("dup_ratio"))


def pair_overlap(words: DataFrame, group: str, cell: str, key: str) -> DataFrame:
    """group, a, b, jaccard of the key sets of every two cells of a group that share a key.

    A key's cells are gathered first, and keys with the same cells counted: pairs are made of cell lists, not of keys."""
    lists = words.groupBy(group, key).agg(F.array_sort(F.collect_set(cell)).alias("cells")).groupBy(group, "cells").agg(F.count("*").alias("n"))
    size = lists.select(group, F.explode("cells").alias(cell), "n").groupBy(group, cell).agg(F.sum("n").alias("n"))
    a = lists.select(group, "cells", "n", F.posexplode("cells").alias("at", "a"))
    both = a.select(group, "a", "n", F.explode(F.expr("slice(cells, at + 2, size(cells))")).alias("b")).groupBy(group, "a", "b").agg(F.sum("n").alias("i"))
    sa, sb = size.select(group, F.col(cell).alias("a"), F.col("n").alias("na")), size.select(group, F.col(cell).alias("b"), F.col("n").alias("nb"))
    return both.join(sa, [group, "a"]).join(sb, [group, "b"]).select(group, "a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("jaccard"))


def picked(df: DataFrame, group: str, value: str, share: float, name: str, block: Column | None = None) -> DataFrame:
    """The element at floor(share * n) of each group's sorted values (an index pick, not an interpolation).

    Equal values are counted first, and counts summed by blocks of neighbouring values (all that share block, if it is given)."""
    counts = with_total(df.groupBy(group, value).agg(F.count("*").alias("_c")), group, "_c", "_total")
    upto = running(counts, [group], [F.col(value) if block is None else block], [F.col(value)], "_upto", "_c")
    return upto.where(F.col("_upto") > F.floor(F.col("_total") * share)).groupBy(group).agg(F.min(value).alias(name))


def core_stability(words: DataFrame, group: str, cell: str, key: str) -> DataFrame:
    """group, core (keys that all cells have), every (keys that any has), stability."""
    cells = words.groupBy(group).agg(F.countDistinct(cell).alias("cells"))
    each = words.groupBy(group, key).agg(F.countDistinct(cell).alias("n")).join(cells, group)
    return each.groupBy(group).agg(F.count_if(F.col("n") == F.col("cells")).alias("core"), F.count("*").alias("every")).withColumn("stability", F.col("core") / F.col("every"))


def diff(a: DataFrame, b: DataFrame, key: str, value: str, lower_is_better: Column) -> DataFrame:
    """key, a, b, delta, pct (of a), verdict of the same figures of two runs."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer").withColumn("delta", F.col("b") - F.col("a"))
    better = F.when(lower_is_better, F.col("delta") < 0).otherwise(F.col("delta") > 0)
    both = both.withColumn("pct", F.when(F.col("a") != 0, 100 * F.col("delta") / F.col("a")))
    return both.withColumn("verdict", F.when(F.col("delta").isNull(), "missing").when(F.col("delta") == 0, "same").when(better, "better").otherwise("worse"))


def capped(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("nth") <= n)


def confusion(df: DataFrame, gold: str, predicted: str, group: list[str]) -> DataFrame:
    """group, n, exact, near (at most one step), mae of ordinals."""
    d = F.abs(F.col(predicted) - F.col(gold))
    return df.where(F.col(predicted).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.avg((d == 0).cast("int")).alias("exact"), F.avg((d <= 1).cast("int")).alias("near"), F.avg(d).alias("mae"))
