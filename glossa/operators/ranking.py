"""Ranks and running sums of large groups: blocks in the order are summed first, so no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_total(counts: DataFrame, group: str | list[str], value: str, name: str, beside: str | None = None) -> DataFrame:
    """counts with the sum of value over each group. The sums are aggregated, so no group is gathered, and meet the counts in a
    join, which adaptive execution turns into a broadcast where the sums, as they have come out, are small; else it splits large groups.

    beside: a column of whole numbers that is aggregated with value. The sums then read it too, so both sides of the join share
    one shuffle, and what the counts come from is read once."""
    group = [group] if isinstance(group, str) else group
    read = counts.where(F.col(beside).isNull() | (F.col(beside) >= F.lit(-(1 << 63)))) if beside else counts  # holds for every row
    totals = read.groupBy(*(F.col(c).alias(f"_g_{c}") for c in group)).agg(F.sum(value).alias(name))
    return counts.join(totals, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]).drop(*(f"_g_{c}" for c in group))


def tiles(df: DataFrame, group: list[str], blocks: list[Column], order: list[Column], k: int, name: str) -> DataFrame:
    """df with name 1..k: its group's rows by order in k parts, the first ones one row longer where k doesn't divide them."""
    ranked = running(with_total(df.withColumn("_one", F.lit(1)), group, "_one", "_n"), group, blocks, order, "_place")
    size, more, at = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("_place")
    long = more * (size + 1)
    tile = F.when(at <= long, F.ceil(at / (size + 1))).otherwise(more + F.ceil((at - long) / F.greatest(size, F.lit(1))))
    return ranked.withColumn(name, tile.cast("long")).drop("_one", "_n", "_place")


def running(df: DataFrame, group: list[str], blocks: list[Column], order: list[Column], name: str, value: str | None = None) -> DataFrame:
    """df with name: the rank of each row in its group by order (its place, from 1), or the running sum of value.

    blocks: expressions that never fall (as they are sorted) while the rows go on in order, such as the first letters of a key:
    a block holds neighbours. Blocks are summed, their sums are added up per group, and rows are ranked inside their block."""
    keys = [f"_b{i}" for i in range(len(blocks))]
    rows = df.withColumns(dict(zip(keys, blocks)))
    each = F.sum(value) if value else F.count("*")
    before = Window.partitionBy(*group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, *keys).agg(each.alias("_n"))
    offsets = sums.select(*(F.col(c).alias(f"_o_{c}") for c in [*group, *keys]), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, *keys).orderBy(*order)
    own = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) if value else F.row_number().over(inside)
    met = rows.withColumn("_own", own).join(offsets, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*group, *keys]])
    return met.select(*df.columns, (F.col("_offset") + F.col("_own")).cast("long").alias(name))


def letters(key: Column, n: int = 2) -> Column:
    """A block for an order by key: its first letters."""
    return F.substring(key, 1, n)
