"""Connected components of an edge table, as joins and aggregations (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import stored


def _least(directed: DataFrame) -> DataFrame:
    """a, b, m: the edges a-b with the least of a and its neighbours b."""
    least = directed.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a_"), F.least("a", "m").alias("m"))
    return directed.join(least, directed["a"] == least["a_"]).select("a", "b", "m")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: for each node of edges (a, b) the least node that it is connected with.

    Every round hangs neighbours on their least neighbour, first the larger ones, then the smaller ones and the node
    itself; the table of a round is written in the shared folder. Paths shorten geometrically, so few rounds do. A hub's
    least neighbour is found by partial aggregation, and its edges meet it in a join that adaptive execution splits.
    Loops, repeated edges and nulls are dropped; an empty table gives an empty table."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # After the large star, an edge leads from the greater to the smaller node.
        met = _least(large)
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(met.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = stored(small, "edges")
        now = tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
