"""Exact top-k search by the threshold algorithm over sorted per-dimension lists (operator 2).

Vectors are dealt into blocks by a hash of their id, queries likewise; every block of vectors meets every block of
queries. In a block each dimension has a list sorted by component. A query reads the lists of the dimensions in which it
has weight, heads where the weight is positive and tails where it is negative, twice as deep each round; a vector is scored
when it is met for the first time, and never else. No unseen vector can score more than the sum of weight times component at
the depth reached; once that bound is below the kth best score, the query is done with the block. The k best of each block are
merged by a window over each query.

A task holds one block (at most BLOCK vectors and as many queries) and works through its queries one at a time, so besides
the block, its lists and their order it holds one query's rows. search_costs tells how much of the blocks was scored.

Cases: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; shorter
vectors count as padded with zeros; rows that repeat an id count once (the least vector); equal scores go to the smaller
id; with fewer than k candidates all are returned; sums must stay below 2**53; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, LEAST_BLOCK, SPREAD = 8192, 2048, 64


def quantized(x: Column, scale: int) -> Column:
    """floor(scale * component) of each component."""
    return F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))


class Lists:
    """A block of vectors with a list for each dimension: components in rising order and the rows that have them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by], vectors[by]
        self.rows = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.ascontiguousarray(np.take_along_axis(self.vectors, self.rows.T, 0).T)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best vectors but the query's own, and the number of vectors that were scored."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        unseen = np.ones(n, bool)
        at = int(np.searchsorted(self.ids, own))
        if at < n and self.ids[at] == own:
            unseen[at] = False
        if not len(up) and not len(down):  # without weights every vector scores 0
            ids = self.ids[unseen][:k]
            return ids, np.zeros(len(ids)), 0
        ids, scores, before, depth, read = np.zeros(0, np.int64), np.zeros(0), 0, min(n, k), 0
        while True:
            # What this round adds to the depth of each list.
            met = np.concatenate([self.rows[up, n - depth : n - before].ravel(), self.rows[down, before:depth].ravel()])
            new = np.zeros(n, bool)
            new[met] = True
            new = np.flatnonzero(new & unseen)
            unseen[new] = False
            read += len(new)
            ids, scores = np.concatenate([ids, self.ids[new]]), np.concatenate([scores, self.vectors[new] @ query])
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]
            bound = query[up] @ self.values[up, n - depth] + query[down] @ self.values[down, depth - 1]
            # An unseen vector that reaches the bound may tie with the kth one and have the smaller id.
            if depth == n or (len(ids) == k and bound < scores[-1]):
                return ids, scores, read
            before, depth = depth, min(n, 2 * depth)


def _usable(df: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    good = f"`{key}` is not null and `{vector}` is not null and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    return df.where(good).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(vector).alias("v")).select("id", quantized(F.col("v"), scale).alias("v"))


def _blocks(vectors: DataFrame, queries: DataFrame, k: int, scale: int, key: str, vector: str) -> DataFrame:
    """query_id, id, score: each query's k best of each block (vb); scored and size: how many of its vectors were scored."""
    v, q = _usable(vectors, scale, key, vector), _usable(queries, scale, key, vector)
    blocks = lambda n: max(-(-n // BLOCK), min(SPREAD, -(-n // LEAST_BLOCK)), 1)
    nv, nq = blocks(vectors.count()), blocks(8 * queries.count())
    spread = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    v, q = spread(v, "vb", nv, "qb", nq).select("qb", "vb", "id", "v"), spread(q, "qb", nq, "vb", nv).select("qb", "vb", "id", "v")

    def dense(t: pa.Table, width: int) -> np.ndarray:
        lists = t["v"].combine_chunks()
        of, values = np.asarray(lists.offsets), np.asarray(lists.values, np.float64)
        out = np.zeros((len(lists), width))
        size = np.diff(of)
        row = np.repeat(np.arange(len(lists)), size)
        out[row, np.arange(of[0], of[-1]) - np.repeat(of[:-1], size)] = values[of[0] : of[-1]]
        return out

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            width = max(int(np.asarray(t["v"].combine_chunks().value_lengths()).max()) for t in (left, right))
            block, asked, own = Lists(np.asarray(left["id"].combine_chunks(), np.int64), dense(left, width)), dense(right, width), np.asarray(right["id"].combine_chunks(), np.int64)
            for i in range(len(own)):
                ids, scores, read = block.best(asked[i], int(own[i]), k)
                out.append((np.full(len(ids), own[i]), ids, scores, np.full(len(ids), read)))
        qi, vi, s, r = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": qi, "id": vi, "score": s.astype(np.int64), "scored": r.astype(np.int64), "size": np.full(len(qi), left.num_rows), "vb": np.full(len(qi), left["vb"][0].as_py() if left.num_rows else 0, np.int32)})

    return v.groupBy("qb", "vb").cogroup(q.groupBy("qb", "vb")).applyInArrow(search, "query_id long, id long, score long, scored long, size long, vb int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), key, score: each query's k highest integer inner products over all vectors but its own."""
    best = _blocks(vectors, queries, k, scale, key, vector)
    ranked = best.selectExpr("query_id", "id", "score", "cast(row_number() over (partition by query_id order by score desc, id) as int) as rank").where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def search_costs(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: searches (of a query in a block with results), the share of the blocks' vectors that they scored, and the share that stopped before they had scored all."""
    each = _blocks(vectors, queries, k, scale, key, vector).select("query_id", "vb", "size", "scored").distinct()
    return each.agg(F.count("*").alias("searches"), (F.sum("scored") / F.sum("size")).alias("share_scored"), F.avg((F.col("scored") < F.col("size") - 1).cast("int")).alias("share_stopped"))
