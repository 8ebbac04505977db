"""Near-duplicate vectors by dual traversal of cover trees (operator 11).

Unit vectors with a cosine of at least c are at most tau = sqrt(2 - 2c) apart, so pairs are sought by distance. Exact copies of a
vector in a label are one class first. The upper level is one list of at most PIVOTS vectors, the classes with the least hashes: a
label of many classes uses as many pivots as it has blocks, each class goes to its nearest one, and a pivot's classes of a label
are a home with a covering radius. A class visits the home of a later pivot only if it can have a partner there: if it
lies within radius + tau of that pivot and within tau of the plane between both pivots. A home's classes, and its visitors, are
dealt into blocks of about BLOCK; each block becomes a cover tree, stored as rows in the tree's order: levels of balls whose radii halve,
each ball around one of its own rows and covering a stretch of them. A home's blocks then meet each other and its visitors' blocks
two by two. Pairs of balls further apart than tau and their covering radii are dropped, pairs that lie within tau
altogether are linked without a look at their rows, others are opened, and pairs of single rows are verified by their cosine.

A task returns for each row the number of its links and one row that it is connected with, never the pairs, so a group of copies
makes as many rows as it has members. Where no ball can be dropped, as for vectors without structure in many dimensions,
every method that is exact compares all classes of a label; the balls then save nothing, and blocks bound only the memory.

Cases: vectors that are null, empty, zero or hold a null or non-finite component, and those with a null label, link with nothing and are
returned; shorter vectors count as padded with zeros; rows that repeat an id, and rows without one, are vectors of their own (the
smallest id of a component is taken among those not null); an empty table gives no rows; extra columns are ignored, whatever their names."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import graph
from glossa.llm.common import spread_join, stored

#: Classes of a block; pivots at most, and the bytes of their components.
BLOCK, PIVOTS, PIVOT_BYTES = 2048, 4096, 32 << 20
#: What a distance may be off by; balls of less are not opened further.
EPS = 1e-6
#: Pairs of rows or balls that are looked at together.
PAIRS = 1 << 16


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the unit rows of a and those of b."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


class Tree:
    """Rows in the order of a cover tree. Ball k covers rows lo[k] to hi[k] and has row lo[k] as its centre, no row is further from it than
    radius[k]. Balls stand in preorder; kids[start[k] : start[k + 1]] are those directly inside."""

    def __init__(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: np.ndarray):
        self.rows, self.lo, self.hi, self.radius = rows, lo, hi, radius
        parent, open_ = np.full(len(lo), -1), []
        for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
            while open_ and hi[open_[-1]] <= a:
                open_.pop()
            parent[k] = open_[-1] if open_ else -1
            open_.append(k)
        self.kids = np.argsort(parent, kind="stable")[1:]  # the first ball is nobody's
        self.start = np.searchsorted(parent[self.kids], np.arange(len(lo) + 1))


def cover(rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """The order of the tree's rows, and (lo, hi, radius) of its balls in preorder.

    A ball's rows are dealt among balls of the next level, whose radius is the greatest of 2, 1, 1/2, ... below the ball's own: the
    centre takes what is near it, the first row left is the next centre."""
    order, balls = np.arange(len(rows)), []
    todo = [(0, len(rows))] if len(rows) else []
    while todo:
        lo, hi = todo.pop()
        ids = order[lo:hi]
        left, part = np.arange(hi - lo), rows[ids]
        near = distances(part, part[:1])[:, 0]
        near[0] = 0.0
        radius = float(near.max())
        balls.append((lo, hi, radius))
        if radius <= EPS:
            continue
        level = 2.0 ** math.ceil(math.log2(radius) - 1)
        took = []
        while True:
            inside = near <= level
            took.append(left[inside])
            left, part = left[~inside], part[~inside]
            if not len(left):
                break
            near = distances(part, part[:1])[:, 0]
            near[0] = 0.0
        order[lo:hi] = ids[np.concatenate(took)]
        ends = lo + np.cumsum([len(t) for t in took])
        todo += reversed([(int(b - len(t)), int(b)) for t, b in zip(took, ends)])
    return order, balls


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers start to start + size of each range, one after the other, and which range each is of."""
    of = np.repeat(np.arange(len(size)), size)
    return start[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size), of


def _products(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray):
    """Parts of at most about PAIRS of (x, y, which) with every x of range a and every y of range b of each pair of ranges."""
    size, i = na * nb, 0
    while i < len(size):
        j = max(i + 1, i + int(np.searchsorted(np.cumsum(size[i:]), PAIRS, side="right")))
        for lo in range(0, int(size[i]) if j == i + 1 else 1, PAIRS):
            k, of = _ranges(np.zeros(j - i, np.int64), size[i:j]) if j > i + 1 else (np.arange(lo, min(lo + PAIRS, int(size[i]))), 0)
            of = of + i
            yield a[of] + k // nb[of], b[of] + k % nb[of], of
        i = j


def dual(a: Tree, b: Tree | None, tau: float, least: float, stats: dict | None = None):
    """Pairs of stretches (lo, hi of a, lo, hi of b) all of whose rows are linked; for b None the pairs in a, where a stretch with itself stands for
    all pairs inside it. Linked single rows are stretches of one."""
    own, b = b is None, b or a
    i, j, d = np.zeros(1, int), np.zeros(1, int), distances(a.rows[:1], b.rows[:1])[0]
    looked = len(d)
    while len(i):
        keep = d <= tau + EPS + a.radius[i] + b.radius[j]
        i, j, d = i[keep], j[keep], d[keep]
        same = (i == j) & own
        # In one ball two rows are at most twice its radius apart.
        whole = np.where(same, 2 * a.radius[i], d + a.radius[i] + b.radius[j]) <= tau - EPS
        yield a.lo[i[whole]], a.hi[i[whole]], b.lo[j[whole]], b.hi[j[whole]]
        i, j, same = i[~whole], j[~whole], same[~whole]
        na, nb = a.start[i + 1] - a.start[i], b.start[j + 1] - b.start[j]
        last = (na == 0) & (nb == 0)
        for x, y, of in _products(a.lo[i[last]], (a.hi - a.lo)[i[last]], b.lo[j[last]], (b.hi - b.lo)[j[last]]):
            hit = np.einsum("ij,ij->i", a.rows[x], b.rows[y]) >= least
            hit &= ~same[last][of] | (x < y)
            looked += len(hit)
            yield x[hit], x[hit] + 1, y[hit], y[hit] + 1
        i, j, same, na, nb = i[~last], j[~last], same[~last], na[~last], nb[~last]
        nexts = []
        big = na * nb > PAIRS // 16
        for p, q, one in zip(i[big], j[big], same[big]):
            x, y = a.kids[a.start[p] : a.start[p + 1]], b.kids[b.start[q] : b.start[q + 1]]
            step = max(1, 8 * PAIRS // len(y))
            for s in range(0, len(x), step):
                far = distances(a.rows[a.lo[x[s : s + step]]], b.rows[b.lo[y]])
                u, v = np.nonzero(far <= tau + EPS + a.radius[x[s : s + step]][:, None] + b.radius[y][None, :])
                looked += far.size
                far, u, v = far[u, v], x[s + u], y[v]
                some = (u <= v) if one else np.ones(len(u), bool)
                nexts.append((u[some], v[some], far[some]))
        i, j, same, na, nb = i[~big], j[~big], same[~big], na[~big], nb[~big]
        # A ball without kids stays as it is while the other one is opened.
        for x, y, of in _products(np.where(na > 0, a.start[i], i), np.maximum(na, 1), np.where(nb > 0, b.start[j], j), np.maximum(nb, 1)):
            x = np.where(na[of] > 0, a.kids[np.minimum(x, len(a.kids) - 1)] if len(a.kids) else x, x)
            y = np.where(nb[of] > 0, b.kids[np.minimum(y, len(b.kids) - 1)] if len(b.kids) else y, y)
            some = ~same[of] | (x <= y)
            x, y = x[some], y[some]
            looked += len(x)
            nexts.append((x, y, np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", a.rows[a.lo[x]], b.rows[b.lo[y]])))))
        i, j, d = (np.concatenate(x) for x in zip(*nexts)) if nexts else (np.zeros(0, int),) * 2 + (np.zeros(0),)
    if stats is not None:
        stats["looked"] = stats.get("looked", 0) + looked


def connected(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows the least one that edges x-y connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(a: Tree, wa: np.ndarray, b: Tree | None, wb: np.ndarray | None, tau: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """links (sums of the partners' weights) and least connected row of all rows of a and, behind them, of b."""
    n, own = len(a.rows), b is None
    weight = wa if own else np.concatenate([wa, wb])
    up, shift = np.concatenate([[0], np.cumsum(weight)]), 0 if own else n
    links, edges = np.zeros(len(weight) + 1, np.int64), []
    for la, ha, lb, hb in dual(a, b, tau, least):
        lb, hb = lb + shift, hb + shift
        inside = (la == lb) & (ha == hb)
        wide = ~inside
        for lo, hi, total in ((la, ha, up[hb] - up[lb]), (lb[wide], hb[wide], (up[ha] - up[la])[wide])):
            np.add.at(links, lo, total)
            np.add.at(links, hi, -total)
        for lo, hi in ((la, ha), (lb, hb)):
            x, of = _ranges(lo, hi - lo)
            edges.append((x, la[of]))
        x, _ = _ranges(la[inside], (ha - la)[inside])  # a row is no partner of its own
        np.add.at(links, x, -weight[x])
        np.add.at(links, x + 1, weight[x])
    x, y = (np.concatenate(e) for e in zip(*edges)) if edges else (np.zeros(0, int),) * 2
    return np.cumsum(links)[:-1], connected(len(weight), x, y)


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, shorter ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size, values = np.asarray(lists.value_lengths(), np.int64), np.asarray(lists.flatten(), np.float64)
    out = np.zeros((len(size), width or int(size.max(initial=0))))
    at, of = _ranges(np.zeros(len(size), np.int64), size)
    out[of, at] = values
    return out


def units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True, initial=1e-300)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda c: c != 0)


def _homes(classes: DataFrame, tau: float) -> DataFrame:
    """node, n, lab, v, home, part (0 or 1: visitors) of every class in each home that it is in or visits."""
    spark = classes.sparkSession
    top, width = classes.agg(F.max("blocks"), F.max(F.size("v"))).first()
    pivots = min(top or 1, PIVOTS, max(1, PIVOT_BYTES // (8 * (width or 1))))
    if pivots < 2:
        return classes.select("node", "n", "lab", "v", F.lit(0).alias("home"), F.lit(0).alias("part"))
    at = classes.orderBy(F.xxhash64("node"), "node").select("v").limit(pivots).toArrow()
    shared = spark.sparkContext.broadcast(units(_matrix(at["v"], width)))
    columns = ["node", "n", "lab", "v", "blocks"]

    def assign(batches):
        pivot = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                d = distances(units(_matrix(part["v"], width)), pivot)
                d[np.arange(len(pivot))[None, :] >= np.asarray(part["blocks"])[:, None]] = np.inf
                home = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(home)), home])], [*columns, "home", "far"])

    kind = classes.schema["lab"].dataType.simpleString()
    row = f"node long, n long, lab {kind}, v array<double>, blocks int, home int, far double"
    placed = stored(classes.select(*columns).mapInArrow(assign, row), "homes")

    def visit(batches):
        pivot = shared.value
        between = distances(pivot, pivot)
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                home, far = np.asarray(part["home"]), np.asarray(part["far"])
                d = distances(units(_matrix(part["v"], width)), pivot)
                q = np.arange(len(pivot))[None, :]
                plane = (d * d - (far * far)[:, None]) <= 2 * (tau + EPS) * between[home] + EPS
                x, to = np.nonzero((q > home[:, None]) & (q < np.asarray(part["blocks"])[:, None]) & plane)
                for i in range(0, len(x), BLOCK):
                    u, v = x[i : i + BLOCK], to[i : i + BLOCK]
                    some = part.take(pa.array(u))
                    yield pa.RecordBatch.from_arrays([*(some[c] for c in columns), pa.array(v.astype(np.int32)), pa.array(d[u, v])], [*columns, "home", "far"])

    radii = placed.where("blocks > 1").groupBy(F.col("lab").alias("l"), F.col("home").alias("h")).agg(F.max("far").alias("radius"))
    met = placed.where("blocks > 1").mapInArrow(visit, row).join(radii, (F.col("lab") == F.col("l")) & (F.col("home") == F.col("h")))
    met = met.where(F.col("far") <= F.col("radius") + F.lit(tau + EPS))
    keep = lambda df, part: df.select("node", "n", "lab", "v", "home", F.lit(part).alias("part"))
    return keep(placed, 0).unionAll(keep(met, 1))


def _trees(homes: DataFrame) -> DataFrame:
    """The rows of every block's tree: lab, home, block, own (blocks of the home), every (blocks with the visitors'), at (place), node, n, v (unit), hi and radius of the balls around it."""
    kind = homes.schema["lab"].dataType.simpleString()
    sizes = homes.groupBy("lab", "home").agg(*(F.ceil(F.count_if(F.col("part") == p) / F.lit(BLOCK)).cast("int").alias(c) for p, c in enumerate(("own", "more"))))
    many = sizes.where("own + more > 1").select(F.col("lab").alias("l"), F.col("home").alias("h"), "own", "more")
    met = homes.join(many, (F.col("lab") == F.col("l")) & (F.col("home") == F.col("h")), "left").fillna({"own": 1, "more": 0})
    block = F.when(F.col("part") == 0, F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.col("own") + F.pmod(F.xxhash64("node"), F.greatest("more", F.lit(1))))
    dealt = met.select("lab", "home", block.cast("int").alias("block"), "own", (F.col("own") + F.col("more")).alias("every"), "node", "n", "v")

    def build(t: pa.Table) -> pa.Table:
        rows = units(_matrix(t["v"]))
        order, balls = cover(rows)
        hi, radius = [[] for _ in order], [[] for _ in order]
        for a, b, r in balls:
            hi[a].append(b)
            radius[a].append(r)
        t, width = t.take(pa.array(order)), rows.shape[1]
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * width), pa.array(rows[order].ravel()))
        return pa.table([*(t[c].combine_chunks() for c in ("lab", "home", "block", "own", "every")), pa.array(np.arange(len(order), dtype=np.int32)), t["node"].combine_chunks(), t["n"].combine_chunks(), v, pa.array(hi, pa.list_(pa.int32())), pa.array(radius, pa.list_(pa.float64()))], columns)

    columns = ["lab", "home", "block", "own", "every", "at", "node", "n", "v", "hi", "radius"]
    return dealt.groupBy("lab", "home", "block").applyInArrow(build, f"lab {kind}, home int, block int, own int, every int, at int, node long, n long, v array<double>, hi array<int>, radius array<double>")


def _meet(trees: DataFrame, threshold: float) -> DataFrame:
    """node, links, root: what each class has found in a pair of blocks, if anything."""
    tau = math.sqrt(max(0.0, 2 - 2 * threshold))
    # A home's block meets itself, its later ones and the visitors'; a visitors' block meets the home's blocks only.
    first = F.expr("transform(sequence(block, every - 1), j -> struct(block as i, j as j))")
    second = F.expr("transform(sequence(0, least(block, own) - 1), i -> struct(i as i, block as j))")
    met = F.when(F.col("block") >= F.col("own"), second).when(F.col("block") == 0, first).otherwise(F.concat(second, first))
    spread = trees.withColumn("p", F.explode(met)).select("lab", "home", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "at", "node", "n", "v", "hi", "radius")

    def tree(t: pa.Table, width: int) -> tuple[Tree, np.ndarray, np.ndarray]:
        t = t.sort_by("at").combine_chunks()
        size = np.asarray(t["hi"].combine_chunks().value_lengths(), np.int64)
        hi, radius = np.asarray(t["hi"].combine_chunks().flatten(), np.int64), np.asarray(t["radius"].combine_chunks().flatten(), np.float64)
        return Tree(_matrix(t["v"], width), np.repeat(np.arange(len(size)), size), hi, radius), np.asarray(t["node"]), np.asarray(t["n"], np.int64)

    def search(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        width = int(np.asarray(t["v"].combine_chunks().value_lengths()).max())
        sides = [tree(t.filter(pa.compute.equal(t["block"], b)), width) for b in sorted({i, j}) if pa.compute.any(pa.compute.equal(t["block"], b)).as_py()]
        out = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        if len(sides) < len({i, j}):  # a hash has left one of the blocks empty
            return out.empty_table()
        (a, node, wa), (b, other, wb) = sides[0], sides[1] if i != j else (None, np.zeros(0, np.int64), None)
        links, root = linked(a, wa, b, wb, tau, threshold)
        node, some = np.concatenate([node, other]), np.flatnonzero(links)
        return pa.table([node[some], links[some], node[root[some]]], schema=out)

    return spread.groupBy("lab", "home", "i", "j").applyInArrow(search, "node long, links long, root long")


def clusters(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept of every row: how many other vectors of its label have a cosine of at least threshold with it, the smallest key reachable by such links, and whether that is its own."""
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("lab"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    ok = usable(F.col("v"), F.col("lab"))
    rows = rows.withColumn("ck", F.when(ok, F.concat_ws(":", F.xxhash64("lab", "v"), F.xxhash64("v", F.lit(1), "lab"))))
    made = rows.where("ck is not null").groupBy("ck", "lab", "v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    made = stored(made.withColumn("node", F.monotonically_increasing_id()), "classes")
    total = made.count()
    sizes = stored(made.groupBy("lab").agg(F.count("*").alias("of")).withColumn("blocks", F.least(F.lit(PIVOTS), F.ceil(F.col("of") / F.lit(BLOCK))).cast("int")), "sizes")
    classes = spread_join(made.select("node", "n", "lab", "v"), sizes, "lab", "of", total, "node")
    trees = stored(_trees(_homes(stored(classes, "sized"), math.sqrt(max(0.0, 2 - 2 * threshold)))), "trees")
    found = stored(_meet(trees, threshold), "found")
    parts = graph.components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "p")
    links = found.groupBy(F.col("node").alias("f")).agg(F.sum("links").alias("links"))
    nodes = made.select("node", "ck", "n", "least").join(parts, F.col("node") == F.col("p"), "left").join(links, F.col("node") == F.col("f"), "left")
    nodes = stored(nodes.select("node", "ck", "n", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "nodes")
    whole = nodes.groupBy("root").agg(F.count("*").alias("of"), F.min("least").alias("component_id"))
    of_class = stored(spread_join(nodes.select("node", "ck", "n", "n_links", "root"), stored(whole, "whole"), "root", "of", total, "node"), "linked")
    met = spread_join(rows.select("id", "ck"), of_class.select("ck", "n", "n_links", "component_id"), "ck", "n", rows.count(), "id")
    component = F.when(F.col("ck").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return met.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
