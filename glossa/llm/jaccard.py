"""N-gram Jaccard join by several global token orders (operator 1).

A text's tokens are hashes of its word shingles. Texts with equal token sets form a class; classes are joined, copies are
not. Two sets of Jaccard similarity t share a token among the first n - ceil(t n) + 1 tokens of either, in ANY total
order of tokens. Three orders are used:
  1. rare first, by a count sketch of bounded size over all documents, then by hash: its prefixes are posted and looked up;
  2. and 3. two scrambles of the hash: a candidate pair must share prefix tokens under these as well, before it is verified.
A class goes by 64 bits (its node), and by others where two classes have the same node but not the same further 64 bits.
Pairs of a posting list are not all made. First each member meets the list's least member of its size band (a star); links
found so tie near copies together. Then only members of different components that share a posted token and whose sizes and
prefix positions allow the similarity meet each other (the first token that two linked sets share leaves enough tokens
behind it in both); so every link lies inside a component or has been verified.

Cases: words are runs without ASCII white space, A-Z lower-cased; null or empty texts have no tokens, no links and a
component of their own; a text with fewer words than a shingle is one token; repeated rows are copies; a null doc_id
keeps its row and never names a component that has another; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import byte_table, chunks, hashes, lower_table, mix, spans, spread_join, stored
from glossa.llm.graph import components

#: The sketch has ROWS rows of 2**bits counters: an eighth of the tokens that a task sees on average, within BITS (2 to 32 MB).
#: The Bloom filter has 16 bits for each class that it holds, within 2**BLOOM (128 kB to 32 MB).
ROWS, BITS, BLOOM = 2, (18, 22), (20, 28)
CELLS = 256
_LOWER = lower_table()
_WORD = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
_SCRAMBLE = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93))


def token_sets(data: np.ndarray, offs: np.ndarray, words: int):
    """For each text the sorted array of its distinct shingle hashes."""
    data = _LOWER[data]
    s, e, of = spans(_WORD[data], offs)
    h = hashes(data, s, e)
    mul = [np.uint64(pow(0xA24BAED4963EE407, k, 1 << 64)) for k in range(max(2, words))]
    if len(h) >= words:
        n = len(h) - words + 1
        sh = h[:n] * mul[words - 1]
        for k in range(1, words):
            sh = sh + h[k : n + k] * mul[words - 1 - k]
        sh = mix(sh)
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        if b - a >= words:
            yield np.unique(sh[a : b - words + 1])
        elif b > a:
            few = np.array([b - a], np.uint64)
            for i in range(a, b):
                few = mix(few * mul[1] + h[i : i + 1])
            yield few
        else:
            yield np.zeros(0, np.uint64)


def _cells(tokens: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((tokens * _SCRAMBLE[row] >> np.uint64(64 - bits)).astype(np.int64)) + (row << bits)


def _within(size: float, bounds: tuple[int, int]) -> int:
    """The power of two that is at least size, held within bounds."""
    return min(max(int(np.ceil(np.log2(max(size, 1)))), bounds[0]), bounds[1])


def rarity(docs: DataFrame, words: int, text: str) -> np.ndarray:
    """Counters that bound how many documents hold a token: summed by the tasks, of a bounded size."""
    size = docs.select(F.octet_length(text).alias("n"), F.spark_partition_id().alias("p")).agg(F.sum("n"), F.countDistinct("p")).first()
    bits = _within((size[0] or 0) / 6 / 8 / max(1, size[1]), BITS)

    def count(batches):
        total = np.zeros(ROWS << bits, np.int64)
        for batch in batches:
            for _, data, offs in chunks(batch, text):
                if len(sets := [t for t in token_sets(data, offs, words) if len(t)]):
                    t = np.concatenate(sets)
                    for row in range(ROWS):
                        total += np.bincount(_cells(t, row, bits), minlength=len(total))
        for at in range(0, len(total), 32 * CELLS):
            part = total[at : at + 32 * CELLS]
            if part.any():
                flat = pa.FixedSizeListArray.from_arrays(pa.array(part), CELLS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at // CELLS, at // CELLS + 32, dtype=np.int32)), flat], ["cell", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = np.asarray(batch.column(1).flatten()).reshape(-1, CELLS)
            for c, x in zip(batch.column(0).to_pylist(), rows):
                sums[c] = sums[c] + x if c in sums else x.copy()
        if sums:
            flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(list(sums.values()))), CELLS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), flat], ["cell", "counts"])

    schema = "cell int, counts array<long>"
    got = docs.select(text).mapInArrow(count, schema).repartition("cell").mapInArrow(add, schema).toArrow()
    out = np.zeros((ROWS << bits) // CELLS * CELLS, np.int64).reshape(-1, CELLS)
    if got.num_rows:
        out[np.asarray(got["cell"].combine_chunks())] = np.asarray(got["counts"].combine_chunks().flatten()).reshape(-1, CELLS)
    return np.minimum(out.reshape(-1), 2**31 - 1).astype(np.int32)


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def class_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a token set: the first half is the class's node."""
    a = mix(np.array([tokens.sum(dtype=np.uint64) + np.uint64(len(tokens))]))[0]
    b = mix(np.array([mix(tokens ^ _SCRAMBLE[0]).sum(dtype=np.uint64)]))[0]
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _signatures(docs, sketch, words, percent, text, key):
    """key, n, node, twin; and for the first row of a class in a task where its rare-first prefix ends (last: count and 32 bits of the token, which never
    order two tokens the other way) and the prefixes of its tokens: rare first, and 32 bits each of those by the scrambles."""

    def run(batches):
        counts, seen = sketch.value, set()
        bits = (len(counts) // ROWS).bit_length() - 1
        for batch in batches:
            for part, data, offs in chunks(batch, text):
                cols, orders = [[], [], [], []], [[], [], []]
                for t in token_sets(data, offs, words):
                    k = class_key(t) if len(t) else (None, None)
                    fresh, last = len(t) > 0 and k not in seen, None
                    if fresh:
                        seen.add(k)
                        often = np.minimum(counts[_cells(t, 0, bits)], counts[_cells(t, 1, bits)])
                        p = _prefix(len(t), percent)
                        first = np.lexsort((t, often))[:p]
                        last = (int(often[first[-1]]) << 32) + (int(t[first[-1]]) >> 32)
                        orders[0].append(t[first].astype(np.int64))
                        for out, by in zip(orders[1:], _SCRAMBLE):
                            out.append((np.sort(t * by)[:p] >> np.uint64(8)).astype(np.uint32).view(np.int32))
                    else:
                        for out in orders:
                            out.append(None)
                    for c, x in zip(cols, (len(t), *k, last)):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols), *(pa.array(o, pa.list_(k)) for o, k in zip(orders, (pa.int64(), pa.int32(), pa.int32())))], [key, "n", "node", "twin", "last", "prefix", "p2", "p3"])

    docs = docs.select(key, text)
    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, node long, twin long, last long, prefix array<long>, p2 array<int>, p3 array<int>")


def _clashes(signed: DataFrame) -> DataFrame | None:
    """raw, twin, own: a node of their own for classes whose node (raw) another class has as well; None if there are none."""
    both = signed.where("node is not null").groupBy("node").agg(F.min("twin").alias("t0"), F.max("twin").alias("t1")).where("t0 <> t1")
    both = stored(both.select(F.col("node").alias("raw")), "clashes")
    if both.isEmpty():
        return None
    return stored(signed.join(both, F.col("node") == F.col("raw"), "left_semi").select(F.col("node").alias("raw"), "twin", F.xxhash64("twin", "node").alias("own")).distinct(), "own")


def _renamed(df: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """df (node, twin, ...) with the nodes of clashes."""
    if clashes is None:
        return df
    own = clashes.select(F.col("raw").alias("_r"), F.col("twin").alias("_t"), F.col("own").alias("_o"))
    return df.join(own, (F.col("node") == F.col("_r")) & (F.col("twin") == F.col("_t")), "left").withColumn("node", F.coalesce("_o", "node")).drop("_r", "_t", "_o")


def _token_table(docs, nodes: DataFrame, words, text, clashes):
    """node, twin, tokens of the classes in nodes (told by a Bloom filter of bounded size; others may come along)."""
    spark = docs.sparkSession
    if clashes is not None:
        nodes = nodes.join(clashes.select("own", "raw"), F.col("node") == F.col("own"), "left").select(F.coalesce("raw", "node").alias("node"))
    size = _within(16 * nodes.count(), BLOOM)
    bit = F.expr(f"xxhash64(node) & {(1 << size) - 1}")
    bits = nodes.select(bit.alias("x")).groupBy(F.expr("x >> 6").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 63 as int)))").alias("w")).toArrow()
    table = np.zeros(1 << (size - 6), np.int64)
    table[np.asarray(bits["i"].combine_chunks())] = np.asarray(bits["w"].combine_chunks())
    bloom = spark.sparkContext.broadcast(table.view(np.uint8))

    def run(batches):
        import xxhash

        has, seen = bloom.value, set()
        for batch in batches:
            for _, data, offs in chunks(batch, text):
                rows = []
                for t in token_sets(data, offs, words):
                    if not len(t) or (k := class_key(t)) in seen:
                        continue
                    x = xxhash.xxh64_intdigest((k[0] & (1 << 64) - 1).to_bytes(8, "little"), seed=42) & ((1 << size) - 1)
                    if has[x >> 3] >> (x & 7) & 1:
                        seen.add(k)
                        rows.append((*k, t.astype(np.int64)))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["node", "twin", "tokens"])

    out = docs.select(text).mapInArrow(run, "node long, twin long, tokens array<long>")
    return _renamed(out.groupBy("node", "twin").agg(F.any_value("tokens").alias("tokens")), clashes)


def _filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of nodes whose prefixes meet under orders 2 and 3 as well."""
    a, b = (classes.select(*(F.col(c).alias(c + s) for c in classes.columns)) for s in ("_a", "_b"))
    met = pairs.join(a, F.col("a") == F.col("node_a")).select("a", "b", "p2_a", "p3_a").join(b, F.col("b") == F.col("node_b"))
    return met.where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int, text: str, clashes: DataFrame | None) -> DataFrame:
    """The pairs of nodes whose token sets have the similarity."""
    tokens = stored(_token_table(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")), words, text, clashes), "tokens")
    a, b = (tokens.select(F.col("node").alias("node" + s), F.col("tokens").alias("tokens" + s)) for s in ("_a", "_b"))
    met = pairs.join(a, F.col("a") == F.col("node_a")).select("a", "b", "tokens_a").join(b, F.col("b") == F.col("node_b"))
    common = met.select("a", "b", F.size("tokens_a").alias("na"), F.size("tokens_b").alias("nb"), F.size(F.array_intersect("tokens_a", "tokens_b")).alias("i"))
    return common.where(f"100L * i >= {percent}L * (na + nb - i)").select("a", "b").distinct()


def linked(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(key, n, node: one row per document), (node, root: the classes that have links and the least of those they reach)."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(rarity(docs, words, text))
    signed = stored(_signatures(docs, sketch, words, percent, text, key), "signed")
    clashes = _clashes(signed)
    signed = _renamed(signed, clashes)
    posted = signed.where("prefix is not null").select("node", "n", "last", F.posexplode("prefix").alias("at", "token")).repartition("token")
    posted = posted.groupBy("token", "node").agg(*(F.any_value(c).alias(c) for c in ("n", "at", "last")))
    band = F.floor(F.ln("n") / -np.log(percent / 100)).cast("int")
    lists = posted.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select(F.col("token").alias("t"))
    shared = posted.join(lists, F.col("token") == F.col("t")).select("token", "node", "n", "at", "last", band.alias("band"))
    # top: a set whose prefix ends behind this one's can't have more of this set's tokens, for all of this prefix that it has are in its own prefix.
    # Of a pair, top so bounds the overlap only for the set whose prefix ends first; the other's tokens may stand behind that end.
    bound = "case when {1} < {3} then {0} when {3} < {1} then {2} else greatest({0}, {2}) end".format
    shared = stored(shared.selectExpr("*", f"n - (n - ({percent} * n + 99) div 100 + 1) + count(*) over (partition by node) as top"), "shared")

    # A list's head in a band is the member with the least share of tokens of its own.
    heads = shared.groupBy("token", "band").agg(F.expr("max(struct(top / n as clean, node, n, top, at, last))").alias("h"))
    heads = heads.select(F.col("token").alias("t"), F.col("band").alias("g"), F.col("h.node").alias("head"), F.col("h.n").alias("hn"), F.col("h.top").alias("htop"), F.col("h.at").alias("hat"), F.col("h.last").alias("hlast"))
    star = shared.join(heads, (F.col("token") == F.col("t")) & (F.col("band") == F.col("g"))).where(f"head <> node and {100 + percent} * least({bound('top', 'last', 'htop', 'hlast')}, n - at, hn - hat) >= {percent} * (n + hn)")
    star = stored(star.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "star")
    classes = signed.where("prefix is not null").select("node", "p2", "p3")
    found = stored(_verified(stored(_filtered(star, classes), "near"), docs, words, percent, text, clashes), "found")
    roots = stored(components(found), "roots")

    placed = shared.join(roots.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("token", "node", "n", "at", "last", "top", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select(F.col("token").alias("t"))
    placed = stored(placed.join(mixed, F.col("token") == F.col("t")).drop("t"), "placed")
    x, y = (placed.select(*(F.col(c).alias(c + s) for c in placed.columns)) for s in "xy")
    may = x.join(y, (F.col("tokenx") == F.col("tokeny")) & (F.col("nodex") < F.col("nodey")) & (F.col("rootx") != F.col("rooty")) & F.expr(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny) and {100 + percent} * least({bound('topx', 'lastx', 'topy', 'lasty')}, nx - atx, ny - aty) >= {percent} * (nx + ny)"))
    may = may.select(F.col("nodex").alias("a"), F.col("nodey").alias("b")).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = stored(_filtered(may.join(tried, ["a", "b"], "left_anti"), classes), "near")
    more = _verified(near, docs, words, percent, text, clashes)
    final = stored(components(stored(found.unionAll(more), "links")), "roots")
    return signed.select(key, "n", "node", "twin"), final


def clusters(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id: the least key that a document reaches by links (its own included)."""
    signed, roots = linked(docs, words, percent, text, key)
    signed = signed.select(F.col(key).alias("key"), "n", "node")
    # Least keys and rows by class, then by component; rows find their class, classes their component, however large these are.
    classes = signed.where("node is not null").groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("rows"))
    classes = stored(classes.join(roots.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("node", "least", "rows", F.coalesce("root", "node").alias("root")), "classes")
    of = stored(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")), "components")
    named = spread_join(classes.select("node", "rows", "root"), of, "root", "classes", classes.count(), "node").select("node", "rows", "component_id")
    out = spread_join(signed, named, "node", "rows", signed.count(), "key")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group stays, with all its columns: the one of the least key (null last), then of the least hash of its
    columns. Rows without tokens are groups of their own; rows equal in all columns are one."""
    columns = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    hashed = docs.withColumns({"_h1": F.xxhash64(*columns), "_h2": F.xxhash64(F.lit(1), *columns)})
    rows = hashed.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_h1").alias("h1"), F.col("_h2").alias("h2")).alias("_row"), text)
    kept = clusters(rows, words, percent, text, "_row").where("_row = component_id").selectExpr("_row.h1 as k1", "_row.h2 as k2").distinct()
    met = hashed.join(kept, (F.col("_h1") == F.col("k1")) & (F.col("_h2") == F.col("k2")), "left_semi")
    return met.dropDuplicates(["_h1", "_h2"]).drop("_h1", "_h2")
