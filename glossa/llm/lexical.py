"""Ranked lexical search (operator 12): a blocked sparse product of an item-term matrix and a term-document matrix.

Items are few and asked together: their distinct terms are the columns of a matrix of multiplicities (1 where each
term counts once) and the rows of a matrix of documents' impacts, both sparse and of int64. One pass over all documents finds the items'
terms in whole texts and stores, for each document with any, its length and its terms' numbers; counts of documents per term and
the totals come from that table, over all documents. Then every task turns its documents, a block at a time, into the
rows of the impact matrix and multiplies by Gustavson's rule: for a row of the items' matrix the impact rows of its terms
are merged by adding them into one accumulator over the block's documents. Each task keeps the k best of an item over its blocks, and
two windows (over groups of tasks, then over items) reduce them to the k best of all.

Items are dealt into groups of at most ITEMS rows and about ITEM_BYTES of text; a group's terms are what is broadcast. Each group makes one pass
over the documents, so any number of items is asked in bounded memory; one item is one task's text at most.

Cases: terms are runs of digits, letters (A-Z lower-cased) and characters outside ASCII; a null or empty text has none, and such a
document is not counted; rows that repeat a doc_id are documents of their own; a null doc_id ranks last among equal scores; items
that repeat an item_id ask their terms together; items without item_id are left out; an item without terms, or whose terms
no document holds, has no rows; an empty table gives no rows; very long texts are read whole; extra columns are ignored, whatever their names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import byte_table, chunks, lower_table, spans, stored

ITEMS, ITEM_BYTES = 4096, 4 << 20
#: Documents, and terms in them, of a block of the impact matrix.
BLOCK, BLOCK_TERMS = 8192, 1 << 20
#: Groups of tasks that the first reduction works on.
GROUPS = 64

_INSIDE, _LOWER = byte_table(lambda b: b >= 128 or chr(b).isalnum()), lower_table()


def terms_of(data: np.ndarray, offs: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All terms of texts, and for each text the index of its first one (and the end)."""
    data = _LOWER[data]
    s, e, first = spans(_INSIDE[data], offs)
    # Terms and what stands between them by turns: offsets of one array without a copy.
    border = np.zeros(2 * len(s) + 1, np.int64)
    border[:-1:2], border[1::2] = s, e
    border[-1] = e[-1] if len(e) else 0
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(s), [None, pa.py_buffer(border), pa.py_buffer(data)])
    return every.take(pa.array(np.arange(0, 2 * len(s), 2))), first


class Items:
    """A group of items as a sparse matrix: item i has the terms number term[start[i]:start[i + 1]], each times times."""

    def __init__(self, rows: pa.Table, repeats: bool):
        coded = rows["item"].combine_chunks().dictionary_encode()
        self.names, of = coded.dictionary, np.asarray(coded.indices, np.int64)
        _, data, offs = next(chunks(rows.select(["text"]).combine_chunks().to_batches()[0], "text", 1 << 62))
        words, first = terms_of(data, offs)
        coded = words.dictionary_encode()
        self.terms, wide = coded.dictionary, max(1, len(coded.dictionary))
        pair, n = np.unique(np.repeat(of, np.diff(first)) * wide + np.asarray(coded.indices, np.int64), return_counts=True)
        self.term, self.times = pair % wide, n if repeats else np.ones(len(n), np.int64)
        self.start = np.searchsorted(pair // wide, np.arange(len(self.names) + 1))


def found(docs: DataFrame, terms: pa.Array, key: str, text: str) -> DataFrame:
    """key, n (terms of the text), terms (numbers of those that occur), tf (how often) of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, "text"):
                words, first = terms_of(data, offs)
                n = np.diff(first)
                number = pc.index_in(words, value_set=shared.value)
                at, of = np.flatnonzero(np.asarray(number.is_valid())), np.repeat(np.arange(len(n)), n)
                wide = max(1, len(shared.value))
                pair, tf = np.unique(of[at] * wide + np.asarray(number.drop_null(), np.int64), return_counts=True)
                ends = pa.array(np.searchsorted(pair // wide, np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % wide, tf)]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], ["key", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "key long, n long, terms array<int>, tf array<int>")


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with n terms each: half of it grows with n against the mean."""
    if 50 * int(n.max(initial=0)) * documents < 1 << 63:
        return 50 + (50 * n * documents) // total
    return np.array([50 + (50 * int(x) * documents) // total for x in n], np.int64)


def best(scores: np.ndarray, key: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores above 0; equal ones by key, missing keys last."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= least]
    return some[np.lexsort((key[some], missing[some], -scores[some]))][:k]


def product(items: Items, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
    """(item, scores of a block's documents) of each item that meets the block, by Gustavson's rule.

    term, doc, impact: the block's entries of the term-document matrix, in the order of the terms; a term has a document once."""
    row = np.searchsorted(term, np.arange(len(items.terms) + 1))
    for i in range(len(items.names)):
        merged = None
        for j in range(items.start[i], items.start[i + 1]):
            a, b = row[items.term[j]], row[items.term[j] + 1]
            if a < b:
                merged = np.zeros(docs, np.int64) if merged is None else merged
                merged[doc[a:b]] += items.times[j] * impact[a:b]
        if merged is not None:
            yield i, merged


def _scored(rows: DataFrame, items: Items, weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """item (number), key, score: the k best of each item in each task."""
    shared = rows.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = shared.value
        # What an item has so far: scores, keys and whether the key is missing.
        kept: dict[int, tuple] = {}
        for batch in batches:
            size, at = np.asarray(pc.list_value_length(batch["terms"]), np.int64), 0
            before = np.concatenate([[0], np.cumsum(size)])
            while at < len(size):
                to = max(at + 1, min(at + BLOCK, int(np.searchsorted(before, before[at] + BLOCK_TERMS, side="right")) - 1))
                part = batch.slice(at, to - at)
                key, missing = np.asarray(part["key"].fill_null(0), np.int64), np.asarray(part["key"].is_null())
                term, tf = (np.asarray(part[c].flatten(), np.int64) for c in ("terms", "tf"))
                doc = np.repeat(np.arange(to - at), size[at:to])
                m = lengths(np.asarray(part["n"], np.int64), documents, total)[doc]
                impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                by = np.argsort(term, kind="stable")
                for i, scores in product(items, term[by], doc[by], impact[by], to - at):
                    new = best(scores, key, missing, k)
                    both = [np.concatenate(x) for x in zip(kept.get(i, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))), (scores[new], key[new], missing[new]))]
                    kept[i] = tuple(x[best(both[0], both[1], both[2], k)] for x in both)
                at = to
        for i, (score, key, missing) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, np.int32)), pa.array(key, mask=missing), pa.array(score)], ["item", "key", "score"])

    return rows.mapInArrow(run, "item int, key long, score long")


def _first(df: DataFrame, by: str, k: int) -> DataFrame:
    """df with rank, up to k, in each group of by."""
    return df.withColumn("rank", F.expr(f"cast(row_number() over (partition by {by} order by score desc, key asc nulls last) as int)")).where(F.col("rank") <= k)


def groups(items: DataFrame, item: str, text: str) -> Iterator[pa.Table]:
    """The items' rows (item, text), in tables of at most ITEMS rows and about ITEM_BYTES of text, all rows of an item in one."""
    rows = items.where(F.col(f"`{item}`").isNotNull()).select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // ITEMS), -(-size // ITEM_BYTES))
    for g in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == g).toArrow()
        if got.num_rows:
            yield got


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, repeats: bool = False, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """item, rank (from 1), key, score: each item's k highest-scoring documents, of all with a score above 0.

    repeats: a term counts as often as the item has it, not once."""
    spark = docs.sparkSession
    kind = items.schema[item].dataType.simpleString()
    out = None
    for rows in groups(items, item, text):
        asked = Items(rows, repeats)
        have = stored(found(docs, asked.terms, key, text), "found")
        documents, total = have.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        df = np.zeros(len(asked.terms), np.int64)
        for t, n in have.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the group
            df[t] = n
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        scored = _scored(have.where("size(terms) > 0"), asked, weights, documents, total, k).withColumn("g", F.spark_partition_id() % GROUPS)
        top = _first(_first(scored, "item, g", k).drop("rank"), "item", k)
        names = spark.createDataFrame(pa.table({"number": pa.array(np.arange(len(asked.names), dtype=np.int32)), "name": asked.names}))
        got = top.join(F.broadcast(names), F.col("item") == F.col("number")).select(F.col("name").cast(kind).alias(item), "rank", F.col("key").alias(key), "score")
        out = got if out is None else out.unionAll(got)
    return spark.createDataFrame([], f"`{item}` {kind}, rank int, `{key}` long, score long") if out is None else out
