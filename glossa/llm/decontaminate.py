"""Benchmark decontamination by a distributed positional inverted index (operator 7), in DataFrame operations only.

Each benchmark item gives windows of consecutive words. The index stores, for the terms that anchor windows, every training
position: a window's anchors are its two rarest terms, by counts over all documents. Their posting lists, shifted by the
terms' places in the item, are intersected (equal document and shift); what is left is checked word by word. Terms of the
benchmark are broadcast only while a count says that they are few; otherwise the same joins shuffle.

Cases: words are runs of digits, letters a-z (A-Z lower-cased) and characters outside ASCII; null or empty texts have no
words; an item of fewer words than a window is one window, an item of none has no window; items without item_id are left
out, items that repeat an item_id add windows to it, and their terms to its proximity query; repeated documents get equal rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark terms or anchors that may be broadcast.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text in order; the first and the last element are empty where the text begins or ends otherwise."""
    return F.split(F.translate(text, UPPER, LOWER), SEPARATOR)


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def postings(docs: DataFrame, terms: DataFrame, text: str = "text", key: str = "dk") -> DataFrame:
    """key, pos, word: the positions of the given terms in all texts."""
    every = docs.select(key, F.posexplode(words(F.col(text))).alias("pos", "word"))
    return every.join(terms, "word", "left_semi")


def windows(items: DataFrame, size: int, text: str = "text", key: str = "item_id") -> DataFrame:
    """key, off, term (array), from every item's words: size of them, or all of a shorter item."""
    of = items.where(F.col(key).isNotNull()).select(key, F.filter(words(F.col(text)), lambda w: w != "").alias("w")).where("size(w) > 0").distinct()
    return of.withColumn("off", F.explode(F.expr(f"sequence(0, greatest(size(w) - {size}, 0))"))).select(F.col(key).cast("string").alias("item"), F.xxhash64("w").alias("version"), "off", F.slice("w", F.col("off") + 1, size).alias("term"))


def anchored(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds first and second to windows: the places, in the item, of their two rarest terms (the only one twice)."""
    at = wins.select("item", "version", "off", F.posexplode("term").alias("i", "word")).join(counts, "word", "left")
    ranked = at.groupBy("item", "version", "off").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (F.col("i") + F.col("off")).alias("place"), "word"))).alias("r"))
    return wins.join(ranked, ["item", "version", "off"]).select("item", "version", "off", "term", F.col("r")[0].alias("first"), F.col("r")[F.least(F.size("r"), F.lit(2)) - 1].alias("second"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """word, n: how often all texts hold each of the given terms, stored."""
    return stored(postings(docs, few(terms.distinct())).groupBy("word").agg(F.count("*").alias("n")), "counts")


def candidates(docs: DataFrame, wins: DataFrame, counts: DataFrame) -> DataFrame:
    """dk, found: for each document the windows whose anchors stand at the right distance, with the place where each would begin."""
    wins = stored(anchored(wins, counts).where("first.n > 0 and second.n > 0"), "windows")
    both = wins.select("item", "version", F.explode(F.array("first", "second")).alias("x")).select("item", "version", F.col("x.place").alias("place"), F.col("x.word").alias("word")).distinct()
    index = stored(postings(docs, few(both.select("word").distinct())), "index")
    shifted = index.join(few(both), "word").select("dk", "item", "version", (F.col("pos") - F.col("place")).alias("shift"), "place")
    met = shifted.groupBy("dk", "item", "version", "shift").agg(F.collect_set("place").alias("places"))
    # A place is the first anchor of as many windows as hold it, so a row meets no more than size of an item's windows.
    at = met.withColumn("at", F.explode("places"))
    held = at.join(few(wins.withColumn("at", F.col("first.place"))), ["item", "version", "at"]).where(F.expr("array_contains(places, second.place) and shift + off >= 0"))
    return held.groupBy("dk").agg(F.collect_list(F.struct("item", (F.col("shift") + F.col("off")).alias("start"), "term")).alias("found"))


def _matched(docs: DataFrame, items: DataFrame, size: int, text: str, key: str, counts: DataFrame | None = None) -> DataFrame:
    """docs with __w (words) and __occ: (item, start, len) of every window's every occurrence, checked word by word (null if none)."""
    docs = docs.withColumn("__dk", F.xxhash64(key, text))
    texts, wins = docs.select(F.col("__dk").alias("dk"), F.col(text).alias("text")), windows(items, size)
    counts = counts or term_counts(texts, wins.select(F.explode("term").alias("word")))
    found = stored(candidates(texts, wins, counts), "found").select(F.col("dk").alias("__d"), F.col("found").alias("__found"))
    met = docs.join(found, F.col("__dk") == F.col("__d"), "left").withColumn("__w", words(F.coalesce(text, F.lit(""))))
    occ = F.filter("__found", lambda c: F.slice("__w", c["start"] + 1, F.size(c["term"])) == c["term"])
    return met.withColumn("__occ", F.transform(occ, lambda c: F.struct(c["item"].alias("item"), c["start"].alias("start"), F.size(c["term"]).alias("len")))).drop("__dk", "__d", "__found")


def clean(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, with their columns, in which no window occurs."""
    return _matched(docs, items, size, text, key).where("coalesce(size(__occ), 0) <= 0").select(*(F.col(f"`{c}`") for c in docs.columns))


#: Proximity: how many of an item's rarest terms must stand near each other, and within how many words of the rarest one.
NEAR_TERMS, SLOP = 4, 10


def report(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated for each document; and n_near: the items of which it holds the NEAR_TERMS rarest terms (all of an item with fewer) within SLOP words of the rarest one."""
    empty = F.expr("cast(array() as array<struct<item: string, start: int, len: int>>)")
    rows = docs.select(key, text)
    texts = rows.select(F.xxhash64(key, text).alias("dk"), F.col(text).alias("text"))
    asked = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("query_id"), F.explode(words(F.coalesce("text", F.lit("")))).alias("word")).where("word <> ''").distinct()
    counts = term_counts(texts, asked.select("word"))
    close = _near(texts, asked, counts, SLOP, NEAR_TERMS).groupBy("dk").agg(F.countDistinct("query_id").alias("__near"))
    m = _matched(rows.withColumn("__near_dk", F.xxhash64(key, text)), items, size, text, key, counts)
    m = m.join(few(stored(close, "near")), F.col("__near_dk") == F.col("dk"), "left").select(key, F.col("__w").alias("w"), F.coalesce("__occ", empty).alias("occ"), F.coalesce("__near", F.lit(0)).alias("n_near"))
    names = F.array_sort(F.array_distinct(F.transform("occ", lambda o: o["item"])))
    hit = F.when(F.size("occ") == 0, 0).otherwise(F.size(F.array_distinct(F.flatten(F.transform("occ", lambda o: F.sequence(o["start"], o["start"] + o["len"] - 1))))))
    n = F.size("w") - F.expr("if(w[0] = '', 1, 0)") - F.expr("if(size(w) > 1 and w[size(w) - 1] = '', 1, 0)")
    return m.select(
        key, n.cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.size("occ") > 0).alias("contaminated"), F.col("n_near").cast("long").alias("n_near"))


def _near(docs: DataFrame, terms: DataFrame, counts: DataFrame, slop: int, most: int | None) -> DataFrame:
    """query_id, dk, pos: where a text (dk, text) has a query's rarest term with its other terms (the most rarest ones altogether) at most slop words away.

    terms: query_id, word, each once; a query with a term that no text holds matches nowhere. Equal texts under one dk count once."""
    ranked = terms.join(few(counts), "word", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("r"))
    ranked = stored(ranked.select("query_id", (F.slice("r", 1, most) if most else F.col("r")).alias("r")).where("r[0].n > 0"), "ranked")
    index = stored(postings(docs, few(ranked.select(F.explode("r.word").alias("word")).distinct())).distinct(), "index")
    at = index.withColumn("stretch", F.floor(F.col("pos") / (slop + 1)))
    rare = at.join(few(ranked.select("query_id", F.col("r")[0]["word"].alias("word"), F.size("r").alias("wanted"))), "word").drop("word")
    rest = few(ranked.select("query_id", F.explode(F.expr("slice(r, 2, size(r))")).alias("x")).select("query_id", F.col("x.word").alias("word")))
    # Only stretches with the rarest term, and their neighbours, are asked for the others.
    around = rare.select("query_id", "dk", "pos", "wanted", F.explode(F.array(F.col("stretch") - 1, F.col("stretch"), F.col("stretch") + 1)).alias("s"))
    others = at.join(rest, "word").select(F.col("query_id").alias("q"), F.col("dk").alias("d"), F.col("pos").alias("p"), "word", F.col("stretch").alias("os"))
    met = around.join(others, F.expr(f"query_id = q and dk = d and s = os and abs(pos - p) <= {slop}"), "left")
    return met.groupBy("query_id", "dk", "pos", "wanted").agg(F.countDistinct("word").alias("had")).where("had = wanted - 1").select("query_id", "dk", "pos")


def near(docs: DataFrame, queries: DataFrame, slop: int, text: str = "text", key: str = "doc_id", most: int | None = None) -> DataFrame:
    """Proximity matches: query_id, key, pos of a query's rarest term wherever every other term (of the most rarest ones, if given) stands at most slop words away.

    queries: query_id, terms (array of words as in the texts); queries that repeat a query_id ask their terms together. Each row of docs is a text
    of its own, told by a hash of key and text: rows that repeat a key don't mix, repeated rows give a match each, and a
    null key is kept. The rarest list is met by the others on the document and a stretch of slop + 1 positions, neighbours
    included; no list meets itself whole."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(key, text).alias("rk"), F.col(f"`{text}`").alias("text"))
    texts = rows.select(F.col("rk").alias("dk"), "text")
    asked = queries.where("query_id is not null").select("query_id", F.explode("terms").alias("word")).where("word <> ''").distinct()
    found = _near(texts, asked, term_counts(texts, asked.select("word")), slop, most)
    return found.join(rows.select("key", "rk"), F.col("dk") == F.col("rk")).select("query_id", F.col("key").alias(key), "pos")
