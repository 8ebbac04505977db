"""Queries that write a learning store of five tables and change several of them in one transaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import adapters as A
from glossa.operators.adapters import NOW_MS, oracle
from glossa.plans.base import query
from glossa.sources.readers import scratch
from glossa.sources.tables import Table, TableStore

TABLES = {
    "contents": Table("id long, title string, source_type string, created_at long", "id"),
    "vocabulary": Table("id string, content_id long, original string, translation string, leitner_box int, last_reviewed long, correct_count int, incorrect_count int, created_at long", "id", unique="original", parent=("contents", "content_id")),
    "settings": Table("key string, value string", "key", buckets=1),
    "review_days": Table("day date", "day", buckets=1),
    "content_adds_log": Table("id long, added_at long", "id"),
}


def opened(spark, sf, cards="true") -> TableStore:
    """A new store with the contents, their log, the settings and days of all events, and the cards (where cards holds), put in by one transaction."""
    store = TableStore(spark, scratch(spark, "store"), TABLES)
    contents, events = A.contents(spark, sf), A.table(spark, sf, "events")

    def fill(tx):
        tx.insert("contents", contents)
        tx.insert("content_adds_log", contents.select("id", F.col("created_at").alias("added_at")))
        tx.upsert("settings", events.select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), F.struct("ts", "event_id").alias("seq")), "seq")
        tx.insert("review_days", events.select(F.to_date("ts").alias("day")).distinct())
        tx.insert_or_ignore("vocabulary", A.vocabulary(spark, sf, levels=False).where(cards), ["doc_id", "pos", "id"])

    store.run(fill)
    return store


_FIRST = "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY original ORDER BY doc_id, pos, id) AS r FROM vocabulary{}) WHERE r = 1)"
_COUNTS = "n AS (SELECT 'contents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'vocabulary', count(*) FROM first UNION ALL SELECT 'settings', count(DISTINCT event_type) FROM events UNION ALL SELECT 'review_days', count(DISTINCT ts::DATE) FROM events UNION ALL SELECT 'content_adds_log', count(*) FROM documents)"


def _with(views, tables, body):
    return oracle(views, "").rstrip() + ",\n" + tables + "\n" + body


@query(_with("vocabulary", _FIRST.format("") + ",\n" + _COUNTS, "SELECT name, n AS cleared, 0::BIGINT AS held, 2 AS version FROM n"))
def clear_all(spark, sf):
    """Clears all five tables at once, and reads back what they hold."""
    store = opened(spark, sf)
    had = store.run(lambda tx: tx.clear(*TABLES))
    held = None
    for name in TABLES:
        n = store.read(name).agg(F.count("*").alias("held")).select(F.lit(name).alias("name"), F.lit(had[name]).cast("long").alias("cleared"), "held", F.lit(store.newest()).alias("version"))
        held = n if held is None else held.unionAll(n)
    return held


@query(_with("vocabulary", _FIRST.format(" WHERE content_id % 3 = 0") + ",\nmore AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY original ORDER BY doc_id, pos, id) AS r FROM vocabulary WHERE content_id % 3 <> 0) WHERE r = 1 AND original NOT IN (SELECT original FROM first))", "SELECT (SELECT count(*) FROM more) AS inserted, count(*) AS held, sum(content_id)::BIGINT AS contents, count(DISTINCT original) AS originals FROM (SELECT content_id, original FROM first UNION ALL SELECT content_id, original FROM more)"))
def batch_inserted(spark, sf):
    """How many cards of a batch come in, and what the table holds then."""
    store = opened(spark, sf, "content_id % 3 = 0")
    n = store.run(lambda tx: tx.insert_or_ignore("vocabulary", A.vocabulary(spark, sf, levels=False).where("content_id % 3 <> 0"), ["doc_id", "pos", "id"]))
    return store.read("vocabulary").agg(F.lit(n).cast("long").alias("inserted"), F.count("*").alias("held"), F.sum("content_id").alias("contents"), F.countDistinct("original").alias("originals"))


@query(_with("vocabulary", _FIRST.format(""), "SELECT c.id, c.source, (SELECT count(*) FROM first f WHERE f.content_id = c.id) AS cards, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS contents_gone, (SELECT count(*) FROM first WHERE content_id % 5 = 0) AS cards_gone FROM (SELECT doc_id AS id, ['text', 'image', 'link', 'manual'][doc_id % 4 + 1] AS source FROM documents WHERE doc_id % 5 <> 0) c"))
def cascade_committed(spark, sf):
    """Contents that are left after a fifth went with their cards, with their number of cards."""
    store = opened(spark, sf)
    gone = store.run(lambda tx: tx.delete("contents", tx.read("contents").where("id % 5 = 0")))
    cards = store.read("vocabulary").groupBy(F.col("content_id").alias("c")).agg(F.count("*").alias("cards"))
    left = store.read("contents").join(cards, F.col("id") == F.col("c"), "left")
    return left.select("id", F.col("source_type").alias("source"), F.coalesce("cards", F.lit(0)).alias("cards"), F.lit(gone["contents"]).cast("long").alias("contents_gone"), F.lit(gone["vocabulary"]).cast("long").alias("cards_gone"))


@query(_with("vocabulary", _FIRST.format(""), f"SELECT id, CASE WHEN s THEN least(leitner_box + 1, 5) ELSE leitner_box END AS leitner_box, CASE WHEN s THEN {NOW_MS} ELSE last_reviewed END AS last_reviewed, correct_count + s::INTEGER AS correct_count, (SELECT count(*) FROM (SELECT ts::DATE FROM events UNION SELECT DATE '2024-01-30')) AS days FROM (SELECT *, content_id % 4 = 1 AS s FROM first)"))
def review_committed(spark, sf):
    """Cards after right answers to a quarter of them, which lift them by a box and note the day in the same transaction."""
    store = opened(spark, sf)

    def review(tx):
        asked = tx.read("vocabulary").where("content_id % 4 = 1")
        tx.update("vocabulary", asked.select("id", F.least(F.col("leitner_box") + 1, F.lit(5)).alias("leitner_box"), F.lit(NOW_MS).alias("last_reviewed"), (F.col("correct_count") + 1).alias("correct_count")), ["leitner_box", "last_reviewed", "correct_count"])
        tx.insert_or_ignore("review_days", spark.range(1).select(F.to_date(F.timestamp_millis(F.lit(NOW_MS))).alias("day")), ["day"])

    store.run(review)
    days = store.read("review_days").count()
    return store.read("vocabulary").select("id", "leitner_box", "last_reviewed", "correct_count", F.lit(days).cast("long").alias("days"))
