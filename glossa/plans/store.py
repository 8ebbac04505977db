"""Queries of the learning store, its views, reviews and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.functions import lex, model
from glossa.operators import adapters as A
from glossa.operators import store as S
from glossa.operators.adapters import NOW_MS, oracle
from glossa.operators.ranking import running
from glossa.plans.base import query

_DUE = f"(last_reviewed IS NULL OR {NOW_MS} - last_reviewed >= CASE leitner_box WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 8 WHEN 5 THEN 16 ELSE 1 END * 86400000)"
_MIDNIGHT = NOW_MS - NOW_MS % K.DAY_MS
_RANK = "list_position(['A1', 'A2', 'B1', 'B2', 'C1', 'C2'], level)"


@query(oracle("features", "SELECT lang, level, count(*) AS n_words, sum(zipf::DECIMAL(10, 3))::DOUBLE AS sum_zipf FROM features GROUP BY lang, level"))
def cefr_level_histogram(spark, sf):
    return A.features(A.tokens(spark, sf)).groupBy("lang", "level").agg(F.count("*").alias("n_words"), F.sum(F.col("zipf").cast("decimal(10,3)")).cast("double").alias("sum_zipf"))


@query(oracle("contents vocabulary", "SELECT c.id, c.title, c.source_type, c.created_at, coalesce(n, 0) AS vocab_count FROM contents c LEFT JOIN (SELECT content_id, count(*) AS n FROM vocabulary GROUP BY 1) v ON v.content_id = c.id"))
def contents_with_counts(spark, sf):
    out = S.with_counts(A.contents(spark, sf), A.vocabulary(spark, sf), "id", "content_id", "vocab_count")
    return out.select("id", "title", "source_type", "created_at", "vocab_count")


@query(oracle("vocabulary", "SELECT content_id, id, original, level, created_at, row_number() OVER (PARTITION BY content_id ORDER BY created_at, id) AS place FROM vocabulary"))
def vocab_by_content(spark, sf):
    w = Window.partitionBy("content_id").orderBy("created_at", "id")
    return A.vocabulary(spark, sf).select("content_id", "id", "original", "level", "created_at", F.row_number().over(w).cast("long").alias("place"))


@query(oracle("vocabulary", "SELECT id, level, leitner_box, created_at FROM vocabulary ORDER BY created_at DESC, id"))
def vocab_all_desc(spark, sf):
    return A.vocabulary(spark, sf).select("id", "level", "leitner_box", "created_at").orderBy(F.desc("created_at"), "id")


@query("SELECT event_type AS key, max_by(event_id, ts)::VARCHAR AS value FROM (SELECT event_type, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2) GROUP BY 1")
def settings_map(spark, sf):
    e = A.table(spark, sf, "events").groupBy("event_type", "ts").agg(F.max("event_id").alias("event_id"))
    pairs = e.groupBy("event_type").agg(F.max_by("event_id", "ts").cast("string").alias("value"))
    return pairs.select(F.col("event_type").alias("key"), "value")


@query(oracle("vocabulary tokens", "SELECT DISTINCT t.lang, t.tok FROM tokens t WHERE EXISTS (SELECT 1 FROM vocabulary v WHERE v.original = t.tok AND v.lang <> t.lang)"))
def vocab_exists_semi(spark, sf):
    t = A.tokens(spark, sf).select("lang", "tok").distinct()
    v = A.vocabulary(spark, sf).select(F.col("lang").alias("l"), "original")
    return t.join(v, (t.tok == v.original) & (t.lang != v.l), "left_semi")


@query(oracle("vocabulary", "SELECT original, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY original ORDER BY doc_id, pos, id) AS r FROM vocabulary WHERE doc_id % 3 <> 0) WHERE r = 1 AND original NOT IN (SELECT original FROM vocabulary WHERE doc_id % 3 = 0)"))
def insert_ignore_dedup(spark, sf):
    v = A.vocabulary(spark, sf)
    return S.insert_or_ignore(v.where("doc_id % 3 = 0"), v.where("doc_id % 3 <> 0"), "original", ["doc_id", "pos", "id"]).select("original", "id", "created_at")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf):
    e = A.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return S.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query(oracle("vocabulary", "SELECT id, content_id FROM vocabulary WHERE content_id % 5 <> 0"))
def cascade_delete(spark, sf):
    c, v = A.contents(spark, sf), A.vocabulary(spark, sf)
    return S.delete_cascade(c, v, c.where("id % 5 = 0"), "id", "content_id")[1].select("id", "content_id")


@query(oracle("vocabulary", f"SELECT count(*) AS total, floor(100.0 * count(*) FILTER (leitner_box >= 4) / count(*) + 0.5)::BIGINT AS known_pct, count(*) FILTER (last_reviewed >= {_MIDNIGHT}) AS learned_today, count(*) FILTER (last_reviewed >= {_MIDNIGHT - 6 * K.DAY_MS}) AS learned_week, count(*) FILTER ({_DUE}) AS due FROM vocabulary"))
def stats_bundle(spark, sf):
    return S.statistics(A.vocabulary(spark, sf), NOW_MS)


@query(oracle("vocabulary", "SELECT b AS leitner_box, count(id) AS n FROM (SELECT unnest(range(1, 6))::INTEGER AS b) LEFT JOIN vocabulary ON leitner_box = b GROUP BY b"))
def box_counts_zero_filled(spark, sf):
    return S.zero_filled(A.vocabulary(spark, sf), "leitner_box", 1, 5)


@query("SELECT user_id, event_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::INTEGER AS nth FROM events) WHERE nth <= 3")
def quota_gate(spark, sf):
    return S.within_quota(A.table(spark, sf, "events"), "user_id", F.col("ts"), ["ts", "event_id"]).select("user_id", "event_id", "nth")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 120")
def limiter_minute(spark, sf):
    w = Window.partitionBy("user_id", F.date_trunc("minute", "ts")).orderBy("ts", "event_id")
    return A.table(spark, sf, "events").withColumn("r", F.row_number().over(w)).where(F.col("r") <= K.PER_MINUTE).select("user_id", "event_id")


@query(oracle("contents", f"SELECT id, created_at FROM contents WHERE {NOW_MS} - created_at <= {K.FALLBACK_TTL_MS}"))
def cache_ttl(spark, sf):
    return S.not_expired(A.contents(spark, sf), "created_at", NOW_MS).select("id", "created_at")


@query(oracle("vocabulary", f"SELECT id, level FROM vocabulary WHERE user_added = 1 OR {_RANK} >= 4"))
def level_filter(spark, sf):
    return A.vocabulary(spark, sf).where((F.col("user_added") == 1) | lex.at_or_above(F.col("level"), F.lit("B2"))).select("id", "level")


@query(oracle("vocabulary", "SELECT id FROM vocabulary WHERE contains(lower(original), 'tion') OR contains(lower(translation), 'tion')"))
def search_filter(spark, sf):
    return S.searched(A.vocabulary(spark, sf), "TION").select("id")


@query(oracle("vocabulary", f"SELECT id, leitner_box FROM vocabulary WHERE last_reviewed >= {_MIDNIGHT}"))
def learned_today(spark, sf):
    return A.vocabulary(spark, sf).where(F.col("last_reviewed") >= _MIDNIGHT).select("id", "leitner_box")


@query(oracle("vocabulary", f"SELECT id, row_number() OVER (PARTITION BY lang ORDER BY {_RANK} DESC, created_at, id) AS place FROM vocabulary"))
def sort_level(spark, sf):
    v, rank = A.vocabulary(spark, sf), -lex.level_rank(F.col("level"))
    return running(v, ["lang"], [rank, F.floor(F.col("created_at") / K.DAY_MS)], [rank, F.col("created_at"), F.col("id")], "place").select("id", "place")


@query(oracle("vocabulary", f"SELECT id FROM vocabulary WHERE {_DUE}"))
def due_cards(spark, sf):
    return A.vocabulary(spark, sf).where(model.due(F.col("leitner_box"), F.col("last_reviewed"), NOW_MS)).select("id")


@query(oracle("vocabulary", "SELECT id, leitner_box, last_reviewed FROM vocabulary ORDER BY leitner_box, coalesce(last_reviewed, 0), created_at, id LIMIT 20"))
def select_round(spark, sf):
    return S.select_round(A.vocabulary(spark, sf)).select("id", "leitner_box", "last_reviewed")


@query(oracle("reviews", "SELECT card, least(5, 1 + count(*) FILTER (nth > lw))::INTEGER AS box, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS incorrect, max(ts) AS last_ts FROM (SELECT *, coalesce(max(nth) FILTER (NOT correct) OVER (PARTITION BY card), 0) AS lw FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY ts, event_id) AS nth FROM reviews)) GROUP BY card"))
def review_fold(spark, sf):
    return S.review_fold(A.reviews(spark, sf))


_TODAY = "2024-01-15"


@query(oracle("reviews", f"SELECT card, max(n) AS best, coalesce(max(n) FILTER (last = DATE '{_TODAY}'), 0) AS current FROM (SELECT card, isl, count(*) AS n, max(day) AS last FROM (SELECT card, day, day - row_number() OVER (PARTITION BY card ORDER BY day)::INTEGER AS isl FROM (SELECT DISTINCT card, ts::DATE AS day FROM reviews)) GROUP BY 1, 2) GROUP BY card"))
def streaks(spark, sf):
    return S.streaks(A.reviews(spark, sf).withColumn("day", F.to_date("ts")), "card", "day", _TODAY)


@query(oracle("reviews", f"SELECT d::DATE AS day, count(card) AS reviews FROM (SELECT unnest(generate_series(DATE '{_TODAY}' - 9, DATE '{_TODAY}', INTERVAL 1 DAY)) AS d) LEFT JOIN reviews ON ts::DATE = d::DATE GROUP BY 1"))
def last_ten_days(spark, sf):
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(_TODAY).cast("date"), 9), F.lit(_TODAY).cast("date"))).alias("day"))
    n = A.reviews(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("reviews"))
    return F.broadcast(spine).join(n, "day", "left").fillna(0, ["reviews"])


@query(oracle("reviews", "SELECT card, floor(10.0 * count(*) / count(DISTINCT ts::DATE) + 0.5) / 10 AS per_day FROM reviews GROUP BY card"))
def avg_per_day(spark, sf):
    r = A.reviews(spark, sf)
    return r.groupBy("card").agg((F.floor(10.0 * F.count("*") / F.countDistinct(F.to_date("ts")) + 0.5) / 10).alias("per_day"))


@query(oracle("reviews", "SELECT card, ts::DATE AS day FROM reviews WHERE ts >= DATE '2024-01-01' AND ts < DATE '2024-02-01' GROUP BY 1, 2"))
def month_days(spark, sf):
    r = A.reviews(spark, sf).where((F.col("ts") >= F.lit("2024-01-01").cast("timestamp")) & (F.col("ts") < F.lit("2024-02-01").cast("timestamp")))
    return r.select("card", F.to_date("ts").alias("day")).distinct()
