"""Queries that run streams over all events, held against SQL over the events that the last watermark lets through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.operators import adapters as A
from glossa.plans.base import query
from glossa.sources.readers import scratch
from glossa.sources.tables import Table, TableStore
from glossa.streaming import timed

_DUE = "e AS (SELECT user_id, event_id, event_type, epoch_ms(ts) AS t, max(epoch_ms(ts)) OVER () - 600000 AS w FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e WHERE t <= w)"


def events(spark, sf) -> DataFrame:
    """The events as a stream of the files that are there."""
    at = f"{sf}/events.parque[t]"
    return spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(at).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


_LIMITED = """, r AS (SELECT user_id, event_id, n, [t] AS recent, true AS accepted FROM {0} WHERE n = 1 UNION ALL
SELECT user_id, event_id, n, CASE WHEN len(old) < {1} THEN list_append(old, t) ELSE old END, len(old) < {1} FROM (SELECT d.*, list_filter(r.recent, lambda x: d.t - x <= {2}) AS old FROM r JOIN {0} d ON d.user_id = r.user_id AND d.n = r.n + 1))
SELECT user_id, event_id, accepted FROM r"""


@query("WITH RECURSIVE " + _DUE + _LIMITED.format("d", 2, K.DAY_MS))
def limited_stream(spark, sf):
    """At most two accepted calls of an owner in any day."""
    return timed.drained(timed.limited(events(spark, sf), "user_id", limit=2, span_ms=K.DAY_MS))


@query("WITH a AS (SELECT user_id, event_id, epoch_ms(ts) AS t FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM a)".replace("WITH", "WITH RECURSIVE") + _LIMITED.format("d", K.LIMITER_CALLS, K.LIMITER_MS))
def limiter_sliding(spark, sf):
    """At most 10 accepted calls in any 60 s per user: what was rejected doesn't count."""
    from glossa.streaming.state import sliding_limiter

    return sliding_limiter(A.table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id")


@query("WITH a AS (SELECT user_id, event_id, epoch_ms(ts) AS t FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM a)".replace("WITH", "WITH RECURSIVE") + _LIMITED.format("d", 3, K.DAY_MS))
def limiter_daily(spark, sf):
    """At most three accepted calls in any 24 hours per user, which turns many down."""
    from glossa.streaming.state import sliding_limiter

    return sliding_limiter(A.table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", limit=3, span_ms=K.DAY_MS)


@query(f"WITH {_DUE} SELECT user_id, event_id, CASE WHEN k <= {K.DAILY_QUOTA} THEN k ELSE 0 END AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t // {K.DAY_MS} ORDER BY t, event_id) AS k FROM d)")
def quota_stream(spark, sf):
    return timed.drained(timed.under_quota(events(spark, sf), "user_id"))


@query(f"WITH RECURSIVE {_DUE}, s AS (SELECT user_id, min(t) AS t FROM d GROUP BY 1 UNION ALL SELECT s.user_id, (SELECT min(d.t) FROM d WHERE d.user_id = s.user_id AND d.t > s.t + {5 * K.DAY_MS}) FROM s WHERE s.t IS NOT NULL), f AS (SELECT d.user_id, d.t, min(event_id) AS event_id FROM d JOIN s ON s.user_id = d.user_id AND s.t = d.t GROUP BY 1, 2) SELECT d.user_id, d.event_id, f.event_id IS NULL AS hit FROM d LEFT JOIN f ON f.event_id = d.event_id")
def cache_stream(spark, sf):
    """Hits of a cache whose entries live for five days."""
    return timed.drained(timed.cached(events(spark, sf), "user_id", ttl_ms=5 * K.DAY_MS))


@query(f"WITH {_DUE} SELECT user_id AS card, event_id, least(5, 1 + n - coalesce(max(n) FILTER (event_type = 'error') OVER w, 0))::BIGINT AS box, count(*) FILTER (event_type <> 'error') OVER w AS correct, count(*) FILTER (event_type = 'error') OVER w AS incorrect FROM d WINDOW w AS (PARTITION BY user_id ORDER BY n)")
def review_stream(spark, sf):
    """Each card's state after each review."""
    e = events(spark, sf).select(F.col("user_id").alias("card"), "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return timed.drained(timed.reviewed(e))


@query("SELECT word, event_id, 1::BIGINT AS batches FROM (SELECT user_id || event_type AS word, event_id, row_number() OVER (PARTITION BY user_id || event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_ever_stream(spark, sf):
    """The first event of each word, put into a table by a stream that logs its batches there."""
    store = TableStore(spark, scratch(spark, "words"), {"words": Table("word string, event_id long, ts timestamp", "word"), "batches": timed.BATCHES})
    words = events(spark, sf).select(F.concat(F.col("user_id").cast("string"), "event_type").alias("word"), "event_id", "ts")
    timed.first_ever(words, store, "words", ["ts", "event_id"], scratch(spark, "words"))
    return store.read("words").select("word", "event_id", F.lit(store.read("batches").count()).cast("long").alias("batches"))
