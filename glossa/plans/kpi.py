"""Queries of extraction quality figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.operators import adapters as A
from glossa.operators import kpi as P
from glossa.operators.adapters import oracle
from glossa.operators.ranking import letters, running, with_total
from glossa.plans.base import query


@query(oracle("sweep_words", "SELECT lang, avg((most >= 10)::INT) AS loop10, avg((most >= 3)::INT) AS loop3 FROM (SELECT doc_id, native, lang, max(n) AS most FROM (SELECT doc_id, native, lang, tok, count(*) AS n FROM sweep_words GROUP BY ALL) GROUP BY ALL) GROUP BY lang"))
def loop_rate(spark, sf):
    r = P.repetition(A.sweep_words(spark, sf), ["doc_id", "native", "lang"])
    return r.groupBy("lang").agg(F.avg((F.col("most") >= 10).cast("int")).alias("loop10"), F.avg((F.col("most") >= 3).cast("int")).alias("loop3"))


@query(oracle("sweep_words", "SELECT doc_id, native, 1 - count(DISTINCT tok) / count(*) AS dup_ratio FROM sweep_words GROUP BY ALL"))
def dupe_rate(spark, sf):
    return P.repetition(A.sweep_words(spark, sf), ["doc_id", "native"]).select("doc_id", "native", "dup_ratio")


@query(oracle("sweep_words", "SELECT lang, avg(dup) AS dup_ratio FROM (SELECT lang, doc_id, native, 1 - count(DISTINCT tok) / count(*) AS dup FROM sweep_words GROUP BY ALL) GROUP BY lang"))
def dupe_mean(spark, sf):
    return P.repetition(A.sweep_words(spark, sf), ["lang", "doc_id", "native"]).groupBy("lang").agg(F.avg("dup_ratio").alias("dup_ratio"))


_PAIRS = """, d AS (SELECT DISTINCT lang, native, tok FROM sweep_words), n AS (SELECT lang, native, count(*) AS n FROM d GROUP BY ALL),
j AS (SELECT x.lang, x.native AS a, y.native AS b, count(*) AS i FROM d x JOIN d y ON x.lang = y.lang AND x.tok = y.tok AND x.native < y.native GROUP BY ALL),
pairs AS (SELECT j.lang, a, b, i / (na.n + nb.n - i) AS jaccard FROM j JOIN n na ON na.lang = j.lang AND na.native = a JOIN n nb ON nb.lang = j.lang AND nb.native = b)
"""


@query(oracle("sweep_words", "").rstrip() + _PAIRS + "SELECT lang, a, b, jaccard FROM pairs")
def jaccard_pairs(spark, sf):
    return P.pair_overlap(A.sweep_vocabulary(spark, sf), "lang", "native", "tok")


@query(oracle("sweep_words", "").rstrip() + _PAIRS + "SELECT lang, jaccard AS median FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY jaccard) AS r, count(*) OVER (PARTITION BY lang) AS n FROM pairs) WHERE r = floor(n * 0.5) + 1")
def jaccard_median(spark, sf):
    return P.picked(P.pair_overlap(A.sweep_vocabulary(spark, sf), "lang", "native", "tok"), "lang", "jaccard", 0.5, "median")


@query(oracle("sweep_words", "").rstrip() + _PAIRS + "SELECT count(*) AS langs, avg(jaccard) AS mean_median FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY jaccard) AS r, count(*) OVER (PARTITION BY lang) AS n FROM pairs) WHERE r = floor(n * 0.5) + 1")
def jaccard_mean_median(spark, sf):
    medians = P.picked(P.pair_overlap(A.sweep_vocabulary(spark, sf), "lang", "native", "tok"), "lang", "jaccard", 0.5, "median")
    return medians.agg(F.count("*").alias("langs"), F.avg("median").alias("mean_median"))


@query(oracle("sweep_words", "SELECT lang, count(*) FILTER (n = cells) AS core, count(*) AS every, count(*) FILTER (n = cells) / count(*) AS stability FROM (SELECT lang, tok, count(DISTINCT native) AS n FROM sweep_words GROUP BY ALL) JOIN (SELECT lang, count(DISTINCT native) AS cells FROM sweep_words GROUP BY lang) USING (lang) GROUP BY lang"))
def core_stability(spark, sf):
    return P.core_stability(A.sweep_vocabulary(spark, sf), "lang", "native", "tok")


@query(oracle("sweep", "SELECT native, elapsed_ms AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY native ORDER BY elapsed_ms) AS r, count(*) OVER (PARTITION BY native) AS n FROM sweep) WHERE r = floor(n * 0.95) + 1"))
def p95_latency(spark, sf):
    return P.picked(A.sweep(spark, sf), "native", "elapsed_ms", 0.95, "p95", F.floor(F.col("elapsed_ms") / 1000))


@query(oracle("sweep_words", "SELECT lang, sum(c) * 0.3 * 0.10 / 1e6 + sum(items) * 40 * 0.30 / 1e6 AS cost, 100 * (sum(c) * 0.3 * 0.10 / 1e6 + sum(items) * 40 * 0.30 / 1e6) / sum(u) AS per_100 FROM (SELECT lang, doc_id, native, max(processed_len) AS c, count(*) AS items, count(DISTINCT tok) AS u FROM sweep_words GROUP BY ALL) GROUP BY lang"))
def cost_proxy(spark, sf):
    cells = A.sweep_words(spark, sf).groupBy("lang", "doc_id", "native").agg(F.max("processed_len").alias("c"), F.sum("n").alias("items"), F.count("*").alias("u"))
    cost = F.sum("c") * 0.3 * 0.10 / 1e6 + F.sum("items") * 40 * 0.30 / 1e6
    return cells.groupBy("lang").agg(cost.alias("cost"), (100 * cost / F.sum("u")).alias("per_100"))


@query(oracle("sweep", "SELECT native, count(*) AS runs, count(*) FILTER (ok) AS ok_runs, sum(elapsed_ms)::BIGINT AS wall_ms FROM sweep GROUP BY native"))
def dump_totals(spark, sf):
    return A.sweep(spark, sf).groupBy("native").agg(F.count("*").alias("runs"), F.count_if("ok").alias("ok_runs"), F.sum("elapsed_ms").alias("wall_ms"))


@query(oracle("vocabulary", "SELECT lang, count(*) FILTER (level = 'A1') AS A1, count(*) FILTER (level = 'A2') AS A2, count(*) FILTER (level = 'B1') AS B1, count(*) FILTER (level = 'B2') AS B2, count(*) FILTER (level = 'C1') AS C1, count(*) FILTER (level = 'C2') AS C2 FROM vocabulary GROUP BY lang"))
def per_lang_pivot(spark, sf):
    return A.vocabulary(spark, sf).groupBy("lang").agg(*(F.count_if(F.col("level") == x).alias(x) for x in K.LEVELS))


@query(oracle("vocabulary", "SELECT content_id, level || '.' || word_type AS key, count(*) AS n FROM vocabulary GROUP BY ALL"))
def level_histogram_map(spark, sf):
    n = A.vocabulary(spark, sf).groupBy("content_id", "level", "word_type").agg(F.count("*").alias("n"))
    whole = n.groupBy("content_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("level", F.lit("."), "word_type"), "n"))).alias("m"))
    return whole.select("content_id", F.explode("m").alias("key", "n"))


@query(oracle("vocabulary", "SELECT DISTINCT word_type || '.' || level AS key FROM vocabulary"))
def dynamic_keys(spark, sf):
    m = A.vocabulary(spark, sf).groupBy("content_id").agg(F.collect_set(F.concat("word_type", F.lit("."), "level")).alias("keys"))
    return m.select(F.explode("keys").alias("key")).distinct()


@query(oracle("vocabulary", "SELECT lang, level, id, nth FROM (SELECT *, row_number() OVER (PARTITION BY lang, level ORDER BY doc_id, pos, id)::INTEGER AS nth FROM vocabulary) WHERE nth <= 15"))
def capped_samples(spark, sf):
    return P.capped(A.vocabulary(spark, sf), ["lang", "level"], ["doc_id", "pos", "id"], 15).select("lang", "level", "id", "nth")


@query(oracle("sweep_words", "SELECT lang, count(*) FILTER (most >= 3) AS h13 FROM (SELECT lang, doc_id, native, max(n) AS most FROM (SELECT lang, doc_id, native, tok, count(*) AS n FROM sweep_words GROUP BY ALL) GROUP BY ALL) GROUP BY lang"))
def h13_repeats(spark, sf):
    """Runs in which an entry comes three times or more."""
    return P.repetition(A.sweep_words(spark, sf), ["lang", "doc_id", "native"]).groupBy("lang").agg(F.count_if(F.col("most") >= 3).alias("h13"))


@query(oracle("vocabulary", "SELECT key, a, b, b - a AS delta, CASE WHEN a <> 0 THEN 100 * (b - a) / a END AS pct, CASE WHEN b - a IS NULL THEN 'missing' WHEN b = a THEN 'same' WHEN (key = 'C2') = (b < a) THEN 'better' ELSE 'worse' END AS verdict FROM (SELECT level AS key, count(*) AS a FROM vocabulary WHERE doc_id % 2 = 0 GROUP BY 1) FULL JOIN (SELECT level AS key, count(*) AS b FROM vocabulary WHERE doc_id % 2 = 1 GROUP BY 1) USING (key)"))
def kpi_diff(spark, sf):
    v = A.vocabulary(spark, sf)
    a, b = (v.where(f"doc_id % 2 = {i}").groupBy(F.col("level").alias("key")).agg(F.count("*").alias("n")) for i in (0, 1))
    return P.diff(a, b, "key", "n", F.col("key") == "C2")


@query(oracle("tokens", "SELECT doc_id, key, start, n FROM (SELECT doc_id, tok AS key, run, min(pos) AS start, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, tok ORDER BY pos) AS run FROM tokens) GROUP BY ALL) WHERE n >= 3"))
def run_detector(spark, sf):
    from glossa.operators.extract import runs

    return runs(A.tokens(spark, sf), "doc_id", "pos", F.col("tok"))


@query(oracle("tokens", "SELECT lang, tok, sum(c) OVER (PARTITION BY lang ORDER BY tok ROWS UNBOUNDED PRECEDING)::BIGINT AS running, sum(c) OVER (PARTITION BY lang ORDER BY tok ROWS UNBOUNDED PRECEDING) / sum(c) OVER (PARTITION BY lang) AS share FROM (SELECT lang, tok, count(*) AS c FROM tokens GROUP BY ALL)"))
def cumulative_counts(spark, sf):
    c = with_total(A.tokens(spark, sf).groupBy("lang", "tok").agg(F.count("*").alias("c")), "lang", "c", "total")
    summed = running(c, ["lang"], [letters(F.col("tok"))], [F.col("tok")], "running", "c")
    return summed.select("lang", "tok", "running", (F.col("running") / F.col("total")).alias("share"))
