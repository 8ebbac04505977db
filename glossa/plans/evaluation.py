"""Queries of gold lists, evaluation and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.functions import model
from glossa.operators import adapters as A
from glossa.operators import calibrate as C
from glossa.operators import kpi as P
from glossa.operators import predict as R
from glossa.operators.adapters import oracle
from glossa.operators.ranking import letters, tiles
from glossa.plans.base import query
from glossa.sources import goldlists as G
from glossa.sources.readers import rate_columns, scratch, sniffed_csv
from glossa.sources.scratch import stored


def gold(spark, sf):
    """lang, tok, gold 1..6, pred 1..6 (null if the other half of the documents lacks the word), zipf: words of even documents, levels by frequency rank."""
    # Both halves are counted at once and written, for ranks and sums read the counts several times.
    half = lambda r: F.count_if(F.col("doc_id") % 2 == r).alias(f"c{r}")
    n = stored(A.tokens(spark, sf).groupBy("lang", "tok").agg(half(0), half(1)), "counts")
    of = lambda r: n.where(F.col(f"c{r}") > 0).select("lang", "tok", F.col(f"c{r}").alias("c"))
    g = tiles(of(0), ["lang"], [-F.col("c"), letters(F.col("tok"))], [F.desc("c"), F.col("tok")], 6, "gold")
    f = A.with_zipf(of(1)).select("lang", "tok", "zipf")
    eta = model.difficulty(F.col("zipf"), A.aoa(F.col("tok")))
    rank = F.array_position(F.array(*map(F.lit, K.LEVELS)), model.level(eta))
    return g.join(f, ["lang", "tok"], "left").select("lang", "tok", "gold", F.when(F.col("zipf").isNotNull(), rank).alias("pred"), "zipf")


_GOLD = """, g AS (SELECT lang, tok, ntile(6) OVER (PARTITION BY lang ORDER BY c DESC, tok) AS gold FROM (SELECT lang, tok, count(*) AS c FROM tokens WHERE doc_id % 2 = 0 GROUP BY ALL)),
f AS (SELECT lang, tok, round(log10(c / sum(c) OVER (PARTITION BY lang) * 1e9), 3) AS zipf FROM (SELECT lang, tok, count(*) AS c FROM tokens WHERE doc_id % 2 = 1 GROUP BY ALL)),
gold AS (SELECT lang, tok, gold, zipf, CASE WHEN zipf IS NOT NULL THEN CASE WHEN eta < -0.1559 THEN 1 WHEN eta < 0.6753 THEN 2 WHEN eta < 1.5918 THEN 3 WHEN eta < 2.013 THEN 4 WHEN eta < 2.6026 THEN 5 ELSE 6 END END AS pred
 FROM (SELECT g.*, zipf, """ + A._ETA.replace("length(tok)", "length(g.tok)") + """ AS eta FROM g LEFT JOIN f ON g.lang = f.lang AND g.tok = f.tok))
"""


def gold_oracle(body: str) -> str:
    return oracle("tokens", "").rstrip() + _GOLD + body


_FIGURES = "count(*) AS n, avg((pred = gold)::INT) AS exact, avg((abs(pred - gold) <= 1)::INT) AS near, avg(abs(pred - gold)) AS mae"


@query(gold_oracle(f"SELECT lang, {_FIGURES} FROM gold WHERE pred IS NOT NULL GROUP BY lang"))
def accuracy(spark, sf):
    return P.confusion(gold(spark, sf), "gold", "pred", ["lang"])


@query(gold_oracle(f"SELECT lang, gold, {_FIGURES} FROM gold WHERE pred IS NOT NULL GROUP BY lang, gold"))
def per_level_exact(spark, sf):
    return P.confusion(gold(spark, sf), "gold", "pred", ["lang", "gold"])


@query(gold_oracle("SELECT gold, " + ", ".join(f"count(*) FILTER (pred = {i}) AS p{i}" for i in range(1, 7)) + " FROM gold GROUP BY gold"))
def confusion_matrix(spark, sf):
    return gold(spark, sf).groupBy("gold").agg(*(F.count_if(F.col("pred") == i).alias(f"p{i}") for i in range(1, 7)))


@query(gold_oracle("SELECT avg(exact) AS macro_exact, sum(exact * n) / sum(n) AS weighted_exact, stddev_pop(exact) AS spread, min(exact) AS low, max(exact) AS high FROM (SELECT lang, count(*) AS n, avg((pred = gold)::INT) AS exact FROM gold WHERE pred IS NOT NULL GROUP BY lang)"))
def macro_mean(spark, sf):
    a = P.confusion(gold(spark, sf), "gold", "pred", ["lang"])
    x = F.col("exact")
    return a.agg(F.avg(x).alias("macro_exact"), (F.sum(x * F.col("n")) / F.sum("n")).alias("weighted_exact"), F.stddev_pop(x).alias("spread"), F.min(x).alias("low"), F.max(x).alias("high"))


@query(gold_oracle("SELECT lang, tok, gold FROM (SELECT *, row_number() OVER (PARTITION BY lang, gold ORDER BY tok) AS r FROM gold) JOIN (SELECT lang, min(n) AS least FROM (SELECT lang, gold, count(*) AS n FROM gold GROUP BY ALL) GROUP BY lang) USING (lang) WHERE r <= least"))
def balanced_downsample(spark, sf):
    return C.downsampled(gold(spark, sf), "lang", "gold", "tok").select("lang", "tok", "gold")


@query(gold_oracle("SELECT lang, tok, gold, r <= greatest(1, round_even(0.8 * n, 0)) AS train FROM (SELECT *, row_number() OVER (PARTITION BY lang, gold ORDER BY reverse(tok), tok) AS r, count(*) OVER (PARTITION BY lang, gold) AS n FROM gold)"))
def strat_split(spark, sf):
    return C.split(gold(spark, sf), ["lang", "gold"], [F.reverse("tok"), F.col("tok")], [letters(F.reverse("tok"))]).select("lang", "tok", "gold", "train")


@query(gold_oracle("SELECT CASE WHEN p AND l THEN 'both right' WHEN p THEN 'model only' WHEN l THEN 'other only' ELSE 'both wrong' END AS verdict, count(*) AS n FROM (SELECT pred = gold AS p, 1 + (length(tok) + gold) % 6 = gold AS l FROM gold WHERE pred IS NOT NULL) GROUP BY 1"))
def agreement(spark, sf):
    g = gold(spark, sf).where("pred is not null")
    p, other = F.col("pred") == F.col("gold"), 1 + (F.length("tok") + F.col("gold")) % 6 == F.col("gold")
    return g.groupBy(F.when(p & other, "both right").when(p, "model only").when(other, "other only").otherwise("both wrong").alias("verdict")).agg(F.count("*").alias("n"))


@query(gold_oracle("SELECT lang, substr(tok, 1, 2) AS stem, min((gold, tok))[2] AS word, min(gold) AS gold, bool_or(pred IS NULL) AS unseen FROM gold GROUP BY 1, 2"))
def min_sense(spark, sf):
    return gold(spark, sf).groupBy("lang", F.substring("tok", 1, 2).alias("stem")).agg(F.min_by("tok", F.struct("gold", "tok")).alias("word"), F.min("gold").alias("gold"), F.bool_or(F.col("pred").isNull()).alias("unseen"))


#: Rows of lists: a source by the length of the word, flags of missing features, and the level's name.
_LISTED = ", listed AS (SELECT lang, tok, gold, pred, zipf, (zipf IS NULL)::INTEGER AS fb_zipf, (length(tok) % 2 = 1)::INTEGER AS fb_aoa, CASE WHEN length(tok) % 11 = 0 THEN 'LLM-oracle' WHEN lang = 'en' AND length(tok) % 3 = 0 THEN 'Oxford-5000' ELSE 'KELLY-' || lang END AS source, ['A1', 'A2', 'B1', 'B2', 'C1', 'C2'][gold] AS cefr FROM gold)\n"


def listed(spark, sf):
    n, lang = F.length("tok"), F.col("lang")
    source = F.when(n % 11 == 0, "LLM-oracle").when((lang == "en") & (n % 3 == 0), "Oxford-5000").otherwise(F.concat(F.lit("KELLY-"), lang))
    return gold(spark, sf).select("lang", "tok", "gold", "pred", "zipf", F.col("zipf").isNull().cast("int").alias("fb_zipf"), (n % 2 == 1).cast("int").alias("fb_aoa"), source.alias("source"), F.element_at(F.array(*map(F.lit, K.LEVELS)), F.col("gold").cast("int")).alias("cefr"))


def list_oracle(body: str) -> str:
    return gold_oracle("").rstrip() + _LISTED + body


_INFORMED = "(fb_zipf = 0 OR fb_aoa = 0) AND NOT coalesce(cefr = 'C2' AND zipf >= 5.5, false) AND NOT coalesce(cefr = 'C1' AND zipf >= 6.0, false) AND zipf IS NOT NULL"


@query(list_oracle(f"SELECT lang, tok FROM listed WHERE {_INFORMED} AND NOT (source = 'KELLY-en' AND cefr IN ('B2', 'C1', 'C2'))"))
def gold_filters(spark, sf):
    return R.calibration_rows(listed(spark, sf).where("zipf is not null"), ("B2", "C1", "C2")).select("lang", "tok")


@query(list_oracle(f"SELECT lang, tok, source FROM listed WHERE {_INFORMED} AND NOT (source = 'KELLY-en' AND cefr = 'C2') AND source <> 'LLM-oracle'"))
def compare_filters(spark, sf):
    return R.calibration_rows(listed(spark, sf).where("zipf is not null"), ("C2",), oracle=False).select("lang", "tok", "source")


_SPECS = [("English lists", "en", ["KELLY-en", "Oxford-5000"]), ("KELLY-en", "en", ["KELLY-en"]), ("Oxford-5000", "en", ["Oxford-5000"]), ("KELLY-de", "de", ["KELLY-de"]), ("KELLY-fr", "fr", ["KELLY-fr"]), ("all of es", "es", ["KELLY-es", "LLM-oracle"])]
_SPEC_ROWS = "(VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _SPECS) + ") AS t(label, l, sources)"


@query(list_oracle(f", met AS (SELECT label, gold, pred, tok, fb_zipf, fb_aoa, row_number() OVER (PARTITION BY label, gold ORDER BY tok) AS r FROM listed JOIN {_SPEC_ROWS} ON lang = l AND list_contains(sources, source)), m AS (SELECT label, min(n) AS least FROM (SELECT label, gold, count(*) AS n FROM met GROUP BY ALL) GROUP BY label) SELECT label, variant, {_FIGURES} FROM (SELECT met.*, unnest(list_filter(['A', CASE WHEN fb_zipf + fb_aoa < 2 THEN 'B' END, CASE WHEN r <= least THEN 'C' END], lambda x: x IS NOT NULL)) AS variant FROM met JOIN m USING (label)) WHERE pred IS NOT NULL GROUP BY ALL"))
def list_variants(spark, sf):
    specs = spark.createDataFrame(_SPECS, "label string, lang string, sources array<string>")
    return R.list_variants(listed(spark, sf), specs, "tok")


_RAW = "gold - (length(tok) % 3) * 0.25 + CASE WHEN gold = 1 THEN 0.5 ELSE 0.0 END"


@query(list_oracle(f", s AS (SELECT *, raw = floor(raw) AS pristine FROM (SELECT *, ({_RAW})::DOUBLE AS raw FROM listed)), v AS (SELECT *, unnest(list_filter(['A', CASE WHEN raw <> 6 THEN 'B' END, CASE WHEN raw <> 6 AND pristine THEN 'C' END, CASE WHEN raw <> 6 THEN 'D' END], lambda x: x IS NOT NULL)) AS variant FROM s) SELECT variant, count(*) FILTER (ok) AS n, avg((pred = gold)::INT) FILTER (ok) AS exact, avg((abs(pred - gold) <= 1)::INT) FILTER (ok) AS near, avg(abs(pred - gold)) FILTER (ok) AS mae, count(*) FILTER (fb_zipf + fb_aoa = 2) AS double FROM (SELECT *, pred IS NOT NULL AND (variant <> 'D' OR fb_zipf + fb_aoa < 2) AS ok FROM v) GROUP BY variant"))
def sense_variants(spark, sf):
    raw = (F.col("gold") - (F.length("tok") % 3) * 0.25 + F.when(F.col("gold") == 1, 0.5).otherwise(0.0)).cast("double")
    rows = listed(spark, sf).withColumn("raw", raw).withColumn("pristine", F.col("raw") == F.floor("raw"))
    return R.sense_variants(rows)


@query(list_oracle("SELECT who, count(*) AS n, avg((p = gold)::INT) AS exact, avg((abs(p - gold) <= 1)::INT) AS near, avg(abs(p - gold)) AS mae FROM (SELECT gold, unnest(['local', 'remote']) AS who, unnest([pred, CASE WHEN length(tok) % 4 > 0 THEN 1 + (length(tok) + gold) % 6 END]) AS p FROM listed) WHERE p IS NOT NULL GROUP BY who"))
def head_to_head(spark, sf):
    remote = F.when(F.length("tok") % 4 > 0, 1 + (F.length("tok") + F.col("gold")) % 6)
    both = listed(spark, sf).select("gold", F.explode(F.map_from_arrays(F.array(F.lit("local"), F.lit("remote")), F.array(F.col("pred").cast("long"), remote.cast("long")))).alias("who", "pred"))
    return R.figures(both, ["who"])


@query(list_oracle("SELECT sharded, pooled, CASE WHEN sharded - pooled > 0.01 THEN 'sharded' WHEN sharded - pooled < -0.005 THEN 'pooled' ELSE 'equal' END AS verdict FROM (SELECT sum(e * n) / sum(n) AS sharded FROM (SELECT lang, count(*) AS n, avg((pred = gold)::INT) AS e FROM listed WHERE pred IS NOT NULL AND fb_aoa = 0 GROUP BY lang)), (SELECT avg((pred = gold)::INT) AS pooled FROM listed WHERE pred IS NOT NULL)"))
def shard_verdict(spark, sf):
    rows = listed(spark, sf)
    a = R.figures(rows.where("fb_aoa = 0"), ["lang"]).agg((F.sum(F.col("exact") * F.col("n")) / F.sum("n")).alias("sharded"))
    b = R.figures(rows.withColumn("all", F.lit(1)), ["all"]).select(F.col("exact").alias("pooled"))
    return a.join(F.broadcast(b)).withColumn("verdict", R.verdict(F.col("sharded"), F.col("pooled")))


@query(list_oracle(f"SELECT lang, tok, CASE WHEN e < -0.1559 THEN 1 WHEN e < 0.6753 THEN 2 WHEN e < 1.5918 THEN 3 WHEN e < 2.013 THEN 4 WHEN e < 2.6026 THEN 5 ELSE 6 END AS level FROM (SELECT lang, tok, -1.9267 * z + 4.7804 * CASE WHEN fb_zipf = 1 AND fb_aoa = 1 THEN 0.4 WHEN fb_aoa = 0 THEN least(1.0, (least(18.0, 2.0 + length(tok)) - 2) / 16) ELSE 1 - z END AS e FROM (SELECT *, least(1.0, coalesce(zipf, 0) / 7) AS z FROM listed))"))
def stored_predictions(spark, sf):
    z = model.zipf_norm(F.col("zipf"))
    a = F.when(F.col("fb_aoa") == 0, model.clamp01((A.aoa(F.col("tok")) - 2) / 16)).otherwise(1 - z)
    return listed(spark, sf).select("lang", "tok", R.predicted(z, a, F.col("fb_zipf"), F.col("fb_aoa")).cast("long").alias("level"))


@query(list_oracle("SELECT lang, tok, CASE WHEN fb_zipf + fb_aoa < 2 THEN 'known' WHEN tok < 'g' THEN 'B2' WHEN tok < 'p' THEN 'B1' ELSE 'B2' END AS level, fb_zipf + fb_aoa = 2 AND tok >= 'g' AND tok < 'p' AS asked FROM listed"))
def classify_with_answers(spark, sf):
    """Words that no feature tells about take cached levels, then recorded answers, then the model's own."""
    w = listed(spark, sf).select("lang", F.col("tok").alias("word"), "zipf", F.when(F.col("fb_aoa") == 0, A.aoa(F.col("tok"))).alias("aoa"), F.lit(0.0).alias("shift"))
    cache = w.where("word < 'g'").select("lang", "word", F.lit("B2").alias("level"))
    answers = w.select("lang", "word", F.when(F.col("word") < "p", "I should say B1, not B2.").otherwise("It is C22 or so.").alias("answer"))
    got = R.classified(w, cache, answers)
    return got.select("lang", F.col("word").alias("tok"), F.when(F.col("confidence") != "low", "known").otherwise(F.col("level")).alias("level"), "asked")


@query(None)
def balanced_sample(spark, sf):
    return R.balanced_sample(listed(spark, sf).select("lang", F.col("tok").alias("word"), "cefr"), 20, 42)


@query(None)
def picked_pages(spark, sf):
    """Five documents of each language behind the first three, drawn without replacement."""
    return R.picked_entries(A.table(spark, sf, "documents").select("lang", "doc_id"), "doc_id", skip=3, limit=5)


@query(gold_oracle("SELECT word, raw, raw = floor(raw) AS pristine, greatest(1, least(6, floor(raw + 0.5)))::INTEGER AS level FROM (SELECT tok AS word, min(gold + CASE WHEN lang = 'de' AND gold < 6 THEN 0.25 ELSE 0.0 END)::DOUBLE AS raw FROM gold WHERE regexp_matches(tok, '^[a-z][a-z''-]*$') GROUP BY tok)"))
def sense_levels(spark, sf):
    """Words and the levels of their senses, as two tables: each language gives a sense."""
    g = gold(spark, sf)
    words = g.select("tok").distinct().select(F.concat(F.lit("w-"), "tok").alias("word_id"), F.col("tok").alias("word"))
    pos = g.select(F.concat(F.lit("w-"), "tok").alias("word_id"), (F.col("gold") + F.when((F.col("lang") == "de") & (F.col("gold") < 6), 0.25).otherwise(0.0)).cast("string").alias("level"))
    return G.senses(words, pos)


@query(gold_oracle(r"SELECT lang AS language, tok AS word, CASE WHEN length(tok) * 0.1 >= 0.5 THEN 'A1' WHEN gold * 0.2 >= 0.5 THEN 'A2' WHEN length(tok) = 4 THEN 'B2' END AS cefr FROM gold WHERE length(tok) BETWEEN 2 AND 40 AND (length(tok) >= 5 OR gold >= 3 OR length(tok) = 4)"))
def frequency_levels(spark, sf):
    """A table of rates by level, whose columns are told by their names among such of other figures: a word gets the first level at which it is frequent."""
    g, path = gold(spark, sf), scratch(spark, "rates")
    rates = {"level_freq@a1": (F.length("tok") * 0.1).cast("string"), "F@A2": (F.col("gold") * 0.2).cast("string"), "freq_b2": F.when(F.length("tok") == 4, "0.5").otherwise("n/a")}
    others = {n: F.lit("9") for n in ("tf-idf@A1", "D@A1", "freq_A2", "SFI@A2", "U@B2", "total_B2")}
    g.select("lang", F.col("tok").alias("Word"), *(v.alias(n) for n, v in (others | rates).items())).write.option("header", True).option("sep", ";").csv(path)
    table = sniffed_csv(spark, path)
    word, columns = rate_columns(table.columns, K.LEVELS)
    return G.frequency_list(table, word, columns, F.col("lang"), "list").select("language", "word", "cefr")


@query(gold_oracle(", n AS (SELECT *, row_number() OVER (ORDER BY zipf) AS r, count(*) OVER () AS total FROM gold WHERE zipf IS NOT NULL), s AS (SELECT gold, round_even(sum(count(*)) OVER (ORDER BY gold) / max(total) * (max(total) - 1), 0) + 1 AS spot FROM n GROUP BY gold) SELECT s.gold, n.zipf AS cut FROM s JOIN n ON n.r = s.spot"))
def quantile_cuts(spark, sf):
    return C.cut_points(gold(spark, sf).where("zipf is not null").select("gold", "zipf"), "zipf", "gold")


@query(None)
def ordinal_fit(spark, sf):
    f = gold(spark, sf).where("zipf is not null")
    z, a = model.zipf_norm(F.col("zipf")), model.aoa_norm(A.aoa(F.col("tok")), F.col("zipf"))
    return C.fitted(f.select("lang", "gold", z.alias("zipf_norm"), a.alias("aoa_norm")), "lang", ["zipf_norm", "aoa_norm"], "gold")


@query(None)
def family_fit(spark, sf):
    """The same fit for each family of languages, and the spread of its weights over the families."""
    f = gold(spark, sf).where("zipf is not null")
    z, a = model.zipf_norm(F.col("zipf")), model.aoa_norm(A.aoa(F.col("tok")), F.col("zipf"))
    family = F.coalesce(*(F.when(F.col("lang").isin(*langs), name) for name, langs in K.FAMILIES.items()))
    fits = C.fitted(f.select(family.alias("family"), "gold", z.alias("zipf_norm"), a.alias("aoa_norm")).where("family is not null"), "family", ["zipf_norm", "aoa_norm"], "gold")
    spread = fits.groupBy("name").agg(F.avg("value").alias("value"), F.stddev_pop("value").alias("spread"), F.max("value") - F.min("value")).toDF("name", "value", "spread", "range")
    return fits.select("group", "name", "value", F.lit(None).cast("double").alias("spread"), F.lit(None).cast("double").alias("range")).unionAll(spread.select(F.lit("all").alias("group"), "name", "value", "spread", "range"))
