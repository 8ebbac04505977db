"""Queries that write tables in the formats of the sources and sinks and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.operators import adapters as A
from glossa.operators.adapters import oracle
from glossa.plans.base import query
from glossa.sources import goldlists as G
from glossa.sources import jsonarray as J
from glossa.sources import readers as R


def _text(df, path, spark):
    """Writes the one column of df as lines."""
    df.write.text(path)
    return path


@query(oracle("tokens", "SELECT lang, tok, sum(n)::BIGINT AS c FROM (SELECT lang, tok, count(*) AS n FROM tokens GROUP BY 1, 2) WHERE lang = 'fr' GROUP BY 1, 2"))
def corpus_tsv(spark, sf):
    """Counts of words as a corpus list (rank, word, count) with both cases of each word, and some lines that don't fit."""
    n = A.word_counts(A.tokens(spark, sf)).where("lang = 'fr'")
    one = lambda word, count: F.concat_ws("\t", F.lit("1"), word, count.cast("string"))
    title = F.initcap("tok")
    title = F.when(F.lower(title) == F.col("tok"), title).otherwise(F.col("tok"))  # a title that doesn't fold back (of a double s) is another word
    lines = n.select(F.explode(F.array(one(title, F.col("c") - 1), one(F.col("tok"), F.lit(1)), F.lit("no fit"), F.concat_ws("\t", F.lit("2"), "tok", F.lit("many")))).alias("value"))
    return R.corpus_counts(spark, _text(lines, R.scratch(spark, "tsv"), spark), "fr")


_KINDS = "CASE WHEN doc_id % 5 = 0 THEN 'malformed' WHEN doc_id % 5 = 1 THEN 'language' WHEN doc_id % 5 = 2 THEN 'level' END"


def _gold_lines(spark, sf):
    d, m = A.table(spark, sf, "documents"), F.col("doc_id") % 5
    row = F.to_json(F.struct(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("word"), F.when(m == 1, "xx").otherwise(F.col("lang")).alias("language"), F.when(m == 2, "Z9").otherwise("B1").alias("cefr"), F.lit("list").alias("source")))
    path = _text(d.select(F.when(m == 0, F.substring(row, F.lit(1), F.length(row) - 1)).otherwise(row).alias("value")), R.scratch(spark, "jsonl"), spark)
    return R.gold_lines(spark, path, list(K.LANGUAGES), list(K.LEVELS))


@query(f"SELECT 'w' || doc_id AS word, lang AS language, 'B1' AS cefr, 'list' AS source FROM documents WHERE {_KINDS} IS NULL")
def gold_jsonl(spark, sf):
    return _gold_lines(spark, sf)[0]


@query(f"SELECT {_KINDS} AS why, count(*) AS n FROM documents WHERE {_KINDS} IS NOT NULL GROUP BY 1")
def gold_jsonl_skipped(spark, sf):
    return _gold_lines(spark, sf)[1]


@query(oracle("vocabulary", "SELECT id, original, level FROM vocabulary"))
def sniffed_csv(spark, sf):
    """The vocabulary as a file with semicolons, whose separator and columns of words and labels are found again."""
    path = R.scratch(spark, "csv")
    A.vocabulary(spark, sf).select("id", "original", "level").write.option("header", True).option("sep", ";").csv(path)
    table = R.sniffed_csv(spark, path)
    level, word = R.level_columns(table.drop("id"))
    return table.select("id", F.col(word).alias("original"), F.col(level).alias("level"))


def _dumps(spark, sf):
    """Runs of an extraction as dumps, a hundred documents to a file, of three days, seeds and versions."""
    v = A.vocabulary(spark, sf)
    item = F.struct("original", "translation", "level", F.col("word_type").alias("type"), F.array("original", F.reverse("original")).alias("source_forms"))
    n = F.array(*(F.struct(F.lit(k).alias("level"), F.col(k).alias("c")) for k in K.LEVELS))
    words = v.groupBy("content_id").agg(F.collect_list(item).alias("vocab"), *(F.count_if(F.col("level") == k).alias(k) for k in K.LEVELS))
    words = words.select("content_id", "vocab", F.map_from_entries(F.filter(n, lambda x: x["c"] > 0)).alias("levels"))
    runs = A.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(words, F.col("doc_id") == F.col("content_id"))
    each = runs.select((F.col("doc_id") % 3).alias("part"), F.floor(F.col("doc_id") / 300).alias("chunk"), F.struct(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "lang", F.lit("en").alias("native"), (F.col("doc_id") % 4 != 0).alias("ok"), F.col("n_chars").alias("elapsedMs"), F.col("n_chars").alias("textLength"), F.size("vocab").cast("long").alias("vocabCount"), F.col("levels").alias("levelDistribution"), "vocab").alias("r"))
    path, part = R.scratch(spark, "dumps"), F.col("part").cast("string")
    dumps = each.groupBy("part", "chunk").agg(F.collect_list("r").alias("results"), F.sum("r.elapsedMs").cast("double").alias("wall"))
    dumps = dumps.select("part", "chunk", F.concat(F.lit("2026-04-2"), part).alias("ranAt"), F.col("part").alias("seed"), F.concat(F.lit("v"), part).alias("promptVersion"), "results", F.struct(F.col("wall").alias("wallSec")).alias("totals"))
    dumps.write.partitionBy("part", "chunk").json(path)
    return path


@query(oracle("vocabulary", "SELECT 'u' || content_id AS url, v.lang, 'en' AS native, original, translation, level, word_type AS type, original || '|' || reverse(original) AS source_forms FROM vocabulary v"))
def vocab_csv(spark, sf):
    """Entries of merged dumps, written as the flat CSV and read again."""
    path = R.scratch(spark, "vocab")
    R.write_csv(R.vocab_rows(R.merged_dumps(spark, [_dumps(spark, sf) + "/*/*"]).select("url", "lang", "native", "vocab")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query(oracle("vocabulary", "SELECT 'u' || content_id AS url, count(*) FILTER (level = 'A1') AS A1, count(*) FILTER (level = 'A2') AS A2, count(*) FILTER (level = 'B1') AS B1, count(*) FILTER (level = 'B2') AS B2, count(*) FILTER (level = 'C1') AS C1, count(*) FILTER (level = 'C2') AS C2 FROM vocabulary GROUP BY content_id"))
def summary_csv(spark, sf):
    return R.summary_rows(R.merged_dumps(spark, [_dumps(spark, sf) + "/*/*"]), list(K.LEVELS)).select("url", *K.LEVELS)


@query(oracle("vocabulary", "SELECT min('2026-04-2' || doc_id % 3) AS ran_at, count(DISTINCT (doc_id % 3, doc_id // 300)) AS files, count(*) AS runs, count(*) FILTER (doc_id % 4 <> 0) AS ok, sum(n)::BIGINT AS entries, sum(n_chars)::BIGINT AS wall_ms FROM documents JOIN (SELECT content_id, count(*) AS n FROM vocabulary GROUP BY 1) ON content_id = doc_id"))
def merged_totals(spark, sf):
    return R.merged_totals(R.checked_dumps(spark, [_dumps(spark, sf)]))


@query(oracle("vocabulary", "SELECT min('2026-04-2' || doc_id % 3) AS ran_at, min(doc_id % 3) AS seed, 'v' || min(doc_id % 3) AS prompt_version, sum(n_chars)::DOUBLE AS wall_s, count(DISTINCT (doc_id % 3, doc_id // 300)) AS files FROM documents WHERE doc_id IN (SELECT content_id FROM vocabulary)"))
def merged_meta(spark, sf):
    """What the frames of dumps say together; the first file's settings win."""
    frames = J.frames(spark, _dumps(spark, sf) + "/*/*", J.META)
    return J.merged_frame(frames).select("ran_at", "seed", "prompt_version", "wall_s", "files")


@query(oracle("vocabulary", "SELECT field, value, first, count(*) AS files FROM (SELECT DISTINCT doc_id % 3 AS p, doc_id // 300 AS c, (SELECT min(doc_id % 3) FROM documents WHERE doc_id IN (SELECT content_id FROM vocabulary)) AS f FROM documents WHERE doc_id IN (SELECT content_id FROM vocabulary)), (SELECT unnest(['seed', 'promptVersion']) AS field), (SELECT '' AS x), LATERAL (SELECT CASE field WHEN 'seed' THEN p::VARCHAR ELSE 'v' || p END AS value, CASE field WHEN 'seed' THEN f::VARCHAR ELSE 'v' || f END AS first) WHERE p <> f GROUP BY ALL"))
def dump_disagreements(spark, sf):
    """How many files state another seed or version than the first one."""
    said = J.disagreements(J.frames(spark, _dumps(spark, sf) + "/*/*", J.META))
    return said.groupBy("field", "value", "first").agg(F.count("*").alias("files"))


@query(oracle("vocabulary", "SELECT original AS word, 'list' AS source FROM (SELECT DISTINCT original FROM vocabulary WHERE lang = 'en') UNION ALL SELECT original, 'LLM-oracle' FROM vocabulary WHERE lang = 'de'"))
def rebuilt_gold(spark, sf):
    """A list that is built anew keeps the rows that a model gave before."""
    v = A.vocabulary(spark, sf)
    new = v.where("lang = 'en'").select(F.col("original").alias("word")).distinct().withColumn("source", F.lit("list"))
    old = v.where("lang in ('de', 'fr')").select(F.col("original").alias("word"), F.when(F.col("lang") == "de", "LLM-oracle").otherwise("list").alias("source"))
    return R.with_kept_oracle(new, old)


@query(oracle("vocabulary", "SELECT id FROM vocabulary WHERE doc_id % 3 <> 1"))
def resumed(spark, sf):
    """What is left to do after a checkpoint: what a first run did is written as lines, read again and taken out."""
    v, path = A.vocabulary(spark, sf), R.scratch(spark, "done")
    G.write_json(v.where("doc_id % 3 = 1").select("id", "level"), path)
    return R.pending(v.select("id"), spark.read.schema("id string, level string").json(path), ["id"])
