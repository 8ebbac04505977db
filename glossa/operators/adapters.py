"""Views of a learning store, word lists and extraction sweeps over the plain tables documents, events, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.functions import lex, model
from glossa.operators.ranking import with_total

BASE_MS, NOW_MS = 1_704_067_200_000, 1_706_616_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it comes in fewer files than there are cores (a file of one row group is read by one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("text", "image", "link", "manual"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("id"), lex.title(F.col("text")).alias("title"), F.col("text").alias("original_text"), kind.alias("source_type"), (BASE_MS + F.col("doc_id") * 3_600_000).alias("created_at"), "lang")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"))
    return d.select("lang", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), 0)).alias("pos", "w")).select("lang", "doc_id", F.col("pos").cast("long").alias("pos"), F.lower("w").alias("tok"))


def word_parts(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """doc_id, part, w: a document's words in lower case, so many to a part. They are cut where the text is, so nothing is shuffled."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), 0).alias("w"))
    parts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int")))
    p = d.select("doc_id", "w", F.explode_outer(parts).alias("part")).where("part is not null")
    return p.select("doc_id", F.col("part").cast("long").alias("part"), F.transform(F.slice("w", F.col("part") * size + 1, size), F.lower).alias("w"))


def word_counts(toks: DataFrame) -> DataFrame:
    return toks.groupBy("lang", "tok").agg(F.count("*").alias("c"))


def zipf(c: Column, total: Column) -> Column:
    """The logarithm of a word's rate per thousand million, to three digits."""
    return F.round(F.log10(c / total * 1e9), 3)


def zipf_table(toks: DataFrame) -> DataFrame:
    """lang, tok, c, zipf: counts per word and its frequency on the Zipf scale."""
    return with_zipf(word_counts(toks))


def with_zipf(counts: DataFrame) -> DataFrame:
    """zipf_table() of word_counts()."""
    return with_total(counts, "lang", "c", "total").select("lang", "tok", "c", zipf(F.col("c"), F.col("total")).alias("zipf"))


def aoa(tok: Column) -> Column:
    """A stand-in for ages of acquisition: words of even length have one."""
    return F.when(F.length(tok) % 2 == 0, F.least(F.lit(18.0), 2.0 + F.length(tok)))


def features(toks: DataFrame) -> DataFrame:
    f = zipf_table(toks).withColumn("aoa", aoa(F.col("tok")))
    eta = model.difficulty(F.col("zipf"), F.col("aoa"))
    return f.select("*", model.zipf_norm(F.col("zipf")).alias("zipf_norm"), model.aoa_norm(F.col("aoa"), F.col("zipf")).alias("aoa_norm"), eta.alias("eta"), model.level(eta).alias("level"), model.confidence(F.col("zipf"), F.col("aoa")).alias("confidence"))


def vocabulary(spark: SparkSession, sf_dir: str, levels: bool = True) -> DataFrame:
    """One card per language and word, at its first place; without levels, which need the sums of languages, they are null."""
    toks = tokens(spark, sf_dir)
    n, d, p = F.length("tok"), F.col("doc_id"), F.col("pos")
    # A place as one number: least documents first, then least positions (a text has fewer than 2**31 words).
    place = F.shiftleft(d, 31) + p
    agg = toks.groupBy("lang", "tok").agg(F.min(place).alias("at"), F.count("*").alias("c"))
    agg = with_total(agg, "lang", "c", "total", "at") if levels else agg.withColumn("total", F.lit(None).cast("long"))
    kind = F.element_at(F.array(*map(F.lit, ("noun", "verb", "adjective", "phrase", "other"))), (n % 5 + 1).cast("int"))
    at = F.col("at")
    return agg.select("lang", "tok", F.shiftright(at, 31).alias("doc_id"), at.bitwiseAND(F.lit((1 << 31) - 1)).alias("pos"), zipf(F.col("c"), F.col("total")).alias("zipf")).select(
        F.concat("lang", F.lit(":"), "tok").alias("id"), "lang", d.alias("content_id"), F.col("tok").alias("original"), F.reverse("tok").alias("translation"), kind.alias("word_type"),
        (model.level(model.difficulty(F.col("zipf"), aoa(F.col("tok")))) if levels else F.lit(None).cast("string")).alias("level"), (1 + (n + d) % 5).cast("int").alias("leitner_box"),
        F.when(n % 7 != 0, BASE_MS + ((d * 37 + p) % 30) * K.DAY_MS).alias("last_reviewed"), ((d + p) % 6).cast("int").alias("correct_count"), ((d * p) % 4).cast("int").alias("incorrect_count"),
        (BASE_MS + d * 3_600_000).alias("created_at"), F.when((d + p) % 11 == 0, 1).otherwise(0).alias("user_added"), d.alias("doc_id"), p.alias("pos"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("card"), "ts", "event_id", (F.col("event_type") != "error").alias("correct"))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of an extraction: documents by native language other than their own, with the words each run kept."""
    natives = _natives(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return d.join(F.broadcast(natives), F.col("lang") != F.col("native")).select("*", ((F.col("doc_id") + F.col("k")) % 13 != 0).alias("ok"), (F.col("n_chars") + 17 * F.col("k")).alias("elapsed_ms"), F.least("n_chars", F.lit(2000)).alias("processed_len"))


def sweep_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, doc_id, native, processed_len, tok, n: how often a run kept a word.

    Texts are dealt by document once, so words are counted, and what follows is grouped by document, where the text is. A word is
    counted by the remainders of its places, from which each native's count is a sum."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    w = d.select("lang", "doc_id", "n_chars", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), 0)).alias("pos", "w"))
    c = w.groupBy("doc_id", "lang", "n_chars", F.lower("w").alias("tok")).agg(*(F.count_if(F.col("pos") % 3 == r).alias(f"c{r}") for r in range(3)))
    met = c.join(F.broadcast(_natives(spark)), (F.col("lang") != F.col("native")) & ((F.col("doc_id") + F.col("k")) % 13 != 0))
    n = sum((F.when((r + F.col("k")) % 3 != 0, F.col(f"c{r}")).otherwise(0) for r in range(3)), F.lit(0))
    return met.select("lang", "doc_id", "native", F.least("n_chars", F.lit(2000)).alias("processed_len"), "tok", n.cast("long").alias("n")).where("n > 0")


def _natives(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(K.LANGUAGES)], "k int, native string")


def sweep_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, native, tok: the words that any run of a language for a native kept. What decides that is the remainders of places
    and documents, so words meet the natives once for each of these."""
    natives = _natives(spark)
    some = tokens(spark, sf_dir).select("lang", "tok", (F.col("pos") % 3).alias("r"), (F.col("doc_id") % 13).alias("q")).distinct()
    met = some.join(F.broadcast(natives), F.col("lang") != F.col("native")).where((F.col("q") + F.col("k")) % 13 != 0).where((F.col("r") + F.col("k")) % 3 != 0)
    return met.select("lang", "native", "tok").distinct()


#: The same views for the oracle, as common table expressions.
_ETA = "(-1.9267 * least(1.0, greatest(0.0, zipf / 7)) + 4.7804 * (CASE WHEN length(tok) % 2 = 0 THEN least(1.0, greatest(0.0, (least(18.0, 2.0 + length(tok)) - 2) / 16)) ELSE 1 - least(1.0, greatest(0.0, zipf / 7)) END))"
_LEVEL = "CASE WHEN eta < -0.1559 THEN 'A1' WHEN eta < 0.6753 THEN 'A2' WHEN eta < 1.5918 THEN 'B1' WHEN eta < 2.013 THEN 'B2' WHEN eta < 2.6026 THEN 'C1' ELSE 'C2' END"
CTES = {
    "contents": "SELECT doc_id AS id, trim(text[1:50], e' \\t\\n\\r') || CASE WHEN length(text) > 50 THEN '...' ELSE '' END AS title, text AS original_text, ['text', 'image', 'link', 'manual'][doc_id % 4 + 1] AS source_type, 1704067200000 + doc_id * 3600000 AS created_at, lang FROM documents",
    "tokens": r"SELECT lang, doc_id, unnest(range(len(w))) AS pos, lower(unnest(w)) AS tok FROM (SELECT lang, doc_id, regexp_extract_all(text, '[\p{L}]+') AS w FROM documents)",
    "freq": "SELECT lang, tok, c, round(log10(c / sum(c) OVER (PARTITION BY lang) * 1e9), 3) AS zipf FROM (SELECT lang, tok, count(*) AS c FROM tokens GROUP BY 1, 2)",
    "features": f"SELECT *, {_LEVEL} AS level FROM (SELECT *, {_ETA} AS eta FROM freq)",
    "vocabulary": """SELECT f.lang || ':' || f.tok AS id, f.lang, doc_id AS content_id, f.tok AS original, reverse(f.tok) AS translation, ['noun', 'verb', 'adjective', 'phrase', 'other'][length(f.tok) % 5 + 1] AS word_type, level,
 (1 + (length(f.tok) + doc_id) % 5)::INTEGER AS leitner_box, CASE WHEN length(f.tok) % 7 <> 0 THEN 1704067200000 + ((doc_id * 37 + pos) % 30) * 86400000 END AS last_reviewed, ((doc_id + pos) % 6)::INTEGER AS correct_count,
 ((doc_id * pos) % 4)::INTEGER AS incorrect_count, 1704067200000 + doc_id * 3600000 AS created_at, CASE WHEN (doc_id + pos) % 11 = 0 THEN 1 ELSE 0 END AS user_added, doc_id, pos
 FROM features f JOIN (SELECT lang, tok, (min((doc_id, pos)))[1] AS doc_id, (min((doc_id, pos)))[2] AS pos FROM tokens GROUP BY 1, 2) m ON f.lang = m.lang AND f.tok = m.tok""",
    "reviews": "SELECT user_id AS card, ts, event_id, event_type <> 'error' AS correct FROM events",
    "sweep": "SELECT doc_id, lang, n_chars, k, native, (doc_id + k) % 13 <> 0 AS ok, n_chars + 17 * k AS elapsed_ms, least(n_chars, 2000) AS processed_len FROM documents JOIN (SELECT unnest(range(12)) AS k, unnest(['en','de','fr','es','it','pt','nl','sv','no','da','pl','cs']) AS native) ON lang <> native",
    "sweep_words": "SELECT s.*, t.pos, t.tok FROM sweep s JOIN tokens t ON s.doc_id = t.doc_id WHERE ok AND (t.pos + s.k) % 3 <> 0",
}
_NEEDS = {"freq": ("tokens",), "features": ("tokens", "freq"), "vocabulary": ("tokens", "freq", "features"), "sweep_words": ("tokens", "sweep")}


def oracle(views: str, body: str) -> str:
    """body, over the named views."""
    names = dict.fromkeys(n for v in views.split() for n in (*_NEEDS.get(v, ()), v))
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + body
