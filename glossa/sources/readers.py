"""Sources and sinks: word lists, gold lists, run dumps, reports; each with an explicit schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.sources import jsonarray
from glossa.sources.scratch import scratch as scratch

DUMP = "ranAt string, results array<struct<url string, lang string, native string, ok boolean, error string, elapsedMs long, textLength long, processedTextLength long, vocabCount long, levelDistribution map<string, long>, vocab array<struct<original string, translation string, level string, type string, source_forms array<string>>>>>"
#: Names of columns of words, and parts of names of columns that hold other figures than rates.
WORD_NAMES, EXCLUDED = "lemma|word|form|wordform", r"tf[-_]?idf|^d@|^sfi@|^u@|nb_doc|total"
GOLD = "word string, language string, cefr string, source string"


def corpus_counts(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """lang, tok, c of a tab-separated list rank, word, count; lines that don't fit are dropped, cases folded and summed."""
    rows = spark.read.schema("rank string, word string, count string").option("sep", "\t").option("quote", "").csv(path)
    rows = rows.select(F.lower("word").alias("tok"), F.expr("try_cast(count as bigint)").alias("c")).where("tok is not null and c is not null")
    return rows.groupBy("tok").agg(F.sum("c").alias("c")).select(F.lit(lang).alias("lang"), "tok", "c")


def gold_lines(spark: SparkSession, path: str, languages: list[str], levels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(usable rows, counts of what was skipped and why) of a JSON-lines gold list."""
    rows = spark.read.schema(GOLD + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    why = F.when(F.col("_bad").isNotNull(), "malformed").when(~F.coalesce(F.col("language").isin(languages), F.lit(False)), "language").when(~F.coalesce(F.col("cefr").isin(levels), F.lit(False)), "level")
    rows = rows.withColumn("why", why)
    return rows.where("why is null").drop("_bad", "why"), rows.where("why is not null").groupBy("why").agg(F.count("*").alias("n"))


def sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header whose separator is the first of tab, semicolon and comma that the header holds."""
    head = spark.read.text(path).first()
    sep = next((s for s in "\t;," if head and s in head[0]), ",")
    return spark.read.option("header", True).option("sep", sep).csv(path)


def level_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """(column of CEFR labels, column of lemmas) of a table, judged on all its rows: share of labels over a half; share of words over 0.7, at least half of them
    distinct (by a sketch, so that one pass with few bytes a column does). Columns with names of figures (EXCLUDED) are neither."""
    label, word = r"^\s*[ABC][12]\s*$", r"^\s*\p{L}[\p{L} '’-]{0,39}\s*$"
    names = [c for c in df.columns if not re.search(EXCLUDED, c.strip(), re.IGNORECASE)]
    share = lambda c, p: F.avg(F.coalesce(F.col(f"`{c}`").cast("string").rlike(p), F.lit(False)).cast("int"))
    aggs = [a for c in names for a in (share(c, label), share(c, word), F.approx_count_distinct(f"`{c}`", 0.02) / F.count("*"))]
    figures = df.agg(*aggs).first() if aggs else []
    by = {c: figures[3 * i : 3 * i + 3] for i, c in enumerate(names)}
    level = next((c for c, (a, _, _) in by.items() if (a or 0) > 0.5), None)
    return level, next((c for c, (_, b, d) in by.items() if c != level and (b or 0) > 0.7 and (d or 0) >= 0.5), None)


def rate_columns(columns: list[str], levels: tuple[str, ...]) -> tuple[str, dict[str, str]]:
    """(column of words, {level: column of its rates}) of a table of rates by level, by the columns' names: a name that holds the level as a word of its own,
    F@level before any with freq before others, and none with a name of other figures (EXCLUDED). Without either it is an error."""
    plain = {c: c.strip().strip('"').lower() for c in columns}
    word = next((c for c, name in plain.items() if re.fullmatch(WORD_NAMES, name)), None)
    if word is None:
        raise ValueError(f"no column of words among {columns}")
    rates = {}
    for level in levels:
        held = [c for c, name in plain.items() if c != word and not re.search(EXCLUDED, name) and re.search(rf"(^|[@_\s]){level.lower()}([@_\s]|$)", name)]
        if held:
            rates[level] = min(held, key=lambda c: (plain[c] != f"f@{level.lower()}", "freq" not in plain[c]))
    if not rates:
        raise ValueError(f"no columns of rates among {columns}")
    return word, rates


def merged_dumps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per result of several run dumps, with the file it came from and its ranAt. Files are cut into results by many tasks, however large they are."""
    result = DUMP[len("ranAt string, results array<struct<") : -len(">>")]
    records = jsonarray.records(spark, paths)
    found = jsonarray.parsed(records, result)
    ran = jsonarray.framed(records, "ranAt string").select(F.col("file").alias("_file"), "r.ranAt")
    return found.join(ran, F.col("file") == F.col("_file"), "left").select("ranAt", "file", "r.*")


def checked_dumps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The dumps as they are (ranAt, results, file); one without a list of results is an error that names its file."""
    rows = spark.read.schema(DUMP).option("multiLine", True).json(paths).withColumn("file", F.input_file_name())
    return rows.withColumn("results", F.when(F.col("results").isNotNull(), F.col("results")).otherwise(F.raise_error(F.concat("file", F.lit(" has no results")))))


def merged_totals(dumps: DataFrame) -> DataFrame:
    """One row for several dumps: the first ranAt, the numbers of files, runs, good runs and entries, and the summed times."""
    r = dumps.select("ranAt", F.size("results").alias("runs"), *(F.aggregate("results", F.lit(0).cast("long"), f).alias(n) for n, f in (("ok", lambda a, x: a + F.coalesce(x["ok"], F.lit(False)).cast("long")), ("entries", lambda a, x: a + F.coalesce(x["vocabCount"], F.lit(0)).cast("long")), ("wall_ms", lambda a, x: a + F.coalesce(x["elapsedMs"], F.lit(0)).cast("long")))))
    return r.agg(F.min("ranAt").alias("ran_at"), F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("runs", "ok", "entries", "wall_ms")))


def vocab_rows(results: DataFrame) -> DataFrame:
    """One flat row per item of the results, forms joined by bars, ready for a CSV."""
    return results.select("url", "lang", "native", F.explode("vocab").alias("v")).select("url", "lang", "native", "v.original", "v.translation", "v.level", "v.type", F.array_join("v.source_forms", "|").alias("source_forms"))


def summary_rows(results: DataFrame, levels: list[str]) -> DataFrame:
    """One row per result with a column per level: the ladder first, then other keys that occur, by name. These become columns, so they must be few."""
    keys = [r[0] for r in results.select(F.explode(F.map_keys("levelDistribution")).alias("k")).distinct().collect()]
    order = [*levels, *sorted(set(keys) - set(levels))]
    return results.select("url", "lang", "native", "ok", *(F.coalesce(F.try_element_at("levelDistribution", F.lit(k)), F.lit(0)).alias(k) for k in order))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)


def with_kept_oracle(new: DataFrame, old: DataFrame, source: str = "LLM-oracle") -> DataFrame:
    """A rebuilt gold list that keeps the old rows of one source."""
    return new.unionByName(old.where(F.col("source") == source))


def pending(candidates: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed job still has to do."""
    return candidates.join(done.select(*keys), keys, "left_anti")
