"""Labels with caches and recorded answers, predictions, evaluation variants and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.functions import lemma as L
from glossa.functions import lex, model
from glossa.operators.ranking import letters, running


def classified(words: DataFrame, cache: DataFrame, answers: DataFrame) -> DataFrame:
    """words (lang, word, zipf, aoa, shift) with difficulty, confidence, level and asked.

    A word of low confidence takes its level from the cache (lang, word, level), else from a model's answer (lang, word, answer)
    if that holds a label, else from its own difficulty; asked tells that an answer was used. Other words never look further."""
    eta = model.difficulty(F.col("zipf"), F.col("aoa")) + F.coalesce("shift", F.lit(0.0))
    own = words.withColumns({"difficulty": eta, "confidence": model.confidence(F.col("zipf"), F.col("aoa"))})
    kept = cache.where(F.col("level").isin(*K.LEVELS)).groupBy("lang", "word").agg(F.any_value("level").alias("_cached"))
    said = answers.groupBy("lang", "word").agg(F.any_value(L.first_label(F.col("answer"))).alias("_said"))
    met = own.join(kept, ["lang", "word"], "left").join(said, ["lang", "word"], "left")
    low = F.col("confidence") == "low"
    level = F.when(low, F.coalesce("_cached", "_said", model.level(F.col("difficulty")))).otherwise(model.level(F.col("difficulty")))
    return met.withColumns({"level": level, "asked": low & F.col("_cached").isNull() & F.col("_said").isNotNull()}).drop("_cached", "_said")


def supported(lang: Column) -> Column:
    """lang, or an error for a language without a table."""
    return F.when(lang.isin(*K.LANGUAGES), lang).otherwise(F.raise_error(F.concat(F.lit("unsupported language: "), F.coalesce(lang, F.lit("none")))))


def predicted(zipf_norm: Column, aoa_norm: Column, fb_zipf: Column, fb_aoa: Column) -> Column:
    """1..6 from stored features; without either feature the age counts as 0.4."""
    eta = K.W_ZIPF * zipf_norm + K.W_AOA * F.when((fb_zipf == 1) & (fb_aoa == 1), 0.4).otherwise(aoa_norm)
    return lex.level_rank(model.level(eta))


def figures(rows: DataFrame, group: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """group, n, exact, near, mae over rows that have a prediction."""
    d = F.abs(F.col(pred) - F.col(gold))
    return rows.where(F.col(pred).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.avg((d == 0).cast("int")).alias("exact"), F.avg((d <= 1).cast("int")).alias("near"), F.avg(d).alias("mae"))


def list_variants(rows: DataFrame, specs: DataFrame, order: str) -> DataFrame:
    """Figures of every list of specs (label, lang, sources) in three variants: A all rows, B those with a feature, C as many of each level as the rarest has (the first by order)."""
    s = specs.select("label", F.col("lang").alias("_l"), F.explode("sources").alias("_s"))
    met = rows.join(F.broadcast(s), (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s"))).drop("_l", "_s")
    least = met.groupBy("label", "gold").count().groupBy(F.col("label").alias("_label")).agg(F.min("count").alias("_least"))
    ranked = running(met, ["label", "gold"], [letters(F.col(order))], [F.col(order)], "_r").join(least, F.col("label") == F.col("_label")).drop("_label")
    parts = F.array_compact(F.array(F.lit("A"), F.when(F.col("fb_zipf") + F.col("fb_aoa") < 2, "B"), F.when(F.col("_r") <= F.col("_least"), "C")))
    return figures(ranked.withColumn("variant", F.explode(parts)), ["label", "variant"])


def sense_variants(rows: DataFrame) -> DataFrame:
    """Figures (and double: words without any feature) of a list with raw levels: A all, B without raw 6, C whole raw levels of B, D those of B with a feature."""
    b, both = F.col("raw") != 6.0, F.col("fb_zipf") + F.col("fb_aoa") >= 2
    parts = F.array_compact(F.array(F.lit("A"), F.when(b, "B"), F.when(b & F.col("pristine"), "C"), F.when(b & ~both, "D")))
    each = rows.withColumn("double", both).withColumn("variant", F.explode(parts))
    # D counts the double fallbacks among the rows it drops.
    n = rows.withColumn("double", both).withColumn("variant", F.explode(F.array_compact(F.array(F.lit("A"), F.when(b, "B"), F.when(b & F.col("pristine"), "C"), F.when(b, "D"))))).groupBy("variant").agg(F.count_if("double").alias("double"))
    return figures(each.drop("double"), ["variant"]).join(F.broadcast(n), "variant")


def calibration_rows(rows: DataFrame, dropped: tuple[str, ...], oracle: bool = True) -> DataFrame:
    """Rows (source, cefr, zipf, fb_zipf, fb_aoa) fit to learn from: with a feature, no KELLY-en of the dropped levels, no frequent C1 or C2, and without model labels if oracle is false."""
    good = ((F.col("fb_zipf") == 0) | (F.col("fb_aoa") == 0)) & ~((F.col("source") == "KELLY-en") & F.col("cefr").isin(*dropped)) & ~((F.col("cefr") == "C2") & (F.col("zipf") >= 5.5)) & ~((F.col("cefr") == "C1") & (F.col("zipf") >= 6.0))
    return rows.where(F.coalesce(good, F.lit(False)) & (F.lit(oracle) | (F.col("source") != "LLM-oracle")))


def verdict(sharded: Column, pooled: Column) -> Column:
    """Whether models of their own are worth it: a point better, half a point worse, or neither."""
    d = sharded - pooled
    return F.when(d > 0.01, "sharded").when(d < -0.005, "pooled").otherwise("equal")


def _shuffled(seed: int, *key: str) -> list[Column]:
    """An order that looks random and is the same in every run of a seed."""
    return [F.xxhash64(F.lit(seed), *key), *(F.col(k) for k in key)]


def balanced_sample(rows: DataFrame, n: int, seed: int, word: str = "word") -> DataFrame:
    """n different words of each language and level of the ladder; a word goes to the lowest level it has."""
    one = rows.where(F.col("cefr").isin(*K.LEVELS)).groupBy("lang", word).agg(F.min("cefr").alias("cefr"))
    w = Window.partitionBy("lang", "cefr").orderBy(*_shuffled(seed, word))
    return one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def picked_entries(corpus: DataFrame, order: str, index: int | None = None, skip: int = 0, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Entries (lang, ...) of each language with their index by order (a text or a number): the one asked for; else those behind skip, limit of them drawn without replacement if a limit is given."""
    block = letters(F.col(order)) if corpus.schema[order].dataType.typeName() == "string" else F.floor(F.col(order) / 1000)
    rows = running(corpus, ["lang"], [block], [F.col(order)], "index").withColumn("index", F.col("index") - 1)
    if index is not None:
        return rows.where(F.col("index") == index)
    rows = rows.where(F.col("index") >= skip)
    if limit is None:
        return rows
    # The first ones of each block of entries, of which a language has few, then the first ones of these.
    shuffled = _shuffled(seed, "lang", "index")
    blocks, whole = Window.partitionBy("lang", F.floor(F.col("index") / 100_000)), Window.partitionBy("lang")
    some = rows.withColumn("_r", F.row_number().over(blocks.orderBy(*shuffled))).where(F.col("_r") <= limit)
    return some.withColumn("_r", F.row_number().over(whole.orderBy(*shuffled))).where(F.col("_r") <= limit).drop("_r")
