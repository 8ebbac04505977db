"""Extraction in two phases over recorded answers: terms once for a text, translations by batches for each native language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.functions import lex
from glossa.functions import lemma as L

BATCH = 50


def batched(terms: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """terms with batch and at: the request that a term goes into, and its place there."""
    return terms.withColumns({"batch": F.floor(F.col(ordinal) / BATCH).cast("int"), "at": (F.col(ordinal) % BATCH).cast("int")})


def in_order(chunks: DataFrame, group: list[str], chunk: str, items: str) -> DataFrame:
    """group, ordinal, item: the items (arrays) of a group's chunks as one list, in the order of chunks and of items."""
    whole = chunks.groupBy(*group).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(chunk, items))), lambda c: c[items])).alias("_all"))
    return whole.select(*group, F.posexplode("_all").alias("ordinal", "item"))


def translated(terms: DataFrame, answers: DataFrame, group: list[str]) -> DataFrame:
    """terms (group, ordinal, original) with translation from answers (group, batch, at, original, translation), '' without one.

    A batch with as many answers as terms is read by place, and by an answer's own original where that is another; any other
    batch is read by originals. What comes later in the order of batches and places counts."""
    sent = batched(terms.select(*group, "ordinal", "original"))
    n_sent, n_got = sent.groupBy(*group, "batch").agg(F.count("*").alias("_sent")), answers.groupBy(*group, "batch").agg(F.count("*").alias("_got"))
    sizes = n_sent.join(n_got, [*group, "batch"])
    got = answers.select(*group, "batch", "at", F.col("original").alias("_own"), "translation").join(sizes, [*group, "batch"])
    by_place = got.where("_sent = _got").join(sent, [*group, "batch", "at"])
    empty = F.coalesce("translation", F.lit(""))
    own = F.when(F.coalesce("_own", F.lit("")) == "", F.col("original")).otherwise(F.col("_own"))
    entry = lambda key, value, last: F.struct(key.alias("key"), value.alias("value"), F.lit(last).alias("last"))
    placed = by_place.select(*group, "batch", "at", F.explode(F.array(entry(F.col("original"), empty, 0), entry(own, empty, 1))).alias("e"))
    named = got.where("_sent <> _got and _own <> '' and translation is not null").select(*group, "batch", "at", entry(F.col("_own"), F.col("translation"), 0).alias("e"))
    table = placed.unionAll(named).groupBy(*group, F.col("e.key").alias("original")).agg(F.max_by("e.value", F.struct("batch", "at", "e.last")).alias("translation"))
    return terms.join(table, [*group, "original"], "left").withColumn("translation", F.coalesce("translation", F.lit("")))


def object_of(answer: Column, asked: Column) -> Column:
    """original, translation, level, type out of an answer that holds an object: from the first { to the last }, with defaults where it lacks a field or doesn't parse."""
    raw = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "original string, translation string, level string, type string")
    defaults = {"original": asked, "translation": F.lit(""), "level": F.lit("B1"), "type": F.lit("other")}
    return F.struct(*(F.coalesce(raw[k], v).alias(k) for k, v in defaults.items()))


def _map_of(answer: Column) -> Column:
    return F.transform_keys(F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "map<string, string>"), lambda k, v: F.lower(k))


def ratings(answer: Column) -> Column:
    """Word to rating (1 to 20, one digit, half up) of an answer's object; other values are left out."""
    number = lambda v: F.expr("double(null)") if v is None else v.try_cast("double")
    good = F.map_filter(_map_of(answer), lambda k, v: F.coalesce(number(v).between(1, 20), F.lit(False)))
    return F.transform_values(good, lambda k, v: F.floor(number(v) * 10 + 0.5) / 10)


def labels(answer: Column) -> Column:
    """Word to level of an answer's object; other values are left out."""
    good = F.map_filter(_map_of(answer), lambda k, v: L.is_label(lex.trim(v)))
    return F.transform_values(good, lambda k, v: F.upper(lex.trim(v)))


def rated(ratings_of: Column, labels_of: Column) -> Column:
    """Word to (rating, level) of two answers about the same words; a word that one of them lacks has null there."""
    none = lambda kind: F.from_json(F.lit("{}"), f"map<string, {kind}>")
    both = F.coalesce(ratings(ratings_of), none("double")), F.coalesce(labels(labels_of), none("string"))
    return F.map_zip_with(*both, lambda k, r, l: F.struct(r.alias("rating"), l.alias("level")))


def text_key(text: Column, lang: Column) -> Column:
    """The key under which a text's terms are kept."""
    return F.concat(lang, F.lit(":"), djb2(text))


def djb2(text: Column) -> Column:
    """The 32-bit hash 33 h + code of a text's characters, in base 36."""
    code = lambda c: F.ascii(c)
    h = F.aggregate(F.split(text, ""), F.lit(5381).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h * 33 + code(c)) % (1 << 32)))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def two_phase(terms: DataFrame, answers: DataFrame, cards: DataFrame) -> DataFrame:
    """doc_id, native, original, translation, type, level: cleaned terms (doc_id, lang, ordinal, original, type), translated for each native and labelled.

    The terms of a text are the same for every native language. cards: lang, original, level; a term without one gets B1."""
    natives = answers.select("doc_id", "native").distinct()
    each = terms.join(natives, "doc_id")
    out = translated(each, answers, ["doc_id", "native"])
    german = F.when(F.col("native") == "de", lex.capitalise_german(F.col("translation"), F.col("type"))).otherwise(F.col("translation"))
    out = out.withColumn("translation", lex.collapse_identical(german))
    known = cards.groupBy("lang", "original").agg(F.min("level").alias("level"))
    return out.join(known, ["lang", "original"], "left").select("doc_id", "native", "ordinal", "original", "translation", "type", F.coalesce("level", F.lit(K.LEVELS[2])).alias("level"))
