"""From extraction answers to vocabulary rows: parsing, repair, filters and deduplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions import lex

ITEMS = "array<struct<original: string, translation: string, level: string, type: string, source_forms: array<string>>>"


def filter_chain(items: DataFrame, learning: Column, native: Column, order: list[str], group: str, kind: str = "word_type") -> DataFrame:
    """Drops malformed entries, abbreviations, proper nouns, leaked phrases and inflected verbs, collapses pairs, keeps the
    first of equal entries of a group, and capitalises German translations; the order of the steps matters."""
    t = F.col(kind)
    rows = items.withColumns({"_l": learning, "_n": native}).where("original is not null and original <> ''")
    rows = rows.withColumns({c: lex.apostrophes(F.col(c)) for c in ("original", "translation")})
    o = F.col("original")
    rows = rows.where(~lex.is_abbreviation(o)).where(~lex.is_proper_noun(o, F.col("_l"))).where(~lex.is_multi_word_noun(o, t)).where(~lex.is_not_infinitive(o, t, F.col("_l")))
    rows = rows.withColumns({"original": lex.collapse_identical(lex.collapse_adjective(o, t, F.col("_l"))), "translation": lex.collapse_identical(F.col("translation"))})
    first = Window.partitionBy(group, F.lower(lex.trim(o)), t).orderBy(*order)
    rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return rows.withColumn("translation", F.when(F.col("_n") == "de", lex.capitalise_german(F.col("translation"), t)).otherwise(F.col("translation"))).drop("_l", "_n", "_r")


@F.pandas_udf(T.StringType())
def repaired(answers: pd.Series) -> pd.Series:
    """The JSON array of an answer: from its first [ to the last ], or, if that doesn't close, to the last complete object."""

    def one(s: str | None) -> str | None:
        if s is None or (a := s.find("[")) < 0:
            return None
        depth, text, skip, last, end = 0, False, False, None, None
        for i, c in enumerate(s[a:], a):
            if skip:
                skip = False
            elif c == "\\":
                skip = text
            elif c == '"':
                text = not text
            elif not text and c in "[{":
                depth += 1
            elif not text and c in "]}":
                depth -= 1
                if depth == 1 and c == "}":
                    last = i
                if depth == 0:
                    end = i
                    break
        return s[a : end + 1] if end is not None else f"{s[a : last + 1]}]" if last is not None else "[]"

    return answers.map(one)


def parsed(answers: DataFrame, column: str = "answer") -> DataFrame:
    """One row per extracted item with its ordinal; missing fields get their defaults; only answers that don't parse are repaired."""
    sliced = F.regexp_extract(column, r"(?s)(\[.*\])", 1)
    rows = answers.withColumn("_quick", F.from_json(sliced, ITEMS))
    rows = rows.withColumn("_items", F.coalesce("_quick", F.from_json(repaired(F.when(F.col("_quick").isNull(), F.col(column))), ITEMS)))
    # An inner posexplode would have its items made a second time, to filter by their size.
    rows = rows.select(*answers.columns, F.posexplode_outer("_items").alias("ordinal", "i")).where("ordinal is not null")
    fields = {"original": "", "translation": "", "level": "", "type": "other"}
    return rows.select(*answers.columns, "ordinal", *(F.coalesce(F.col(f"i.{k}"), F.lit(v)).alias(k) for k, v in fields.items()), F.coalesce("i.source_forms", F.array().cast("array<string>")).alias("source_forms"))


def runs(items: DataFrame, group: str, order: str, key: Column, least: int = 3) -> DataFrame:
    """group, key, start, n: runs of at least so many equal keys in order."""
    w = Window.partitionBy(group).orderBy(order)
    rows = items.withColumn("_k", key).withColumn("_new", (~F.lag("_k").over(w).eqNullSafe(F.col("_k"))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(group, "_run", "_k").agg(F.min(order).alias("start"), F.count("*").alias("n")).where(F.col("n") >= least).select(group, F.col("_k").alias("key"), "start", "n")
