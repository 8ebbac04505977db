"""Queries of the checks on extracted entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import checks as C
from glossa.plans.base import query
from glossa.plans.lexical import _entries, entry_oracle


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _case(on: str, what: str, table: dict[str, str], rest: str) -> str:
    return f"CASE {on} " + " ".join(f"WHEN '{k}' THEN regexp_matches({what}, '{_quoted(p)}', 'i')" for k, p in table.items()) + f" ELSE {rest} END"


_LOW = r"lower(regexp_replace(original, '^\s+|\s+$', '', 'g'))"
_NATIVE = "['en','de','fr','es','it','pt','nl','sv','no','da','pl','cs'][pos % 12 + 1]"
_SHAPED = "CASE pos % 4 WHEN 0 THEN 'ein ' WHEN 1 THEN 'a ' WHEN 2 THEN 'der Große ' ELSE '' END || upper(translation[1]) || translation[2:]"


def _checked(spark, sf):
    natives = F.array(*map(F.lit, ("en", "de", "fr", "es", "it", "pt", "nl", "sv", "no", "da", "pl", "cs")))
    lead = F.element_at(F.array(*map(F.lit, ("ein ", "a ", "der Große ", ""))), (F.col("pos") % 4 + 1).cast("int"))
    tail = F.replace("translation", F.lit("ß"), F.lit("ss"))
    shaped = F.concat(lead, F.upper(F.substring(tail, 1, 1)), F.substring(tail, 2, 1000))
    return _entries(spark, sf).withColumns({"native": F.element_at(natives, (F.col("pos") % 12 + 1).cast("int")), "shaped": shaped})


_SHAPED = _SHAPED.replace("translation", "replace(translation, 'ß', 'ss')")


@query(entry_oracle(f"SELECT id, {_case('lang', _LOW, C.ARTICLE, 'false')} AS has FROM entries"))
def has_article(spark, sf):
    return _checked(spark, sf).select("id", C.has_article(F.col("lang"), F.col("original")).alias("has"))


@query(entry_oracle(f"SELECT lang, count(*) AS verbs, avg(({_case('lang', _LOW, C.INFINITIVE, 'true')})::INT) AS share FROM entries WHERE word_type = 'verb' GROUP BY lang"))
def infinitive_share(spark, sf):
    v = _checked(spark, sf).where("word_type = 'verb'")
    return v.groupBy("lang").agg(F.count("*").alias("verbs"), F.avg(C.is_infinitive(F.col("lang"), F.col("original")).cast("int")).alias("share"))


@query(entry_oracle(r"SELECT id FROM entries WHERE regexp_matches(trim(original), '^\S+\s\S+\s\S+')"))
def three_words(spark, sf):
    return _checked(spark, sf).where(C.three_words(F.col("original"))).select("id")


_WORDS = rf"list_filter(regexp_split_to_array(regexp_replace(trim(original), '{_quoted(C.LEAK_ARTICLE)}', '', 'i'), '\s+'), lambda w: w <> '')"


@query(entry_oracle(rf"SELECT id, CASE WHEN lang = 'de' THEN len(w) >= 2 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-ZÄÖÜ]{{2,}}$'))) = 0 WHEN len(w) < 2 THEN len(w) = 1 AND regexp_matches(w[1], '^[A-Z]{{3,}}$') ELSE len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-ZÁÀÂÄÉÈÊËÍÎÏÓÔÖÚÛÜÇÑ]'))) = 0 END AS leak FROM (SELECT id, lang, {_WORDS} AS w FROM entries)"))
def proper_noun_leak(spark, sf):
    return _checked(spark, sf).select("id", C.proper_noun_leak(F.col("lang"), F.col("original")).alias("leak"))


@query(entry_oracle(rf"SELECT id FROM entries WHERE regexp_matches({_SHAPED}, '^(?i:der|die|das)\s+[A-ZÄÖÜ]\S*\s+[A-ZÄÖÜ]\S*(\s|$)')"))
def german_case_error(spark, sf):
    return _checked(spark, sf).where(C.german_case_error(F.col("shaped"))).select("id")


@query(entry_oracle(f"SELECT native, count(*) AS n, avg((CASE WHEN native IN ('pl', 'cs') THEN NOT regexp_matches(s, '{_quoted(C.ANY_ARTICLE)}', 'i') ELSE {_case('native', 's', C.INDEFINITE, 'true')} END)::INT) AS share FROM (SELECT {_NATIVE} AS native, {_SHAPED} AS s FROM entries) GROUP BY native"))
def indefinite_share(spark, sf):
    return _checked(spark, sf).groupBy("native").agg(F.count("*").alias("n"), F.avg(C.indefinite(F.col("native"), F.col("shaped")).cast("int")).alias("share"))
