"""Queries of word lists, features, lexical normalisation and the filter chain of extracted vocabulary."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.functions import lemma as L
from glossa.functions import lex, model
from glossa.functions.indefinite import with_indefinite
from glossa.operators import adapters as A
from glossa.operators.adapters import oracle
from glossa.operators.extract import filter_chain
from glossa.operators.ranking import letters, running
from glossa.plans.base import query

_STRIP = "^(" + "|".join(w.replace("'", "''") for w in K.STRIPPED) + r")\s+"
_STRIP_ALL = "^((" + "|".join(w.replace("'", "''") for w in K.STRIPPED) + r")\s+)+"


#: Words without accents: the oracle's edit distance counts bytes.
_PLAIN = f"translate(lower({{}}), '{K.ACCENTED}ßœæ', '{K.PLAIN}soa')"


@query(oracle("freq", "SELECT lang, tok, c, zipf FROM freq"))
def zipf_build(spark, sf):
    return A.zipf_table(A.tokens(spark, sf))


@query(oracle("features", "SELECT lang, tok, eta, level FROM features"))
def classify(spark, sf):
    return A.features(A.tokens(spark, sf)).select("lang", "tok", "eta", "level")


@query(oracle("features", "SELECT lang, CASE WHEN length(tok) % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, count(*) AS n FROM features GROUP BY 1, 2"))
def confidence_histogram(spark, sf):
    return A.features(A.tokens(spark, sf)).groupBy("lang", "confidence").agg(F.count("*").alias("n"))


@query(oracle("tokens", "SELECT DISTINCT lang, tok FROM tokens t WHERE doc_id % 2 = 1 AND tok NOT IN (SELECT tok FROM tokens WHERE doc_id % 2 = 0)"))
def oov_cross_corpus(spark, sf):
    t = A.tokens(spark, sf)
    return t.where("doc_id % 2 = 1").select("lang", "tok").distinct().join(t.where("doc_id % 2 = 0").select("tok").distinct(), "tok", "left_anti").select("lang", "tok")


@query(oracle("tokens", "SELECT lang, tok, tok IN (SELECT tok FROM tokens WHERE doc_id % 2 = 0) AS known FROM (SELECT DISTINCT lang, tok FROM tokens WHERE doc_id % 2 = 1)"))
def known_anywhere(spark, sf):
    """Words of odd documents, and whether the list of any language (of even documents) has them."""
    t = A.tokens(spark, sf)
    lists = t.where("doc_id % 2 = 0").select(F.col("tok").alias("w")).distinct()
    return t.where("doc_id % 2 = 1").select("lang", "tok").distinct().join(lists, F.col("tok") == F.col("w"), "left").select("lang", "tok", F.col("w").isNotNull().alias("known"))


@query(oracle("freq", r"SELECT lang, tok, zipf, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY zipf DESC, tok) AS r FROM freq WHERE regexp_matches(tok, '^\p{L}[\p{L}''-]{1,29}$')) WHERE r <= 50"))
def top_words_per_lang(spark, sf):
    w = Window.partitionBy("lang").orderBy(F.desc("zipf"), "tok")
    f = A.zipf_table(A.tokens(spark, sf)).where(lex.is_usable_word(F.col("tok")))
    return f.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 50").select("lang", "tok", "zipf", "place")


@query(oracle("vocabulary", "SELECT id, CASE WHEN d < 0.3 THEN -0.08 WHEN d > 0.8 THEN 0.04 ELSE 0.0 END::DOUBLE AS shift FROM (SELECT id, levenshtein(a, b) / greatest(length(a), length(b)) AS d FROM (SELECT id, " + _PLAIN.format("original") + " AS a, " + _PLAIN.format("translation") + " AS b FROM vocabulary))"))
def cognate_adjust(spark, sf):
    plain = lambda c: F.translate(lex.fold(F.col(c)), "ßœæ", "soa")
    return A.vocabulary(spark, sf).select("id", lex.cognate_shift(plain("original"), plain("translation")).alias("shift"))


#: Raw entries as an extraction gives them: lines of documents as words with articles, pairs and capitals.
def _entries(spark, sf):
    v = A.vocabulary(spark, sf).select("id", "lang", "original", "translation", "word_type", "level", "doc_id", "pos")
    o, m = F.col("original"), F.col("pos") % 8
    plain = F.replace(o, F.lit("ß"), F.lit("ss"))
    made = F.when(m == 0, F.concat(F.lit("der "), o, F.lit(", die "), o, F.lit("in"))).when(m == 1, F.upper(plain)).when(m == 2, F.initcap(plain)).when(m == 3, F.concat(F.lit("the "), o, F.lit(" "), F.reverse(o))).when(m == 4, F.concat(o, F.lit(", "), o)).when(m == 5, F.concat(F.lit("l’"), o)).when(m == 6, F.concat(o, F.lit(", "), o, F.lit("e"))).otherwise(o)
    return v.withColumn("original", made)


_ENTRIES = """, entries AS (SELECT id, lang, CASE pos % 8 WHEN 0 THEN 'der ' || original || ', die ' || original || 'in' WHEN 1 THEN upper(replace(original, 'ß', 'ss')) WHEN 2 THEN upper(replace(original, 'ß', 'ss')[1]) || replace(original, 'ß', 'ss')[2:] WHEN 3 THEN 'the ' || original || ' ' || reverse(original)
 WHEN 4 THEN original || ', ' || original WHEN 5 THEN 'l’' || original WHEN 6 THEN original || ', ' || original || 'e' ELSE original END AS original, translation, word_type, level, doc_id, pos FROM vocabulary)
"""


def entry_oracle(body: str) -> str:
    return oracle("vocabulary", "").rstrip() + _ENTRIES + body


_FIRST = r"regexp_replace(split_part(original, ',', 1), '^\s+|\s+$', '', 'g')"
_KEY = rf"lower(trim(regexp_replace({_FIRST}, '{_STRIP}', '', 'i')))"


@query(entry_oracle(f"SELECT id, {_KEY} AS key FROM entries"))
def sort_keys(spark, sf):
    return _entries(spark, sf).select("id", lex.sort_key(F.col("original")).alias("key"))


@query(entry_oracle(f"SELECT id, row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, id) AS place FROM entries"))
def sort_alpha(spark, sf):
    e = _entries(spark, sf).withColumn("key", lex.sort_key(F.col("original")))
    return running(e, ["lang"], [letters(F.col("key"))], [F.col("key"), F.col("id")], "place").select("id", "place")


_PARTS = "list_transform(string_split(original, ','), lambda p: trim(p))"
_STRIPPED = f"list_filter(list_transform(list_filter({_PARTS}, lambda p: p <> ''), lambda p: trim(regexp_replace(p, '{_STRIP}', '', 'i'))), lambda p: p <> '')"


@query(entry_oracle(rf"SELECT id, array_to_string(list_sort(list_distinct(list_concat({_STRIPPED}, flatten(list_transform({_STRIPPED}, lambda p: CASE WHEN len(regexp_split_to_array(p, '\s+')) > 1 THEN list_filter(regexp_split_to_array(p, '\s+'), lambda w: length(w) >= 3) ELSE [] END)), [trim(split_part(regexp_replace(original, '{_STRIP}', '', 'i'), ',', 1))]))), '|') AS terms FROM entries"))
def search_terms(spark, sf):
    return _entries(spark, sf).select("id", F.array_join(F.array_sort(lex.search_terms(F.col("original"))), "|").alias("terms"))


_SET = "(" + ", ".join(f"'{w}'" for w in K.LOOKUP_ARTICLES) + ")"


@query(entry_oracle(rf"SELECT id, regexp_replace(CASE WHEN contains(f, ' ') AND split_part(f, ' ', 1) IN {_SET} THEN array_to_string(string_split(f, ' ')[2:], ' ') ELSE f END, '^[a-zà-ÿ][''’]', '') AS key FROM (SELECT id, replace(lower({_FIRST}), '’', '''') AS f FROM entries)"))
def lookup_keys(spark, sf):
    return _entries(spark, sf).select("id", lex.lookup_key(F.col("original")).alias("key"))


_BASE = rf"trim(regexp_replace({_FIRST}, '{_STRIP_ALL}', '', 'i'))"


@query(entry_oracle(rf"SELECT id FROM entries WHERE NOT (length({_BASE}) >= 2 AND regexp_matches({_BASE}, '^[\p{{Lu}}\p{{N}}]+$') AND regexp_matches({_BASE}, '\p{{Lu}}'))"))
def abbrev_drop(spark, sf):
    return _entries(spark, sf).where(~lex.is_abbreviation(F.col("original"))).select("id")


@query(entry_oracle(rf"SELECT id FROM entries WHERE NOT (lang <> 'de' AND NOT regexp_matches({_FIRST}, '{_STRIP}', 'i') AND NOT regexp_matches({_FIRST}, '\s') AND {_FIRST}[1] = upper({_FIRST}[1]) AND {_FIRST}[1] <> lower({_FIRST}[1]))"))
def proper_noun_drop(spark, sf):
    return _entries(spark, sf).where(~lex.is_proper_noun(F.col("original"), F.col("lang"))).select("id")


@query(entry_oracle(rf"SELECT id FROM entries WHERE NOT (word_type IN ('noun', 'other') AND len(list_filter({_PARTS}, lambda p: regexp_matches(trim(regexp_replace(p, '{_STRIP}', '', 'i')), '\s'))) > 0)"))
def multiword_drop(spark, sf):
    return _entries(spark, sf).where(~lex.is_multi_word_noun(F.col("original"), F.col("word_type"))).select("id")


_LOW = f"translate(lower(trim(original)), '{K.ACCENTED}', '{K.PLAIN}')"
_INF = " ".join(f"WHEN '{k}' THEN NOT regexp_matches({_LOW}, '{p.replace(chr(39), chr(39) * 2)}')" for k, p in K.INFINITIVES.items())


@query(entry_oracle(f"SELECT id FROM entries WHERE NOT (word_type = 'verb' AND CASE lang {_INF} ELSE false END)"))
def infinitive_drop(spark, sf):
    return _entries(spark, sf).where(~lex.is_not_infinitive(F.col("original"), F.col("word_type"), F.col("lang"))).select("id")


_TWO = f"len({_PARTS}) = 2"


@query(entry_oracle(f"SELECT id, CASE WHEN {_TWO} AND lower({_PARTS}[1]) = lower({_PARTS}[2]) THEN {_PARTS}[1] ELSE original END AS identical, CASE WHEN word_type = 'adjective' AND lang IN ('de', 'en') AND {_TWO} AND lower({_PARTS}[1]) <> lower({_PARTS}[2]) THEN CASE WHEN length({_PARTS}[1]) <= length({_PARTS}[2]) THEN {_PARTS}[1] ELSE {_PARTS}[2] END ELSE original END AS adjective FROM entries"))
def collapse_pairs(spark, sf):
    o = F.col("original")
    return _entries(spark, sf).select("id", lex.collapse_identical(o).alias("identical"), lex.collapse_adjective(o, F.col("word_type"), F.col("lang")).alias("adjective"))


@query(entry_oracle("SELECT id, replace(original, '’', '''') AS original FROM entries"))
def apostrophes(spark, sf):
    return _entries(spark, sf).select("id", lex.apostrophes(F.col("original")).alias("original"))


@query(oracle("vocabulary", "SELECT id, CASE WHEN word_type = 'noun' THEN 'die ' || upper(o[1]) || o[2:] || ', ein ' || upper(t[1]) || t[2:] ELSE 'die ' || o || ', ein ' || t END AS german FROM (SELECT *, replace(original, 'ß', 'ss') AS o, replace(translation, 'ß', 'ss') AS t FROM vocabulary WHERE lang <> 'de')"))
def german_caps(spark, sf):
    v = A.vocabulary(spark, sf).where("lang <> 'de'")
    o, t = (F.replace(c, F.lit("ß"), F.lit("ss")) for c in ("original", "translation"))
    return v.select("id", lex.capitalise_german(F.concat(F.lit("die "), o, F.lit(", ein "), t), F.col("word_type")).alias("german"))


@query(None)
def full_chain(spark, sf):
    return filter_chain(_entries(spark, sf), F.col("lang"), F.lit("de"), ["doc_id", "pos", "id"], group="doc_id").select("id", "original", "translation")


@query(oracle("vocabulary", r"""SELECT id, CASE WHEN given = '' THEN 'none' WHEN given = original THEN 'exact' WHEN length(original) >= 5 AND length(given) >= 5 AND levenshtein(given, original) <= 1 THEN 'tolerant' WHEN given = 'le ' || original THEN 'tolerant' ELSE 'none' END AS verdict
FROM (SELECT id, original, CASE pos % 5 WHEN 0 THEN original WHEN 1 THEN 'le ' || original WHEN 2 THEN original || 'x' WHEN 3 THEN '' ELSE 'zzz' || original END AS given FROM vocabulary)"""))
def answer_match(spark, sf):
    v, o, m = A.vocabulary(spark, sf), F.col("original"), F.col("pos") % 5
    given = F.when(m == 0, o).when(m == 1, F.concat(F.lit("le "), o)).when(m == 2, F.concat(o, F.lit("x"))).when(m == 3, "").otherwise(F.concat(F.lit("zzz"), o))
    return v.select("id", lex.match_answer(given, o).alias("verdict"))


@query("SELECT event_id, CASE WHEN n < 1000 THEN floor(n)::BIGINT::VARCHAR WHEN n / 1000 >= 100 AND n < 1000000 THEN floor(n / 1000)::BIGINT::VARCHAR || 'k' WHEN n < 1000000 THEN regexp_replace(printf('%.1f', floor(n / 1000 * 10 + 0.5) / 10), '\\.0$', '') || 'k' ELSE regexp_replace(printf('%.1f', floor(n / 1e6 * 10 + 0.5) / 10), '\\.0$', '') || 'M' END AS shown FROM (SELECT event_id, event_id * event_id * 1.0::DOUBLE AS n FROM events)")
def format_count(spark, sf):
    n = (F.col("event_id") * F.col("event_id")).cast("double")
    return A.table(spark, sf, "events").select("event_id", lex.format_count(n).alias("shown"))


@query(oracle("vocabulary", "SELECT id, CASE WHEN level IN ('C1', 'C2') THEN 'C' ELSE level END AS shown FROM vocabulary"))
def display_levels(spark, sf):
    return A.vocabulary(spark, sf).select("id", lex.display_level(F.col("level")).alias("shown"))


@query("SELECT page_id, coalesce(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\\.', ''), '') AS host FROM pages")
def host_norm(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", lex.host(F.col("url")).alias("host"))


_WORD = r"^\p{L}[\p{L}''\- ]*\p{L}?$"


@query(entry_oracle(rf"SELECT id, CASE WHEN regexp_matches(w, '{_WORD}') AND length(w) BETWEEN 2 AND 40 THEN w END AS lemma FROM (SELECT id, CASE WHEN contains(f, ' ') AND split_part(f, ' ', 1) IN ('der', 'die', 'das', 'le', 'la', 'les', 'l', 'el', 'los', 'las', 'lo', 'i', 'gli', 'un', 'una', 'um', 'uma', 'o', 'os', 'as', 'de', 'het', 'een', 'en', 'ett', 'sich', 'se', 'si') THEN array_to_string(string_split(f, ' ')[2:], ' ') ELSE f END AS w FROM (SELECT id, lower({_FIRST}) AS f FROM entries))"))
def lemmas(spark, sf):
    return _entries(spark, sf).select("id", L.lemma(F.col("original")).alias("lemma"))


@query(entry_oracle(rf"SELECT id, upper(c) IN ('A1', 'A2', 'B1', 'B2', 'C1', 'C2') AS label, length(c) BETWEEN 2 AND 40 AND regexp_matches(c, '^\p{{L}}[\p{{L}}''\- ()]*$') AS word FROM (SELECT id, trim(regexp_replace(CASE WHEN pos % 3 = 0 THEN '“' || level || '”' ELSE '«' || original || '» ' END, '[‘’“”''\"`«»‹›]', '', 'g')) AS c FROM entries)"))
def cell_tests(spark, sf):
    e = _entries(spark, sf)
    cell = L.clean_cell(F.when(F.col("pos") % 3 == 0, F.concat(F.lit("“"), "level", F.lit("”"))).otherwise(F.concat(F.lit("«"), "original", F.lit("» "))))
    return e.select("id", L.is_label(cell).alias("label"), L.is_lemma(cell).alias("word"))


_GENDER = r"""CASE lang WHEN 'en' THEN 'c' WHEN 'fr' THEN CASE WHEN regexp_matches(o, '(tion|sion|ance|ence|ée|ette|esse|aison|ude|té|rie|ie|ure|eur)$') THEN 'f' WHEN regexp_matches(o, '(age|eau|ment|isme|scope|phone|gramme|mètre)$') THEN 'm' END
 WHEN 'es' THEN CASE WHEN o IN ('día', 'mapa', 'problema', 'sistema', 'tema', 'programa', 'planeta', 'clima', 'idioma', 'poema', 'drama') THEN 'm' WHEN o IN ('mano', 'foto', 'moto', 'radio') THEN 'f' WHEN regexp_matches(o, '(ción|sión|dad|tad|tud|umbre|ez|ía)$') THEN 'f' WHEN o LIKE '%ma' THEN 'm' WHEN o LIKE '%a' THEN 'f' ELSE 'm' END END"""


@query(oracle("vocabulary", rf"SELECT id, CASE WHEN g IS NULL THEN o WHEN lang = 'en' THEN CASE WHEN regexp_matches(o, '(?i)^(hour|honest|honor|honour|heir|MBA|FBI|SUV|RSVP)') THEN 'an ' WHEN regexp_matches(o, '(?i)^(university|universal|uniform|unit|utopia|useful|user|eu|euro|once|one)') THEN 'a ' WHEN regexp_matches(o, '^[aeiou]') THEN 'an ' ELSE 'a ' END || o WHEN lang = 'fr' THEN CASE g WHEN 'f' THEN 'une ' ELSE 'un ' END || o ELSE CASE g WHEN 'f' THEN 'una ' ELSE 'un ' END || o END AS original FROM (SELECT id, lang, original AS o, {_GENDER.replace(' o ', ' original ').replace('(o,', '(original,')} AS g FROM vocabulary WHERE word_type = 'noun')"))
def indefinite_by_ending(spark, sf):
    v = A.vocabulary(spark, sf).where("word_type = 'noun'")
    return v.select("id", with_indefinite(F.col("original"), F.array("original"), F.lit(""), F.col("lang")).alias("original"))


#: Articles before a noun in its text, with every separator doubled so that one match leaves the next one's.
_SIGNALS = {"en": ("the|a|an", "'c'"), "de": ("der|die|das|den|dem|des|einen|einem|einer|eines|eine|ein", "CASE WHEN x IN ('der', 'den', 'dem', 'des', 'ein', 'einen', 'einem', 'eines') THEN 'm' WHEN x = 'das' THEN 'n' ELSE 'f' END"), "fr": ("les|le|la|l''|une|un|du|des|aux|au", "CASE WHEN x IN ('le', 'un', 'du', 'au') THEN 'm' WHEN x IN ('la', 'une') THEN 'f' END"), "es": ("unos|unas|una|un|los|las|el|la|lo|al|del", "CASE WHEN x IN ('el', 'los', 'lo', 'al', 'del', 'un', 'unos') THEN 'm' ELSE 'f' END")}
_TOLD = "CASE lang " + " ".join(f"WHEN '{k}' THEN list_transform(regexp_extract_all(twice, '(?i)(?:^|[^\\p{{L}}])({alt})[''\\s]+(?:' || o || ')(?:$|[^\\p{{L}}])', 1), lambda t: list_transform([lower(t)], lambda x: {case})[1])" for k, (alt, case) in _SIGNALS.items()) + " END"
_MOST = "CASE WHEN len(s) = 0 THEN NULL ELSE list_extract(list_sort(list_transform(['m', 'f', 'n', 'c'], lambda g: (-len(list_filter(s, lambda y: y = g)), list_position(['m', 'f', 'n', 'c'], g), g))), 1)[3] END"


@query(oracle("vocabulary", rf"SELECT id, CASE WHEN g IS NULL THEN o WHEN lang = 'en' THEN CASE WHEN regexp_matches(o, '(?i)^(hour|honest|honor|honour|heir|MBA|FBI|SUV|RSVP)') THEN 'an ' WHEN regexp_matches(o, '(?i)^(university|universal|uniform|unit|utopia|useful|user|eu|euro|once|one)') THEN 'a ' WHEN regexp_matches(o, '^[aeiou]') THEN 'an ' ELSE 'a ' END || o ELSE CASE lang WHEN 'fr' THEN CASE g WHEN 'f' THEN 'une ' ELSE 'un ' END WHEN 'de' THEN CASE g WHEN 'f' THEN 'eine ' ELSE 'ein ' END ELSE CASE g WHEN 'f' THEN 'una ' ELSE 'un ' END END || o END AS original FROM (SELECT id, lang, o, coalesce({_MOST}, {_GENDER}) AS g FROM (SELECT id, lang, o, list_filter({_TOLD}, lambda x: x IS NOT NULL)[1:5] AS s FROM (SELECT v.id, v.lang, v.original AS o, regexp_replace(d.text, '([^\p{{L}}])', '\1\1', 'g') AS twice FROM vocabulary v JOIN documents d ON d.doc_id = v.content_id WHERE word_type = 'noun')))"))
def indefinite_articles(spark, sf):
    """Every noun with the article that the text it was found in, or its ending, tells."""
    v = A.vocabulary(spark, sf).where("word_type = 'noun'").select("id", "lang", "original", "content_id")
    met = v.join(A.contents(spark, sf).select(F.col("id").alias("c"), "original_text"), F.col("content_id") == F.col("c"))
    return met.select("id", with_indefinite(F.col("original"), F.array("original"), F.col("original_text"), F.col("lang")).alias("original"))
