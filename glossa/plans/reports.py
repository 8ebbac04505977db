"""Queries of the flags, rules and matrices of reports on extraction runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.functions import flags as X
from glossa.functions import lex
from glossa.operators import adapters as A
from glossa.operators.adapters import oracle
from glossa.plans.base import query

_LANGS = "['en','de','fr','es','it','pt','nl','sv','no','da','pl','cs']"
_RUNS = f""", runs AS (SELECT id, lang, {_LANGS}[(doc_id + pos) % 12 + 1] AS learn, {_LANGS}[(doc_id + pos + 1 + pos % 11) % 12 + 1] AS native, word_type, ['A1', 'A2', 'B1', 'B2', 'C1', 'C2'][(length(original) + doc_id) % 6 + 1] AS level,
 CASE pos % 10 WHEN 0 THEN 'der ' || o WHEN 1 THEN 'the ' || o WHEN 2 THEN o || ', ' || o WHEN 3 THEN upper(o) WHEN 4 THEN 'der die ' || o WHEN 5 THEN o || '-' || t WHEN 6 THEN 'en ' || o WHEN 7 THEN 'l’' || o WHEN 8 THEN 'a ' || o || ' b ' || o ELSE o END AS original,
 CASE pos // 10 % 7 WHEN 0 THEN 'the ' || upper(t[1]) || t[2:] WHEN 1 THEN 'ein ' || o WHEN 2 THEN o WHEN 3 THEN '' WHEN 4 THEN repeat(t, 12) WHEN 5 THEN 'der Große ' || upper(o[1]) || o[2:] ELSE t END AS translation,
 CASE pos % 9 WHEN 0 THEN NULL WHEN 1 THEN [' '] ELSE [o] END AS forms
 FROM (SELECT *, replace(original, 'ß', 'ss') AS o, replace(translation, 'ß', 'ss') AS t FROM vocabulary))
"""


def run_oracle(body: str, views: str = "vocabulary") -> str:
    return oracle(views, "").rstrip() + _RUNS + body


def runs(spark, sf):
    """Entries of runs: each word with a language to learn and a native one, in one of ten shapes and with one of seven translations."""
    v = A.vocabulary(spark, sf)
    langs, d, p = F.array(*map(F.lit, K.LANGUAGES)), F.col("doc_id"), F.col("pos")
    at = lambda i: F.element_at(langs, (i % 12 + 1).cast("int"))
    o, t, m, n = F.replace("original", F.lit("ß"), F.lit("ss")), F.replace("translation", F.lit("ß"), F.lit("ss")), p % 10, F.floor(p / 10) % 7
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    shape = F.when(m == 0, say("der ", o)).when(m == 1, say("the ", o)).when(m == 2, say(o, ", ", o)).when(m == 3, F.upper(o)).when(m == 4, say("der die ", o)).when(m == 5, say(o, "-", t)).when(m == 6, say("en ", o)).when(m == 7, say("l’", o)).when(m == 8, say("a ", o, " b ", o)).otherwise(o)
    gloss = F.when(n == 0, say("the ", cap(t))).when(n == 1, say("ein ", o)).when(n == 2, o).when(n == 3, "").when(n == 4, F.repeat(t, 12)).when(n == 5, say("der Große ", cap(o))).otherwise(t)
    forms = F.when(p % 9 == 0, F.lit(None).cast("array<string>")).when(p % 9 == 1, F.array(F.lit(" "))).otherwise(F.array(o))
    level = F.element_at(F.array(*map(F.lit, K.LEVELS)), ((F.length("original") + d) % 6 + 1).cast("int"))
    return v.select("id", "lang", at(d + p).alias("learn"), at(d + p + 1 + p % 11).alias("native"), "word_type", level.alias("level"), shape.alias("original"), gloss.alias("translation"), forms.alias("forms"))


_T = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_OWN = lambda x: "trim(regexp_replace(lower(trim(" + x + ")), '^(der |die |das |den |dem |le |la |les |l''|el |los |las |il |lo |gli |i |o |a |os |as |de |het |een |en |ett |ei |et |det |to |the |an |sich |se |s''|si )', ''))"
_FOLD = lambda x: f"translate(lower({x}), '{K.ACCENTED}', '{K.PLAIN}')"
_BEGIN = "CASE learn WHEN 'de' THEN regexp_matches(f, '^(der|die|das) ') WHEN 'fr' THEN regexp_matches(f, '^(le |la |l''|les |un |une )') WHEN 'es' THEN regexp_matches(f, '^(el|la|los|las|un|una) ') WHEN 'it' THEN regexp_matches(f, '^(il |la |lo |l''|i |le |gli )') WHEN 'pt' THEN regexp_matches(f, '^(o|a|os|as|um|uma) ') WHEN 'nl' THEN regexp_matches(f, '^(de|het|een) ') WHEN 'sv' THEN regexp_matches(f, '^(en|ett|den|det) ') WHEN 'no' THEN regexp_matches(f, '^(en|ei|et|den|det) ') WHEN 'da' THEN regexp_matches(f, '^(en|et|den|det) ') ELSE false END"
_ENDS = "CASE learn WHEN 'de' THEN regexp_matches(i, '^(sich )?\\S+(e?(n|rn|ln))$') WHEN 'fr' THEN starts_with(i, 'se ') OR starts_with(i, 's''') OR regexp_matches(i, '(er|ir|re|oir|oire)$') WHEN 'es' THEN regexp_matches(i, '(ar|er|ir|arse|erse|irse)$') WHEN 'it' THEN regexp_matches(i, '(are|ere|ire|rre|arsi|ersi|irsi)$') WHEN 'pt' THEN regexp_matches(i, '(ar|er|ir|or|ar-se|er-se|ir-se)$') WHEN 'nl' THEN regexp_matches(i, '(en|an|on|un|ijn)$') WHEN 'en' THEN starts_with(i, 'to ') ELSE true END"
_N = lambda x: rf"len(regexp_split_to_array(trim({x}), '\s+'))"
_LEAD = "der|die|das|le|la|les|l''|’|el|los|las|il|lo|gli|i|o|a|os|as|de|het|en|ett|ei|den|det|et|the|to|sich|se|si"
_DOUBLE = "CASE learn WHEN 'de' THEN regexp_matches(w, '^(der |die |das )\\s*(der |die |das )') WHEN 'pt' THEN regexp_matches(w, '^(o |a |os |as |um |uma )\\s*(o |a |os |as |um |uma )') WHEN 'it' THEN regexp_matches(w, '^(il |la |lo |l''|i |le |gli )\\s*(il |la |lo |l''|i |le |gli )') WHEN 'fr' THEN regexp_matches(w, '^(le |la |l''|les |un |une )\\s*(le |la |l''|les |un |une )') WHEN 'es' THEN regexp_matches(w, '^(el |la |los |las |un |una )\\s*(el |la |los |las |un |una )') WHEN 'nl' THEN regexp_matches(w, '^(de |het |een )\\s*(de |het |een )') WHEN 'sv' THEN regexp_matches(w, '^(en |ett |den |det )\\s*(en |ett |den |det )') WHEN 'no' THEN regexp_matches(w, '^(en |ei |et |den |det )\\s*(en |ei |et |den |det )') WHEN 'da' THEN regexp_matches(w, '^(en |et |den |det )\\s*(en |et |den |det )') ELSE false END"
_ONE = r"'(?i)^(der|die|das|le|la|les|l''|el|los|las|il|lo|gli|i|o|a|os|as|de|het|en|ett|den|det|ei|et)\s+'"
_ABBR = rf"regexp_matches(regexp_replace(regexp_replace({_T("split_part(original, ',', 1)")}, '(?i)^(der|die|das|le|la|les|l''|el|il|lo|o|a|de|het|en|ett|et|ei)\s+', ''), '(?i)^[a-z]''', ''), '^[A-ZÄÖÜÁÀÂÉÈÊÍÎÓÔÚÛÇÑ0-9]{{2,}}$')"
_WIDE = f"(SELECT *, replace(lower(trim(original)), '’', '''') AS f, {_FOLD('trim(original)')} AS i, lower(trim(original)) AS w FROM runs)"
_COUNTS = {
    "h1": f"{_OWN('original')} <> '' AND {_OWN('translation')} <> '' AND {_FOLD(_OWN('original'))} = {_FOLD(_OWN('translation'))}", "h2": "length(trim(translation)) < 2", "h3": "length(translation) > 60",
    "h4": r"native = 'en' AND word_type = 'noun' AND regexp_matches(trim(translation), '^(?i:the|a|an)\s+[A-Z]')", "h5": _ABBR,
    "h6": f"contains(original, ',') AND {_OWN("split_part(original, ',', 1)")} = {_OWN("split_part(original, ',', 2)")} AND {_OWN("split_part(original, ',', 1)")} <> ''", "h11": "forms IS NULL OR len(list_filter(forms, lambda x: trim(x) <> '')) = 0",
    "h12": f"word_type NOT IN ('phrase', 'noun') AND {_N("regexp_replace(regexp_replace(original, '(?i)^(" + _LEAD + "' || CASE learn WHEN 'sv' THEN '|att' WHEN 'no' THEN '|a|å' WHEN 'da' THEN '|at' ELSE '' END || ')' || chr(92) || 's+', ''), '(?i)^[a-zà-ÿ][’'']', '')")} >= 2",
    "h14": r"regexp_matches(original, '\S-\S') AND original[1] <> '-'", "h15": f"word_type = 'verb' AND NOT {_ENDS}", "h17": f"word_type = 'noun' AND learn NOT IN ('sv', 'no', 'da', 'pl', 'cs') AND NOT {_BEGIN}",
    "h19": f"word_type = 'other' AND {_N(f"regexp_replace(original, {_ONE}, '')")} >= 2", "h20": _DOUBLE,
}


@query(run_oracle("SELECT learn, count(*) AS n, " + ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in _COUNTS.items()) + f" FROM {_WIDE} GROUP BY learn"))
def heuristics(spark, sf):
    return runs(spark, sf).groupBy("learn").agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in X.flags().items()))


_CAT = r"""CASE WHEN native IN ('pl', 'cs') THEN 'bare' WHEN native IN ('sv', 'no', 'da') THEN CASE WHEN regexp_matches(t, '^(en|ett|ei|et|den|det)\s') THEN 'indef' WHEN length(t) >= 4 AND regexp_matches(t, '(erne|ene|ane|arna|orna|na|en|et|n|a)$') THEN 'def' ELSE 'bare' END
 WHEN regexp_matches(t, CASE native WHEN 'en' THEN '^the\s' WHEN 'de' THEN '^(der|die|das|den|dem|des)\s' WHEN 'fr' THEN '^((le|la|les)\s|l'')' WHEN 'es' THEN '^(el|la|los|las)\s' WHEN 'it' THEN '^((il|la|lo|i|gli|le)\s|l'')' WHEN 'pt' THEN '^(o|a|os|as)\s' ELSE '^(de|het)\s' END) THEN 'def'
 WHEN regexp_matches(t, CASE native WHEN 'en' THEN '^(a|an)\s' WHEN 'de' THEN '^(ein|eine|einen|einem|einer|eines)\s' WHEN 'fr' THEN '^(un|une)\s' WHEN 'es' THEN '^(un|una|unos|unas)\s' WHEN 'it' THEN '^(un|uno|una|un'')' WHEN 'pt' THEN '^(um|uma|uns|umas)\s' ELSE '^een\s' END) THEN 'indef' ELSE 'bare' END"""
_KIND = lambda x: f"CASE WHEN {x} IN ('pl', 'cs') THEN 'bare' WHEN {x} IN ('sv', 'no', 'da') THEN 'indef' ELSE 'def' END"
_SEEN = f"(SELECT *, {_CAT} AS seen, CASE WHEN learn IN ('pl', 'cs') THEN {_KIND('native')} WHEN native IN ('pl', 'cs') THEN 'bare' ELSE {_KIND('learn')} END AS due FROM (SELECT *, replace(lower(trim(translation)), '’', '''') AS t FROM {_WIDE}))"


@query(run_oracle(f"SELECT native, {_KIND('learn')} AS category, count(*) FILTER (seen = 'def') AS def, count(*) FILTER (seen = 'indef') AS indef, count(*) FILTER (seen = 'bare') AS bare, count(*) FILTER (seen = 'unknown') AS unknown FROM {_SEEN} WHERE word_type = 'noun' GROUP BY 1, 2"))
def native_matrix(spark, sf):
    """By native language and by the kind of article of the language that is learnt: how translations of nouns begin."""
    seen = X.translation_category(F.col("native"), F.col("translation"))
    return runs(spark, sf).where("word_type = 'noun'").groupBy("native", X.category(F.col("learn")).alias("category")).agg(*(F.count_if(seen == c).alias(c) for c in X.CATEGORIES))


_RULES = {
    "r34": ("word_type = 'noun' AND learn IN ('sv', 'no', 'da')", _BEGIN), "r38": ("word_type = 'adjective' AND learn IN ('de', 'nl', 'sv', 'no', 'da', 'pl', 'cs', 'en')", "NOT contains(original, ',')"), "r39": ("word_type = 'verb'", _ENDS),
    "r41a": ("word_type = 'noun' AND learn IN ('pl', 'cs')", r"NOT regexp_matches(w, '^(the|a|an|der|die|das|le|la|les|l''|el|los|las|il|lo|gli|o|os|as|de|het|en|ett|ei|et|den|det|un|une|uno|una|um|uma)\s')"), "r41b": ("word_type = 'noun' AND learn = 'en'", r"regexp_matches(w, '^the\s')"),
    "r42": ("word_type = 'noun'", "seen = due OR (seen = 'bare' AND native IN ('sv', 'no', 'da') AND due = 'indef')"), "german": (f"word_type = 'noun' AND native = 'de' AND (regexp_matches(trim(translation), '^(?i:der|die|das)\\s+\\S') OR {_KIND('learn')} = 'def')", r"regexp_matches(trim(translation), '^(?i:der|die|das)\s+[A-ZÄÖÜ]')"),
    "r33": ("word_type = 'noun'", rf"len(list_filter(string_split(original, ','), lambda x: regexp_matches(regexp_replace({_T('x')}, '(?i)^(der|die|das|le|la|les|l''|l’|el|los|las|il|lo|gli|i|o|a|os|as|de|het|en|ett|den|det|ei|et)\s+', ''), '\S\s\S\s\S'))) = 0"),
    "r37": ("word_type = 'other'", f"{_N(f"regexp_replace(original, {_ONE}, '')")} < 2"), "short": ("true", f"NOT {_ABBR}"), "r40": ("true", "NOT contains(original, '’')"),
}


@query(run_oracle(f"SELECT native, count(*) AS n, " + ", ".join(f"count(*) FILTER ({a}) AS {k}_total, count(*) FILTER (({a}) AND ({b})) AS {k}_pass" for k, (a, b) in _RULES.items()) + f" FROM {_SEEN} GROUP BY native"))
def native_rules(spark, sf):
    """By native language: how many entries each rule is about, and how many keep it."""
    aggs = [x for k, (about, kept) in X.rules().items() for x in (F.count_if(about).alias(f"{k}_total"), F.count_if(about & kept).alias(f"{k}_pass"))]
    return runs(spark, sf).groupBy("native").agg(F.count("*").alias("n"), *aggs)


@query(run_oracle(f"SELECT learn, count(*) FILTER (word_type = 'noun') AS nouns, count(*) FILTER (word_type = 'noun' AND {_BEGIN}) AS with_article, CASE WHEN count(*) FILTER (word_type = 'noun') > 0 THEN count(*) FILTER (word_type = 'noun' AND {_BEGIN}) / count(*) FILTER (word_type = 'noun') ELSE 0 END AS share FROM {_WIDE} WHERE learn IN ('sv', 'no', 'da') GROUP BY learn"))
def scandinavian_articles(spark, sf):
    noun = F.col("word_type") == "noun"
    n, a = F.count_if(noun), F.count_if(noun & X.has_article(F.col("learn"), F.col("original")))
    return runs(spark, sf).where(F.col("learn").isin(*X.SCANDINAVIAN)).groupBy("learn").agg(n.alias("nouns"), a.alias("with_article"), F.when(n > 0, a / n).otherwise(0.0).alias("share"))


_NAMES = r"list_filter(regexp_split_to_array(regexp_replace(trim(original), '(?i)^(der|die|das|le|la|les|l''|el|los|las|il|lo|gli|i|o|a|os|as|de|het|en|ett|den|det|ei|et) ', ''), '\s+'), lambda x: x <> '')"


@query(run_oracle(rf"SELECT learn, count(*) FILTER (word_type = 'noun' AND NOT ({_RULES['r33'][1]})) AS multi_word, count(*) FILTER (CASE WHEN learn = 'de' THEN len(ws) >= 2 AND len(list_filter(ws, lambda x: NOT regexp_matches(x, '^[A-ZÄÖÜ]{{2,}}$'))) = 0 WHEN len(ws) < 2 THEN len(ws) = 1 AND regexp_matches(ws[1], '^[A-Z]{{3,}}$') ELSE len(list_filter(ws, lambda x: NOT regexp_matches(x, '^[A-ZÁÀÂÄÉÈÊËÍÎÏÓÔÖÚÛÜÇÑ]'))) = 0 END) AS names, count(*) FILTER (native = 'de' AND regexp_matches(trim(translation), '^(?i:der|die|das)\s+[A-ZÄÖÜ]\S*\s+[A-ZÄÖÜ]\S*(\s|$)')) AS german_case, count(*) FILTER ({_ABBR}) AS short FROM (SELECT *, {_NAMES} AS ws FROM runs) GROUP BY learn"))
def leak_counters(spark, sf):
    return runs(spark, sf).groupBy("learn").agg(*(F.count_if(c).alias(k) for k, c in X.leaks().items()))


_EVEN = ", even AS (SELECT lang AS l, tok AS k, round(log10(c / sum(c) OVER (PARTITION BY lang) * 1e9), 3) AS z FROM (SELECT lang, tok, count(*) AS c FROM tokens WHERE doc_id % 2 = 0 GROUP BY 1, 2))\n"
_LOOKUP = r"regexp_replace(CASE WHEN contains(e, ' ') AND split_part(e, ' ', 1) IN ('the', 'a', 'der', 'en') THEN array_to_string(string_split(e, ' ')[2:], ' ') ELSE e END, '^[a-zà-ÿ][''’]', '')"


@query(run_oracle(f"SELECT id, level, zipf, CASE WHEN zipf >= 6 THEN 'high' ELSE 'low' END AS anomaly FROM (SELECT id, level, word_type, coalesce(z, 0) AS zipf FROM (SELECT *, {_LOOKUP} AS k FROM (SELECT *, replace(lower(trim(split_part(original, ',', 1))), '’', '''') AS e FROM runs)) r LEFT JOIN even ON l = lang AND even.k = r.k) WHERE zipf >= 6 AND level IN ('C1', 'C2') OR zipf = 0 AND level IN ('A1', 'A2') AND word_type <> 'phrase'", "vocabulary").replace(_RUNS, _RUNS.rstrip() + _EVEN))
def zipf_anomalies(spark, sf):
    """Entries whose frequency in even documents (0 if they lack the word) and level don't go together."""
    z = A.zipf_table(A.tokens(spark, sf).where("doc_id % 2 = 0")).select(F.col("lang").alias("l"), F.col("tok").alias("k"), F.col("zipf").alias("z"))
    e = runs(spark, sf).withColumn("key", lex.lookup_key(F.col("original"))).join(z, (F.col("lang") == F.col("l")) & (F.col("key") == F.col("k")), "left")
    zipf = F.coalesce("z", F.lit(0.0))
    return e.select("id", "level", zipf.alias("zipf"), X.zipf_anomaly(zipf, F.col("level"), F.col("word_type")).alias("anomaly")).where("anomaly is not null")


_KINDS = ("noun", "verb", "adjective", "phrase", "other")


@query(run_oracle("SELECT learn, count(*) AS n, " + ", ".join([*(f"count(*) FILTER (word_type = '{k}') AS {k}" for k in _KINDS), *(f"count(*) FILTER (level = '{x}') AS {x}" for x in K.LEVELS), *(f"count(*) FILTER ({_COUNTS[h]}) AS {h}" for h in ("h1", "h15", "h17"))]) + f" FROM {_WIDE} GROUP BY learn"))
def report_pivot(spark, sf):
    """By language: entries by type and by level, and those with the flags that a report gives by language."""
    f = X.flags()
    counts = [*(F.count_if(F.col("word_type") == k).alias(k) for k in _KINDS), *(F.count_if(F.col("level") == x).alias(x) for x in K.LEVELS), *(F.count_if(f[h]).alias(h) for h in ("h1", "h15", "h17"))]
    return runs(spark, sf).groupBy("learn").agg(F.count("*").alias("n"), *counts)
