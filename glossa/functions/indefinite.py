"""Indefinite articles for nouns as column expressions: tables of fixed values by language, and one rule that reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions import lex

#: How a noun with an indefinite article begins.
HAS = {"pt": r"^(um|uma)\s", "es": r"^(un|una|unos|unas)\s", "it": r"^(un\s|uno\s|una\s|un')", "fr": r"^(un\s|une\s|un'|une')", "de": r"^(ein|eine)\s", "nl": r"^een\s", "en": r"^(a|an)\s", "sv": r"^(en|ett|ei|et)\s", "no": r"^(en|ett|ei|et)\s", "da": r"^(en|ett|ei|et)\s"}
#: Definite articles with the gender they tell (masculine, feminine, neuter, common; none: they leave it open).
DEFINITE = {
    "pt": {"o": "m", "os": "m", "a": "f", "as": "f"}, "es": {"el": "m", "los": "m", "lo": "m", "la": "f", "las": "f"}, "it": {"il": "m", "lo": "m", "i": "m", "gli": "m", "le": "m", "la": "f", "l'": None},
    "fr": {"le": "m", "la": "f", "les": None, "l'": None}, "de": {"der": "m", "die": "f", "das": "n"}, "nl": {"de": "c", "het": "c"}, "en": {"the": "c"},
}
#: Articles and contractions in a text before a noun, by the gender they tell (none: they are read but tell none).
SIGNALS = {
    "pt": {"m": "o os no nos do dos ao aos pelo pelos num nuns dum duns", "f": "a as na nas da das à às pela pelas numa numas duma dumas"},
    "es": {"m": "el los lo al del un unos", "f": "la las una unas"},
    "it": {"m": "il lo i gli un un' uno del dello dei degli al allo ai agli nel nello nei negli dal dallo dai dagli sul sullo sui sugli", "f": "la le una della delle alla alle nella nelle dalla dalle sulla sulle", None: "l'"},
    "fr": {"m": "le un du au", "f": "la une", None: "les l' des aux"},
    "de": {"m": "der den dem des ein einen einem eines", "f": "die eine einer", "n": "das"},
    "nl": {"c": "de het een"},
    "en": {"c": "the a an"},
    "sv": {"c": "en ei", "n": "ett et"}, "no": {"c": "en ei", "n": "ett et"}, "da": {"c": "en ei", "n": "ett et"},
}
#: Genders by whole words, then by endings in this order, then for the rest (none: the noun stays bare).
ENDINGS = {
    "pt": [(r"^(dia|mapa|problema|sistema|tema|programa|planeta|clima|cinema|drama|poema|teorema|idioma|aroma|diploma|fantasma|telefonema)$", "m"), (r"^(mão|tribo|libido|foto|moto)$", "f"), (r"(ção|são|dade|tade|tude|ice|agem|eza|ez|ie|ã)$", "f"), (r"ma$", "m"), (r"a$", "f"), ("", "m")],
    "es": [(r"^(día|mapa|problema|sistema|tema|programa|planeta|clima|idioma|poema|drama)$", "m"), (r"^(mano|foto|moto|radio)$", "f"), (r"(ción|sión|dad|tad|tud|umbre|ez|ía)$", "f"), (r"ma$", "m"), (r"a$", "f"), ("", "m")],
    "it": [(r"(zione|sione|tà|tù|ie|gine|trice|ite)$", "f"), (r"ma$", "m"), (r"a$", "f"), ("", "m")],
    "fr": [(r"(tion|sion|ance|ence|ée|ette|esse|aison|ude|té|rie|ie|ure|eur)$", "f"), (r"(age|eau|ment|isme|scope|phone|gramme|mètre)$", "m")],
    "de": [],
    "nl": [("", "c")], "en": [("", "c")], "sv": [("", "c")], "no": [("", "c")], "da": [("", "c")],
}
#: What stands before a noun of a gender (the key "": of any other). Italian and English also go by the noun's sound.
BUILT = {"pt": {"f": "uma ", "": "um "}, "es": {"f": "una ", "": "un "}, "it": {"f": "una ", "": "un "}, "fr": {"f": "une ", "": "un "}, "de": {"f": "eine ", "": "ein "}, "nl": {"": "een "}, "en": {"": "a "}, "sv": {"n": "ett ", "": "en "}, "no": {"n": "ett ", "": "en "}, "da": {"n": "ett ", "": "en "}}
IT_UNO, IT_ELIDED = r"(?i)^(s[bcdfghjklmnpqrstvwxz]|z|gn|ps|x|y)", r"(?i)^[aeiou]"
EN_AN, EN_A, EN_VOWEL = r"(?i)^(hour|honest|honor|honour|heir|MBA|FBI|SUV|RSVP)", r"(?i)^(university|universal|uniform|unit|utopia|useful|user|eu|euro|once|one)", r"(?i)^[aeiou]"
#: Signals that decide, and the order of genders that have equally many.
READ, ORDER = 5, "mfnc"


def _table(entries: dict[str, str | None]) -> Column:
    return F.create_map(*(F.lit(x) for k, v in entries.items() if v is not None for x in (k, v)))


_HAS = {lang: "(?iu)" + p for lang, p in HAS.items()}
_DEFINITE = {lang: "(?iu)^(" + "|".join(a if a.endswith("'") else a + r"\s+" for a in arts) + ")(.+)$" for lang, arts in DEFINITE.items()}
_GENDER_OF = {f"{lang}:{a}": g for lang, arts in DEFINITE.items() for a, g in arts.items()}
_SIGNAL_OF = {f"{lang}:{t}": g for lang, by in SIGNALS.items() for g, tokens in by.items() for t in tokens.split() if g}
_SCANNED = {lang: r"(?iuU)(?:^|[^\p{L}])(" + "|".join(sorted((t for tokens in by.values() for t in tokens.split()), key=len, reverse=True)) + r")['\s]+(?:" for lang, by in SIGNALS.items()}


def _ending(lang: Column, noun: Column) -> Column:
    out, low = F.lit(None).cast("string"), F.lower(noun)
    for code, rules in ENDINGS.items():
        gender = F.lit(None).cast("string")
        for pattern, g in reversed(rules):
            gender = F.when(low.rlike(pattern), g).otherwise(gender) if pattern else F.lit(g)
        out = F.when(lang == code, gender).otherwise(out)
    return out


def _built(lang: Column, gender: Column, noun: Column) -> Column:
    prefix = F.coalesce(F.try_element_at(_table({f"{k}:{g}": v for k, by in BUILT.items() for g, v in by.items() if g}), F.concat(lang, F.lit(":"), gender)), F.try_element_at(_table({k: by[""] for k, by in BUILT.items()}), lang))
    italian = F.when((gender == "f") & noun.rlike(IT_ELIDED), "un'").when((gender != "f") & noun.rlike(IT_UNO), "uno ").otherwise(prefix)
    english = F.when(noun.rlike(EN_AN), "an ").when(noun.rlike(EN_A), "a ").when(noun.rlike(EN_VOWEL), "an ").otherwise("a ")
    return F.concat(F.when(lang == "it", italian).when(lang == "en", english).otherwise(prefix), noun)


def gender_in_text(noun: Column, forms: Column, text: Column, lang: Column) -> Column:
    """The gender that most of the first READ telling articles before the noun or one of its forms have; null without any."""
    every = F.filter(F.array_distinct(F.transform(F.concat(F.array(noun), F.coalesce(forms, F.array().cast("array<string>"))), F.lower)), lambda f: F.coalesce(f != "", F.lit(False)))
    longest = F.array_sort(every, lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.try_element_at(_table(_SCANNED), lang), F.array_join(F.transform(longest, lex.escape_regex), "|"), F.lit(r")(?=$|[^\p{L}])"))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, F.lit(1))
    told = F.slice(F.filter(F.transform(found, lambda t: F.try_element_at(_table(_SIGNAL_OF), F.concat(lang, F.lit(":"), F.lower(t)))), lambda g: g.isNotNull()), 1, READ)
    n_of = lambda x: F.size(F.filter(told, lambda g: g == x))
    counted = F.array(*(F.struct(n_of(x).alias("n"), F.lit(-i).alias("rank"), F.lit(x).alias("g")) for i, x in enumerate(ORDER)))
    return F.when(F.length(text) >= 2, F.when(F.size(told) > 0, F.array_max(counted)["g"]))


def _single(part: Column, given: Column, forms: Column, text: Column, lang: Column) -> Column:
    """part: trimmed; given: what stays where no article can be told."""
    pattern = F.try_element_at(_table(_DEFINITE), lang)
    article = F.lower(F.rtrim(F.call_function("regexp_extract", part, pattern, F.lit(1))))
    gender = F.try_element_at(_table(_GENDER_OF), F.concat(lang, F.lit(":"), article))
    bare = F.coalesce(gender_in_text(part, forms, text, lang), _ending(lang, part))
    return (
        F.when(part == "", given)
        .when(F.rlike(part, F.try_element_at(_table(_HAS), lang)), part)
        .when(F.coalesce(article, F.lit("")) != "", F.when(gender.isNotNull(), _built(lang, gender, F.call_function("regexp_extract", part, pattern, F.lit(2)))).otherwise(given))
        .when(bare.isNotNull(), _built(lang, bare, part))
        .otherwise(given)
    )


def with_indefinite(original: Column, forms: Column, text: Column, lang: Column) -> Column:
    """A noun (or pair of nouns, by commas) with the indefinite article of its language: kept if it has one, in place of a
    definite one whose gender is clear, else by articles in the text, by the ending, or not at all. Languages without a table
    and blank nouns stay as they are."""
    pair = F.array_join(F.transform(F.split(original, ","), lambda p: _single(lex.trim(p), lex.trim(p), forms, text, lang)), ", ")
    one = _single(lex.trim(original), original, forms, text, lang)
    return F.when(lang.isin(*HAS) & (lex.trim(original) != ""), F.when(original.contains(","), pair).otherwise(one)).otherwise(original)
