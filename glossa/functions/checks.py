"""Checks of extracted entries as column expressions: articles, infinitives, leaks, indefinite shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.lex import trim

#: What a noun of each language begins with.
ARTICLE = {
    "de": "^(der |die |das )", "fr": "^(le |la |l'|les |un |une )", "es": "^(el |la |los |las )", "it": "^(il |la |lo |l'|i |le |gli )", "pt": "^(o |a |os |as )", "nl": "^(de |het )",
    "sv": "(^(en |ett |den |det )|(a|en|et|ens|ets|na|nas|ne|ene|erne|ernas)$)", "no": "(^(en |ei |et |den |det )|(a|en|et|ens|ets|na|nas|ne|ene|erne|ernas)$)", "da": "(^(en |et |den |det )|(a|en|et|ens|ets|na|nas|ne|ene|erne|ernas)$)",
}
#: Infinitives as the quality figures see them (narrower than the filter's).
INFINITIVE = {"de": r"^(sich )?\S+(e?(n|rn|ln))$", "fr": r"(^se |^s'|(er|ir|re|oir|oire)$)", "es": "(ar|er|ir|arse|erse|irse)$", "it": "(are|ere|ire|arsi|ersi|irsi)$", "pt": "(ar|er|ir|or|ar-se|er-se|ir-se)$", "nl": "en$", "en": "^to "}
#: Indefinite beginnings of a translation.
INDEFINITE = {
    "de": r"^(ein|eine)\s", "fr": r"^(un\s|une\s|un'|une')", "es": r"^(un|una|unos|unas)\s", "it": r"^(un\s|uno\s|una\s|un')", "pt": r"^(um|uma|uns|umas)\s", "nl": r"^(een|'n)\s", "en": r"^(a|an)\s",
    "sv": r"^(en|ett|ei|et)\s", "no": r"^(en|ett|ei|et)\s", "da": r"^(en|ett|ei|et)\s",
}
#: Any article, for languages without articles.
ANY_ARTICLE = r"^(der|die|das|ein|eine|le|la|les|l'|un|une|el|los|las|il|lo|gli|i|o|a|os|as|de|het|een|the|a|an|en|ett|ei|et)\s"
LEAK_ARTICLE = r"^(der|die|das|le|la|les|l'|el|los|las|il|lo|gli|i|o|a|os|as|de|het|en|ett|den|det|ei|et) "


def _by(lang: Column, table: dict[str, str], on: Column, rest: bool) -> Column:
    out = F.lit(rest)
    for code, pattern in table.items():
        out = F.when(lang == code, on.rlike("(?i)" + pattern)).otherwise(out)
    return out


def has_article(lang: Column, original: Column) -> Column:
    return _by(lang, ARTICLE, F.lower(trim(original)), False)


def is_infinitive(lang: Column, original: Column) -> Column:
    return _by(lang, INFINITIVE, F.lower(trim(original)), True)


def three_words(original: Column) -> Column:
    return trim(original).rlike(r"^\S+\s\S+\s\S+")


def proper_noun_leak(lang: Column, original: Column) -> Column:
    """All words behind an article are capitalised (German: in capitals); a single one has at least three capitals."""
    words = F.filter(F.split(F.regexp_replace(trim(original), "(?i)" + LEAK_ARTICLE, ""), r"\s+"), lambda w: w != "")
    capitals = F.forall(words, lambda w: w.rlike("^[A-ZÄÖÜ]{2,}$"))
    first = F.forall(words, lambda w: w.rlike("^[A-ZÁÀÂÄÉÈÊËÍÎÏÓÔÖÚÛÜÇÑ]"))
    return F.when(lang == "de", (F.size(words) >= 2) & capitals).when(F.size(words) < 2, (F.size(words) == 1) & F.get(words, F.lit(0)).rlike("^[A-Z]{3,}$")).otherwise(first)


def german_case_error(translation: Column) -> Column:
    return trim(translation).rlike(r"^(?i:der|die|das)\s+[A-ZÄÖÜ]\S*\s+[A-ZÄÖÜ]\S*(\s|$)")


def indefinite(native: Column, translation: Column) -> Column:
    """Whether a translation has the indefinite shape of its language; unknown languages and empty texts pass."""
    t = F.ltrim(trim(translation))
    return F.when(t == "", True).when(native.isin("pl", "cs"), ~t.rlike("(?i)" + ANY_ARTICLE)).otherwise(_by(native, INDEFINITE, t, True))
