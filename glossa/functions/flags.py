"""Flags and rules of reports on extracted entries as column expressions, over original, translation, word_type, level, forms, learn, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions import checks, lex
from glossa.functions import constants as K
from glossa.functions.lex import trim

#: Articles that a report accepts before a noun, by language.
ARTICLES = {
    "de": ["der ", "die ", "das "], "fr": ["le ", "la ", "l'", "les ", "un ", "une "], "es": ["el ", "la ", "los ", "las ", "un ", "una "], "it": ["il ", "la ", "lo ", "l'", "i ", "le ", "gli "], "pt": ["o ", "a ", "os ", "as ", "um ", "uma "],
    "nl": ["de ", "het ", "een "], "sv": ["en ", "ett ", "den ", "det "], "no": ["en ", "ei ", "et ", "den ", "det "], "da": ["en ", "et ", "den ", "det "],
}
#: Languages with articles at the end of nouns, and without articles.
SCANDINAVIAN, BARE = ("sv", "no", "da"), ("pl", "cs")
#: What an entry may begin with before its own words.
LEADS = "der |die |das |den |dem |le |la |les |l'|el |los |las |il |lo |gli |i |o |a |os |as |de |het |een |en |ett |ei |et |den |det |to |the |a |an |sich |se |s'|si "
SHORT_ARTICLE = r"(?iu)^(der|die|das|le|la|les|l'|el|il|lo|o|a|de|het|en|ett|et|ei)\s+"
ENTRY_ARTICLE = r"(?iu)^(der|die|das|le|la|les|l'|el|los|las|il|lo|gli|i|o|a|os|as|de|het|en|ett|den|det|ei|et)\s+"
NOUN_ARTICLE = r"(?iu)^(der|die|das|le|la|les|l'|l’|el|los|las|il|lo|gli|i|o|a|os|as|de|het|en|ett|den|det|ei|et)\s+"
WORD_LEAD = r"der|die|das|le|la|les|l'|’|el|los|las|il|lo|gli|i|o|a|os|as|de|het|en|ett|ei|den|det|et|the|to|sich|se|si"
WORD_LEADS = {"sv": "att", "no": "a|å", "da": "at"}
ANY_ARTICLE = r"^(the|a|an|der|die|das|le|la|les|l'|el|los|las|il|lo|gli|o|os|as|de|het|en|ett|ei|et|den|det|un|une|uno|una|um|uma)\s"
#: The kind of article that entries of a language are to have.
CATEGORY = {"de": "def", "fr": "def", "es": "def", "it": "def", "pt": "def", "nl": "def", "en": "def", "sv": "indef", "no": "indef", "da": "indef", "pl": "bare", "cs": "bare"}
#: Fixed values: (definite, indefinite) beginnings of a translation, by language.
BEGINS = {
    "en": (r"^the\s", r"^(a|an)\s"), "de": (r"^(der|die|das|den|dem|des)\s", r"^(ein|eine|einen|einem|einer|eines)\s"), "fr": (r"^((le|la|les)\s|l')", r"^(un|une)\s"), "es": (r"^(el|la|los|las)\s", r"^(un|una|unos|unas)\s"),
    "it": (r"^((il|la|lo|i|gli|le)\s|l')", r"^(un|uno|una|un')"), "pt": (r"^(o|a|os|as)\s", r"^(um|uma|uns|umas)\s"), "nl": (r"^(de|het)\s", r"^een\s"),
}
SCANDINAVIAN_INDEFINITE, SCANDINAVIAN_ENDING = r"^(en|ett|ei|et|den|det)\s", r"(erne|ene|ane|arna|orna|na|en|et|n|a)$"
PAIRED = ("de", "nl", "sv", "no", "da", "pl", "cs", "en")
CATEGORIES = ("def", "indef", "bare", "unknown")


def _by(lang: Column, table: dict, make, rest: Column) -> Column:
    for code, x in table.items():
        rest = F.when(lang == code, make(x)).otherwise(rest)
    return rest


def folded(c: Column) -> Column:
    return F.translate(F.lower(trim(c)), "’", "'")


def has_article(lang: Column, original: Column) -> Column:
    """As reports on single entries have it: a beginning only, with either apostrophe."""
    return F.coalesce(_by(lang, ARTICLES, lambda a: folded(original).rlike("^(" + "|".join(a) + ")"), F.lit(False)), F.lit(False))


def is_infinitive(lang: Column, original: Column) -> Column:
    """As reports on single entries have it: the filter's endings, a straight apostrophe only."""
    low = lex.fold(trim(original))
    return _by(lang, K.INFINITIVES | {"fr": r"^(se |s')|(er|ir|re|oir|oire)$"}, low.rlike, F.lit(True))


def multi_word_noun(original: Column) -> Column:
    """As reports on single entries have it: three marks with blanks between them, in a part without its article."""
    return F.exists(lex.parts(original), lambda p: F.regexp_replace(p, NOUN_ARTICLE, "").rlike(r"\S\s\S\s\S"))


def own_words(c: Column) -> Column:
    return trim(F.regexp_replace(F.lower(trim(c)), f"^({LEADS})", ""))


def cognate(original: Column, translation: Column) -> Column:
    a, b = own_words(original), own_words(translation)
    return (a != "") & (b != "") & (lex.fold(a) == lex.fold(b))


def abbreviation(original: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(lex.first_part(original), SHORT_ARTICLE, ""), "(?i)^[a-z]'", "")
    return base.rlike("^[A-ZÄÖÜÁÀÂÉÈÊÍÎÓÔÚÛÇÑ0-9]{2,}$")


def same_pair(original: Column) -> Column:
    p = F.transform(F.split(original, ","), own_words)
    return (F.size(p) >= 2) & (F.get(p, F.lit(0)) == F.get(p, F.lit(1))) & (F.get(p, F.lit(0)) != "")


def words_of(c: Column) -> Column:
    return F.size(F.split(trim(c), r"\s+"))


def mistyped_phrase(original: Column, kind: Column, lang: Column) -> Column:
    lead = _by(lang, WORD_LEADS, lambda x: F.regexp_replace(original, rf"(?iu)^({WORD_LEAD}|{x})\s+", ""), F.regexp_replace(original, rf"(?iu)^({WORD_LEAD})\s+", ""))
    return ~kind.isin("phrase", "noun") & (words_of(F.regexp_replace(lead, "(?iu)^[a-zà-ÿ][’']", "")) >= 2)


def two_articles(lang: Column, original: Column) -> Column:
    return F.coalesce(_by(lang, ARTICLES, lambda a: F.lower(trim(original)).rlike(f"^({'|'.join(a)})\\s*({'|'.join(a)})"), F.lit(False)), F.lit(False))


def flags() -> dict[str, Column]:
    """Name to condition of each flag of a single entry."""
    o, t, kind, lang, native = (F.col(c) for c in ("original", "translation", "word_type", "learn", "native"))
    cond = {
        "h1": cognate(o, t), "h2": t.isNull() | (F.length(trim(t)) < 2), "h3": F.length(t) > 60, "h4": (native == "en") & (kind == "noun") & trim(t).rlike(r"^(?i:the|a|an)\s+[A-Z]"), "h5": abbreviation(o), "h6": same_pair(o),
        "h11": F.col("forms").isNull() | ~F.exists("forms", lambda f: F.coalesce(trim(f) != "", F.lit(False))), "h12": mistyped_phrase(o, kind, lang), "h14": o.rlike(r"\S-\S") & ~o.startswith("-"), "h15": (kind == "verb") & ~is_infinitive(lang, o),
        "h17": (kind == "noun") & ~lang.isin(*SCANDINAVIAN, *BARE) & ~has_article(lang, o), "h19": (kind == "other") & (words_of(F.regexp_replace(o, ENTRY_ARTICLE, "")) >= 2), "h20": two_articles(lang, o),
    }
    return {k: F.coalesce(c, F.lit(False)) for k, c in cond.items()}


def translation_category(native: Column, translation: Column) -> Column:
    """def, indef or bare by how a translation begins; unknown for other languages."""
    low = folded(translation)
    north = F.when(low.rlike(SCANDINAVIAN_INDEFINITE), "indef").when((F.length(low) >= 4) & low.rlike(SCANDINAVIAN_ENDING), "def").otherwise("bare")
    rest = F.when(native.isin(*SCANDINAVIAN), north).when(native.isin(*BARE), "bare").otherwise("unknown")
    return _by(native, BEGINS, lambda p: F.when(low.rlike(p[0]), "def").when(low.rlike(p[1]), "indef").otherwise("bare"), rest)


def category(lang: Column) -> Column:
    return F.coalesce(_by(lang, CATEGORY, F.lit, F.lit(None).cast("string")), F.lit("def"))


def expected_category(learn: Column, native: Column) -> Column:
    """The article of the original mirrored in the native language; a language without articles leaves it to the native one."""
    return F.when(category(learn) == "bare", category(native)).when(native.isin(*BARE), "bare").otherwise(category(learn))


def rules() -> dict[str, tuple[Column, Column]]:
    """Name to (which entries a rule is about, which of them keep it)."""
    o, t, kind, lang, native = (F.col(c) for c in ("original", "translation", "word_type", "learn", "native"))
    noun, low = kind == "noun", F.lower(trim(o))
    seen, due = translation_category(native, t), expected_category(lang, native)
    german = trim(t).rlike(r"^(?i:der|die|das)\s+\S")
    return {
        "r34": (noun & lang.isin(*SCANDINAVIAN), has_article(lang, o)), "r38": ((kind == "adjective") & lang.isin(*PAIRED), ~o.contains(",")), "r39": (kind == "verb", is_infinitive(lang, o)), "r41a": (noun & lang.isin(*BARE), ~low.rlike(ANY_ARTICLE)), "r41b": (noun & (lang == "en"), low.rlike(r"^the\s")),
        "r42": (noun, (seen == due) | ((seen == "bare") & native.isin(*SCANDINAVIAN) & (due == "indef"))), "german": (noun & (native == "de") & (german | (category(lang) == "def")), trim(t).rlike(r"^(?i:der|die|das)\s+[A-ZÄÖÜ]")),
        "r33": (noun, ~multi_word_noun(o)), "r37": (kind == "other", words_of(F.regexp_replace(o, ENTRY_ARTICLE, "")) < 2), "short": (F.lit(True), ~abbreviation(o)), "r40": (F.lit(True), ~o.contains("’")),
    }


def zipf_anomaly(zipf: Column, level: Column, kind: Column) -> Column:
    """high: very frequent at C1 or above; low: unseen at A2 or below (or without a level) and no phrase; else null."""
    rank = lex.level_rank(level)
    return F.when((zipf >= 6) & (rank >= 5), "high").when((zipf == 0) & (rank <= 2) & (kind != "phrase"), "low")


def leaks() -> dict[str, Column]:
    """Name to condition of what should not be among entries."""
    o, t, kind, lang, native = (F.col(c) for c in ("original", "translation", "word_type", "learn", "native"))
    return {"multi_word": (kind == "noun") & multi_word_noun(o), "names": checks.proper_noun_leak(lang, o), "german_case": (native == "de") & checks.german_case_error(t), "short": abbreviation(o)}
