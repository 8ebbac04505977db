"""Lexical functions as column expressions: everything stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions import constants as K

STRIP = r"(?iu)^(" + "|".join(K.STRIPPED) + r")\s+"
STRIP_ALL = r"(?iu)^((" + "|".join(K.STRIPPED) + r")\s+)+"


def trim(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body names it (branches of a condition share nothing else)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(c: Column) -> Column:
    return F.transform(F.split(c, ","), trim)


def first_part(c: Column) -> Column:
    return trim(F.split(c, ",")[0])


def strip_article(c: Column) -> Column:
    return trim(F.regexp_replace(c, STRIP, ""))


def sort_key(original: Column) -> Column:
    return F.lower(strip_article(first_part(original)))


def search_terms(original: Column) -> Column:
    """Stripped parts, each followed by its words of three letters if it has several; then the stripped whole; each once."""
    stripped = F.filter(F.transform(F.filter(parts(original), lambda p: p != ""), strip_article), lambda p: p != "")
    each = F.transform(stripped, lambda p: F.concat(F.array(p), F.when(F.size(F.split(p, r"\s+")) > 1, F.filter(F.split(p, r"\s+"), lambda w: F.length(w) >= 3)).otherwise(F.array().cast("array<string>"))))
    whole = trim(F.split(F.regexp_replace(original, STRIP, ""), ",")[0])
    return F.array_distinct(F.concat(F.flatten(each), F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))))


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def lookup_key(word: Column) -> Column:
    first = F.regexp_replace(F.lower(first_part(word)), "’", "'")
    tokens = F.filter(F.split(first, r"\s+"), lambda t: t != "")
    dropped = F.when((F.size(tokens) > 1) & tokens[0].isin(K.LOOKUP_ARTICLES), F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), " ")).otherwise(first)
    return F.regexp_replace(dropped, "^[a-zà-ÿ]['’]", "")


def apostrophes(c: Column) -> Column:
    return F.translate(c, "’", "'")


def is_abbreviation(original: Column) -> Column:
    base = trim(F.regexp_replace(first_part(original), STRIP_ALL, ""))
    return F.coalesce((F.length(base) >= 2) & base.rlike(r"^[\p{Lu}\p{N}]+$") & base.rlike(r"\p{Lu}"), F.lit(False))


def is_proper_noun(original: Column, lang: Column) -> Column:
    first = first_part(original)
    head = F.substring(first, 1, 1)
    return F.coalesce((lang != "de") & (first != "") & ~first.rlike(STRIP) & ~first.rlike(r"\s") & (head == F.upper(head)) & (head != F.lower(head)), F.lit(False))


def is_multi_word_noun(original: Column, kind: Column) -> Column:
    leak = F.exists(parts(original), lambda p: trim(F.regexp_replace(p, STRIP, "")).rlike(r"\s"))
    return F.coalesce(kind.isin("noun", "other") & leak, F.lit(False))


def is_usable_word(tok: Column) -> Column:
    """A letter and 1 to 29 letters, hyphens or apostrophes."""
    return F.coalesce(tok.rlike(r"^\p{L}[\p{L}'-]{1,29}$"), F.lit(False))


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), K.ACCENTED, K.PLAIN)


def is_not_infinitive(original: Column, kind: Column, lang: Column) -> Column:
    low, out = fold(trim(original)), F.lit(False)
    for code, pattern in K.INFINITIVES.items():
        out = F.when(lang == code, ~low.rlike(pattern)).otherwise(out)
    return F.coalesce((kind == "verb") & (original != "") & out, F.lit(False))


def collapse_identical(c: Column) -> Column:
    p = parts(c)
    return F.when((F.size(p) == 2) & (F.lower(p[0]) == F.lower(F.get(p, F.lit(1)))), p[0]).otherwise(c)


def collapse_adjective(c: Column, kind: Column, lang: Column) -> Column:
    p = F.filter(parts(c), lambda x: x != "")
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return F.when((kind == "adjective") & lang.isin(*K.ONE_FORM_ADJECTIVES) & (F.size(p) == 2) & (F.lower(a) != F.lower(b)), F.when(F.length(a) <= F.length(b), a).otherwise(b)).otherwise(c)


def capitalise_german(c: Column, kind: Column) -> Column:
    def one(part: Column) -> Column:
        body = trim(part)
        article = F.regexp_extract(body, STRIP, 0)
        rest = F.substring(body, F.length(article) + 1, F.length(body))
        lead, last = F.regexp_extract(rest, r"^(.*\s)?(\S+)$", 1), F.regexp_extract(rest, r"^(.*\s)?(\S+)$", 2)
        new = F.concat(F.regexp_extract(part, r"^(\s*)", 1), article, lead, F.upper(F.substring(last, 1, 1)), F.substring(last, 2, 1000000), F.regexp_extract(part, r"(\s*)$", 1))
        return F.when(rest == "", part).otherwise(new)

    return F.when(kind == "noun", F.array_join(F.transform(F.split(c, ","), one), ",")).otherwise(c)


def normal_answer(c: Column) -> Column:
    return composed(F.lower(F.regexp_replace(trim(c), r"\s+", " ")))


def bare_answer(s: Column) -> Column:
    return F.when(s.startswith("l'"), F.ltrim(F.substring(s, 3, 1000000))).when(F.split(s, " ")[0].isin(K.ANSWER_ARTICLES) & s.contains(" "), F.ltrim(F.regexp_replace(s, "^[^ ]* ", ""))).otherwise(s)


def match_answer(given: Column, expected: Column) -> Column:
    """exact, tolerant or none."""
    a, b = normal_answer(given), normal_answer(expected)
    each = F.transform(F.split(expected, ","), normal_answer)
    bare, other = bare_answer(a), F.concat(F.array(bare_answer(b)), F.transform(each, bare_answer))
    near = F.exists(other, lambda p: (F.length(p) >= 5) & (F.length(bare) >= 5) & (F.levenshtein(bare, p) <= 1))
    return F.when(a == "", "none").when(a == b, "exact").when(F.array_contains(each, a) | F.array_contains(other, bare) | near, "tolerant").otherwise("none")


def format_count(n: Column) -> Column:
    def short(x: Column, unit: str) -> Column:
        tenth = F.floor(x * 10 + 0.5) / 10
        return F.when(x >= 100, F.concat(F.floor(x).cast("string"), F.lit(unit))).otherwise(F.concat(F.regexp_replace(F.format_string("%.1f", tenth), r"\.0$", ""), F.lit(unit)))

    return F.when(n.isNull() | F.isnan(n.cast("double")) | (n < 0) | (n.cast("double") == float("inf")), "0").when(n < 1000, F.floor(n).cast("string")).when(n < 1e6, short(n / 1000, "k")).otherwise(short(n / 1e6, "M"))


def display_level(level: Column) -> Column:
    return F.when(level.isin("C1", "C2"), "C").otherwise(level)


def internal_level(level: Column) -> Column:
    return F.when(level == "C", "C1").otherwise(level)


def level_rank(level: Column) -> Column:
    """1..6, or 0 for what is not on the ladder."""
    return F.array_position(F.array(*map(F.lit, K.LEVELS)), level)


def at_or_above(level: Column, least: Column) -> Column:
    a, b = level_rank(level), level_rank(least)
    return F.coalesce((a == 0) | (b == 0) | (a >= b), F.lit(True))


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def title(text: Column, limit: int = 50) -> Column:
    return F.concat(trim(F.substring(text, 1, limit)), F.when(F.length(text) > limit, "...").otherwise(""))


def cognate_shift(a: Column, b: Column) -> Column:
    """Change of a word's difficulty by the normalised edit distance to its gloss."""
    n = F.greatest(F.length(a), F.length(b))
    d = F.when(n == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / n)
    return F.when(d < 0.3, -0.08).when(d > 0.8, 0.04).otherwise(0.0)


def _named(code: Column, names: dict[str, str], rest: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), code), rest)


def language_name(code: Column, english: bool = False) -> Column:
    return _named(code, K.ENGLISH_NAMES if english else K.NATIVE_NAMES, code)


def language_flag(code: Column) -> Column:
    """The two regional signs of the language's country, or nothing."""
    return _named(code, {k: "".join(chr(0x1F1E6 + ord(x) - 65) for x in v) for k, v in K.COUNTRIES.items()}, F.lit(""))


def image_title(text: Column) -> Column:
    """The first five words of a scanned text and an ellipsis."""
    return F.concat(F.array_join(F.slice(F.split(trim(text), r"\s+"), 1, 5), " "), F.lit("…"))


#: Letters with marks behind them, and the single characters they make.
COMPOSED = {letter + mark: one for mark in "\u0300\u0301\u0302\u0303\u0308\u030a\u030b\u030c\u0327\u0328" for letter in "abcdefghijklmnopqrstuvwxyz" if len(one := unicodedata.normalize("NFC", letter + mark)) == 1}


def composed(low: Column) -> Column:
    """Lower-case letters with their marks as one character each, where there is one."""
    table = F.create_map(*(F.lit(x) for kv in COMPOSED.items() for x in kv))
    whole = F.array_join(F.transform(F.regexp_extract_all(low, F.lit(r"(?s).\p{M}?"), 0), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(low.rlike(r"\p{M}"), whole).otherwise(low)


def source_forms(forms: Column, original: Column) -> Column:
    """The forms of a card out of their JSON text; where that is missing, malformed or holds none, the search terms of its word."""
    kept = F.filter(F.from_json(forms, "array<string>"), lambda x: x.isNotNull() & (trim(x) != ""))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(search_terms(original))
