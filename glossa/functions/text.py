"""Cleaning and gating of web and scanned text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.lex import let, trim

VOWEL, CONSONANT = "[aeiouáàâãäåéèêëíìîïóòôõöúùûüýÿœæ]", "[bcdfghjklmnpqrstvwxzçñß]"
NOISE_TAGS = "script style noscript iframe svg nav footer".split()


def strip_noise(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in NOISE_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*/?>", "")
    return out


def plain(html: Column) -> Column:
    """Text of a page: no noise, no tags, blanks collapsed."""
    return trim(F.regexp_replace(F.regexp_replace(strip_noise(html), r"<[^>]*>", " "), r"\s+", " "))


def dense_enough(html: Column, least: int = 200) -> Column:
    return F.length(plain(html)) >= least


def code_like(text: Column) -> Column:
    return (F.length(text) < 100) | (F.regexp_count(text, F.lit(r"[{}();:#.]")) / F.length(text) > 0.05)


def ocr_reason(text: Column) -> Column:
    """Null if scanned text is usable, else the first test that it fails."""

    def judged(t: Column, words: Column) -> Column:
        """words: the text without all but letters, digits and blanks."""
        n, total = F.size(F.filter(F.split(words, r"\s+"), lambda w: w != "")), F.length(F.regexp_replace(words, r"\s+", ""))
        letters, dark = F.length(F.regexp_replace(words, r"[^\p{L}]+", "")), F.length(F.regexp_replace(t, r"\s+", ""))
        garbled = let(n, lambda n: F.when(n < 3, "few words").when(~words.rlike(r"\S{5}"), "fragments").when(letters / dark < 0.4, "symbols").when((total / n < 2.5) & (n > 5), "garbled"))
        return F.when(F.length(t) < 20, "short").otherwise(garbled)

    return let(trim(text), lambda t: let(F.regexp_replace(t, r"[^\p{L}\p{N}\s]+", ""), lambda w: judged(t, w)))


def clean_lines(text: Column) -> Column:
    """Scanned text without one-character lines and lines of digits and signs only."""
    kept = F.filter(F.transform(F.split(text, "\n"), trim), lambda s: (F.length(s) != 1) & ((s == "") | ~s.rlike(r"^[\d\p{P}\p{S}\s]+$")))
    return trim(F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), " {2,}", " "))


def join_wraps(text: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"(?<!\n)\n(?!\n)", " "), " {2,}", " "))


def truncated(text: Column, limit: int) -> Column:
    """Text of at most about limit characters: to the last end of a sentence (and a closing mark), else to the next blank."""
    head = F.substring(text, 1, limit)
    end = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?…])", 1))
    more = F.substring(text, end + 1, F.lit(1)).rlike(r"""^["'»)\]]$""").cast("int")
    tail = F.substring(text, limit + 1, F.length(text))
    blank = F.length(F.regexp_extract(tail, r"(?s)^(\S*)", 1))
    cut = F.when(end > 0, F.regexp_replace(F.substring(text, F.lit(1), end + more), r"\s+$", "")).when(tail.rlike(r"\s"), F.regexp_replace(F.substring(text, F.lit(1), limit + blank), r"\s+$", "")).otherwise(text)
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def plain_word(t: Column) -> Column:
    """A word of Latin letters in lower case, or with a capital in front, that holds a vowel and no five consonants in a row: never garbage."""
    return t.rlike(rf"^(?=.*(?iu:{VOWEL}))(?!.*(?iu:{CONSONANT}{{5}}))[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+$")


def dirty_mix(t: Column) -> Column:
    return t.rlike(r"\d") & t.rlike(r"\p{L}") & ~t.rlike(r"^\d+\p{Ll}+$") & ~t.rlike(r"^\p{L}+-?\d+$")


def odd_casing(t: Column) -> Column:
    s = F.regexp_replace(t, r"[^\p{L}]", "")
    return (F.length(s) >= 2) & (s != F.lower(s)) & (s != F.upper(s)) & ~s.rlike(r"^(\p{Lu}\p{Ll}+)+$") & ~s.rlike(r"^\p{Ll}+(\p{Lu}\p{Ll}+)+$")


def odd_sounds(t: Column) -> Column:
    s = F.lower(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.length(s) >= 5) & (~s.rlike(VOWEL) | s.rlike(f"{CONSONANT}{{5}}"))
