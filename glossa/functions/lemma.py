"""Lemmas and labels out of cells of word lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.functions.lex import let, trim

#: First words that a list's lemma drops.
DROPPED = "der die das le la les l el los las lo i gli un una um uma o os as de het een en ett sich se si".split()
#: Kinds of quotes around cells.
QUOTES = "‘’“”'\"`«»‹›"
WORD = r"^\p{L}[\p{L}'\- ]*\p{L}?$"
#: Lines and cells of printed lists that hold no entry.
REJECTED = r"(?iu)^(seite|wortliste|inhalt|vorwort|zertifikat|goethe|isbn|©|herausgeber|gestaltung|--\s|\d+\s|abkürzungen|wortgruppen)"
SKIPPED = r"(?iu)^(Kapitelwortschatz|Kapitel\s+\d|Modul\s+\d|Auftakt|Porträt|Grammatik|Redemittel|Aspekte\s+neu|Seite\s+\d|Der\s+Wortschatz\s+von|B1plus)"
HEADER = r"(?iu)^(The Oxford 5000|©|The Oxford 3000)"
LABEL = r"\b(A1|A2|B1|B2|C1|C2)\b"
#: How often a word must occur in a million at a level to belong to it.
LEAST_RATE = 0.5


def _good(word: Column) -> Column:
    return F.when(word.rlike(WORD) & F.length(word).between(2, 40), word)


def without_article(word: Column) -> Column:
    tokens = F.filter(F.split(word, r"\s+"), lambda t: t != "")
    return F.when((F.size(tokens) > 1) & tokens[0].isin(*DROPPED), F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), " ")).otherwise(word)


def lemma(raw: Column) -> Column:
    """The first part of a cell in lower case without its article; null if it is no word of 2 to 40 characters."""
    return _good(without_article(F.lower(trim(F.split(raw, ",")[0]))))


def clean_cell(c: Column) -> Column:
    return trim(F.translate(F.coalesce(c, F.lit("")), QUOTES, ""))


def is_label(c: Column) -> Column:
    return F.upper(c).isin(*K.LEVELS)


def is_lemma(c: Column) -> Column:
    return F.length(c).between(2, 40) & c.rlike(r"^\p{L}[\p{L}'\- ()]*$")


def unquoted(c: Column) -> Column:
    """Without one quote at either end."""
    return trim(F.regexp_replace(c, r"""^["']|["']$""", ""))


def first_label(answer: Column) -> Column:
    """The first label that stands by itself in free text; null without one."""
    return F.nullif(F.regexp_extract(answer, LABEL, 1), F.lit(""))


def lowest_label(cell: Column) -> Column:
    found = F.regexp_extract_all(cell, F.lit(LABEL), 1)
    return F.array_min(found)


def frequency_level(rates: dict[str, Column]) -> Column:
    """The first level of the ladder at which a word is frequent enough."""
    return F.coalesce(*(F.when(rates[x] >= LEAST_RATE, x) for x in K.LEVELS if x in rates))


def whole_level(x: Column) -> Column:
    """1..6, the nearest (half up)."""
    return F.greatest(F.lit(1), F.least(F.lit(6), F.floor(x + 0.5))).cast("int")


def headword(cell: Column) -> Column:
    """The word at a cell's start (a digit behind it tells homonyms apart); null if it is none of 2 to 40 letters."""
    w = F.lower(F.regexp_extract(cell, r"^([a-zA-Z][a-zA-Z-]*)\d?(?=\s|$)", 1))
    return F.when(F.length(w).between(2, 40), w)


def chapter_lemma(cell: Column) -> Column:
    """The lemma of a cell of a chapter's list: no exercise number, no brackets, up to the first comma, the first of a pair by slashes."""
    s = F.regexp_replace(trim(cell), r"^\d+[a-z]?\s+", "")
    for _ in range(4):
        s = F.regexp_replace(s, r"\([^()]*\)", " ")
    s = let(trim(F.split(trim(F.regexp_replace(s, r"\s+", " ")), ",")[0]), _first_of_pair)
    s = F.regexp_replace(s, r"(\S*?)/\S*$", "$1")
    s = trim(F.regexp_replace(s, "[.;:!?\"'„“”]+$", ""))
    plain = r"^[A-Za-zÄÖÜäöüß][\wÄÖÜäöüß-]*( [A-Za-zÄÖÜäöüß][\wÄÖÜäöüß-]*)?$"
    s = let(s, lambda x: F.when(x.rlike(plain) & F.length(x).between(2, 50), F.lower(x)))
    return let(let(s, without_article), _good)


def _first_of_pair(s: Column) -> Column:
    both = r"^(der|die|das)/(?:der|die|das)\s+(.+)$"
    noun = trim(F.split(F.regexp_extract(s, both, 2), "/")[0])
    return F.when(s.rlike(both), F.concat(F.regexp_extract(s, both, 1), F.lit(" "), noun)).otherwise(s)
