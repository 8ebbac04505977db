"""Clean-up of an article's text as column expressions, in this order: blanks, crumbs, clocks, dates, calls to act, print heads, repeats, leads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.lex import let, trim

#: Months, and words before a date, that end an article.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Janeiro|Fevereiro|Mar[cç]o|Abril|Maio|Junho|Julho|Agosto|Setembro|Outubro|Novembro|Dezembro|Januar|Februar|M[aä]rz|Mai|Juni|Juli|Oktober|Dezember"
DATED = "Publisert|Oppdatert|Publicerad|Opdateret|Gepubliceerd|Pubblicato|Publicado|Opublikowano|Aktualizováno"
#: Lines that call to go on elsewhere; those of the second list may follow in a row.
CALLS = "Dziękujemy za przeczytanie artykułu!|Em destaque|Edição impressa|Ver mais|Opinião|Lees ook|Lue myös|Läs också|Les også"
CALLS_ON = r"Em destaque|Edição impressa|Ver mais|Opinião|\d{1,2}\s+de\s+\w+\s+de\s+\d{4}"
#: Characters of a crumb, of a lead that may repeat, of usable article text, and of the pages that are sent and read.
CRUMB, LEAD, LEAST, SENT, READ = 30, 20, 50, 60_000, 500_000

NAMED_DATE = rf"(?iu)\n+(?:\d{{1,2}}[.\s]+)?(?:{MONTHS})[\s.,]+\d{{1,4}}[\s.,]*\d{{0,4}}(?:[\s.:]+\d{{1,2}}(?:[:.]?\d{{2}})?)?\s*\z"
ISO_DATE = r"\n+\d{4}-\d{2}-\d{2}[\s.:]*\d{0,2}[:.]?\d{0,2}\s*\z"
NUMBER_DATE = rf"(?iu)(?:\n+(?:{DATED})\n+\d{{1,2}}\.\d{{2}}\.\d{{4}}[\s,]*(?:kl\.?\s*\d{{1,2}}[.:]\d{{2}})?)+\s*\z"
CALL = rf"(?iu)\n+(?:{CALLS})\s*(?:\n+(?:{CALLS_ON})\s*)*\z"
PRINTED = r"(?iu)\A(?:En utskrift från[^\n]*\n+(?:Artikelns ursprungsadress:[^\n]*\n+)?)"


def without_crumbs(text: Column) -> Column:
    """Paragraphs from the first that is long, empty, or has a mark of punctuation; the last one always stays."""

    def kept(parts: Column) -> Column:
        stays = F.transform(parts, lambda p: (p == "") | (F.length(p) >= CRUMB) | p.rlike("[.!?:,;]"))
        gone = let(F.array_position(stays, True), lambda first: F.when(first == 0, F.size(parts) - 1).otherwise(F.least(first.cast("int"), F.size(parts)) - 1))
        return F.array_join(F.slice(parts, gone + 1, F.size(parts)), "\n\n")

    return F.regexp_replace(let(F.split(text, r"\n+"), kept), r"\A\n+", "")


def once(line: Column) -> Column:
    """A line that says the same three times or twice in a row says it once."""

    def part(words: Column, n: int) -> tuple[Column, Column]:
        size = F.floor(F.size(words) / n).cast("int")
        first = F.slice(words, 1, F.greatest(size, F.lit(1)))
        same = (F.size(words) >= n) & (F.size(words) % n == 0)
        for i in range(1, n):
            same = same & (F.slice(words, size * i + 1, F.greatest(size, F.lit(1))) == first)
        return same, F.array_join(first, " ")

    def said(words: Column) -> Column:
        (three, a), (two, b) = part(words, 3), part(words, 2)
        return F.when(three, a).when(two, b).otherwise(line)

    return let(F.split(trim(line), r"\s+"), said)


def word_overlap(a: Column, b: Column) -> Column:
    """The share of a's distinct words that b has too."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    return let(words(a), lambda w: F.size(F.array_intersect(w, words(b))) / F.size(w))


def without_lead(text: Column) -> Column:
    """Without a first paragraph that the second begins with or has over 80 % of the words of."""

    def kept(parts: Column) -> Column:
        a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        repeated = (F.size(parts) >= 2) & (F.length(a) > LEAD) & (b.startswith(a) | (word_overlap(a, b) > 0.8))
        return F.when(repeated, F.array_join(F.slice(parts, 2, F.size(parts)), "\n\n")).otherwise(text)

    return let(F.split(text, r"\n\n+"), kept)


def steps(c: str) -> list[tuple[str, Column]]:
    """(name, expression of the column c) of each step."""
    x = F.col(c)
    swap = lambda p: F.regexp_replace(x, p, "")
    blank = F.regexp_replace(F.regexp_replace(trim(x), r"\n{3,}", "\n\n"), r"[^\S\n]+", " ")
    return [
        ("blanks", F.regexp_replace(blank, r"(?m)^ | $", "")), ("crumbs", without_crumbs(x)), ("clocks", swap(r"\A(?:\d{1,2}:\d{2}\n+)+")), ("named dates", swap(NAMED_DATE)), ("iso dates", swap(ISO_DATE)), ("number dates", swap(NUMBER_DATE)),
        ("calls", swap(CALL)), ("print heads", swap(PRINTED)), ("repeats", F.array_join(F.transform(F.split(x, "\n"), once), "\n")), ("lead", without_lead(x)), ("end", trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))),
    ]


def cleaned(df, column: str):
    """df with the text in column cleaned; null stays null, a blank text is empty."""
    for name in [n for n, _ in steps(column)]:
        df = df.withColumn(column, dict(steps(column))[name])
    return df


def sent(html: Column) -> Column:
    """As much of a page as a request may carry."""
    return F.substring(html, 1, SENT)


def read(html: Column) -> Column:
    """As much of a page as a reader of small memory takes."""
    return F.substring(html, 1, READ)


def parsed_answer(answer: Column, url: Column) -> Column:
    """(title, text, ok) of a model's answer TITLE: .. --- text: without the line the url is the title; not ok if it says that there is no article or is too short."""
    cut = F.instr(answer, "---")
    head = trim(F.regexp_replace(trim(F.substring(answer, F.lit(1), F.greatest(cut - 1, F.lit(0)))), r"(?i)^TITLE:\s*", ""))
    text = F.when(cut > 0, trim(F.substring(answer, cut + 3, F.length(answer)))).otherwise(trim(answer))
    title = F.when((cut > 0) & (head != ""), head).otherwise(url)
    return F.struct(title.alias("title"), text.alias("text"), F.coalesce(~answer.contains("NO_ARTICLE_CONTENT") & (F.length(text) >= LEAST), F.lit(False)).alias("ok"))
