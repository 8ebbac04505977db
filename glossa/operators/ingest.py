"""Web pages and scanned text: article bodies, garbage lines, chunks, languages, routing."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions import article as article_text
from glossa.functions import constants as K
from glossa.functions import text as X
from glossa.functions.lex import let

#: Elements that are no article text, those whose text ends a paragraph, and parts of class names of side matter.
DROPPED = {"table", "figure", "figcaption", "svg", "nav", "aside"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "blockquote", "pre", "section", "article", "header", "footer", "dt", "dd"}
NOISE = ("infobox", "sidebar", "breadcrumb", "byline", "metadata", "share", "social", "navbox", "catlinks", "mw-editsection")
#: Places of a profile of trigrams, letters that a text must have to be judged, and the distance beyond which it is none of the languages.
PROFILE, LEAST_LETTERS, FURTHEST = 300, 10, 0.8
#: Lines with other than blanks that a text must have to lose some.
LEAST_LINES = 3
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_NUMBER = re.compile(r"\s*\[?\d+\]?\s*")
_SENTENCE = re.compile(r"[.!?]\s+(?=\p{Lu})")


class _Text(HTMLParser):
    """The text of a page without side matter; two line ends behind each block. The text of an element sup is kept apart until it ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.notes, self.within, self.inside = [], [], [], [], []

    def handle_starttag(self, tag, attrs):
        name = next((v or "" for k, v in attrs if k == "class"), "").lower()
        bad = tag in DROPPED or any(n in name for n in NOISE)
        if tag == "article" and not bad and not (self.stack and self.stack[-1][1]):
            self.within.append(len(self.out))
        if tag in _VOID:
            if tag == "br" and not bad and not (self.stack and self.stack[-1][1]):
                self.out.append("\n\n")
            return
        self.stack.append((tag, bad or bool(self.stack and self.stack[-1][1])))
        if tag == "sup":
            self.notes.append(len(self.out))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        while at is not None and len(self.stack) > at:
            name, bad = self.stack.pop()
            if name == "sup" and _NUMBER.fullmatch("".join(self.out[(start := self.notes.pop()) :])):
                del self.out[start:]
            if name in BLOCKS and not bad:
                self.out.append("\n\n")
            if name == "article" and not bad and self.within:
                self.inside.append("".join(self.out[self.within.pop() :]))

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][1]):
            self.out.append(data)


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    """The text of a page (or of its article elements, if it has any) without tables, figures, side matter and numbers of notes."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        p = _Text()
        p.feed(s)
        p.close()
        for tag, _ in reversed(p.stack):
            p.handle_endtag(tag)
        return "".join(p.inside or p.out)

    return html.map(one)


def article(pages: DataFrame, html: str = "html", name: str = "article") -> DataFrame:
    """pages with the cleaned text of each whole page."""
    return article_text.cleaned(pages.withColumn(name, page_text(X.strip_noise(F.col(html)))), name)


def scanned(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, reason, text: scanned texts in the order of the steps: those that are no usable text keep the reason and lose the text, the others lose stray lines, then garbage lines, then line wraps."""
    judged = docs.select(key, F.col(text).alias("_t"), X.ocr_reason(F.col(text)).alias("reason")).select(key, "reason", F.when(F.col("reason").isNull(), X.clean_lines(F.col("_t"))).alias("text"))
    gone = _garbage(judged, known, key, "text", LEAST_LINES)
    return judged.join(gone, F.col(key) == F.col("_k"), "left").select(key, "reason", X.join_wraps(_without(F.col("text"))).alias("text"))


def chunk(max_chars: int):
    """A function of a column: its texts in chunks of at most max_chars, cut behind the first end of a sentence in the last 500 characters."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            if t is None or len(t) <= max_chars:
                return None if t is None else [t]
            out = []
            while t:
                if len(t) <= max_chars:
                    out.append(t)
                    break
                start = max(0, max_chars - 500)
                m = _SENTENCE.search(t[start:max_chars])
                cut = start + m.start() + 1 if m else max_chars
                out.append(t[:cut].strip())
                t = t[cut:].strip()
            return out

        return texts.map(one)

    return run


def garbage_free(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", least_lines: int = LEAST_LINES) -> DataFrame:
    """key, text without lines that hold a garbage token and no known one (known: word); texts of few lines stay whole.

    Whether a line may hold garbage is told on the line itself; only the tokens of such lines meet the word list, and only
    the places of lines that go come back to the texts."""
    gone = _garbage(docs, known, key, text, least_lines)
    return docs.select(key, text).join(gone, F.col(key) == F.col("_k"), "left").select(key, _without(F.col(text)).alias("text"))


def _without(text: Column) -> Column:
    """text without the lines whose places are in _gone."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda s, i: ~F.array_contains("_gone", i)), "\n")
    return F.when(F.col("_gone").isNull(), text).otherwise(kept)


def _garbage(docs: DataFrame, known: DataFrame, key: str, text: str, least_lines: int) -> DataFrame:
    """_k, _gone: the places of each text's lines that are to go. Outer explodes make their arrays once; inner ones would make them again, to filter by their sizes."""
    strip = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    t, inside = F.col("t"), F.col("in_list")
    odd = lambda t: X.odd_casing(t) | ((F.length(t) >= 5) & (t == F.upper(t))) | X.odd_sounds(t)
    latin = lambda t: t.rlike(r"\p{IsLatin}")
    judged = let(F.split(text, "\n"), lambda p: F.when(F.size(F.filter(p, lambda s: s.rlike(r"\S"))) >= least_lines, p))
    lines = docs.select(key, F.posexplode_outer(judged).alias("line", "s")).where("line is not null")
    toks = F.filter(F.transform(F.split("s", r"\s+"), lambda x: F.regexp_replace(x, strip, "")), lambda x: F.length(x) >= 4)
    some = let(toks, lambda ts: F.when(F.exists(ts, lambda x: ~X.plain_word(x) & latin(x) & (X.dirty_mix(x) | odd(x))), ts))
    toks = lines.select(key, "line", F.explode_outer(some).alias("t")).where("t is not null")
    met = toks.join(known.select(F.col("word").alias("w")).distinct(), F.lower("t") == F.col("w"), "left").withColumn("in_list", F.col("w").isNotNull())
    bad = latin(t) & (X.dirty_mix(t) | (~inside & odd(t)))
    gone = met.groupBy(key, "line").agg((F.max(bad.cast("int")) == 1).alias("bad"), F.bool_or(inside).alias("known")).where("bad and not known")
    return gone.groupBy(F.col(key).alias("_k")).agg(F.collect_set("line").alias("_gone"))


def route(url: Column, image: Column, text: Column) -> Column:
    """Where shared input goes: link, image or text, in this order; a text that is a web address is a link."""
    return F.when(url.isNotNull(), "link").when(image.isNotNull(), "image").when(text.rlike(r"^\s*https?://\S+\s*$"), "link").when(text.isNotNull(), "text").otherwise("none")


def _letters(text: Column) -> Column:
    """The letters of a text, in lower case, with one blank in place of all else, and around it."""
    return F.concat(F.lit(" "), F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))), F.lit(" "))


def _grams(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """keep, gram: each three characters in a row of the letters of a text (an inner explode would have them made twice)."""
    return docs.select(*keep, F.explode_outer(F.regexp_extract_all(_letters(text), F.lit("(?=(.{3}))"), 1)).alias("gram")).where("gram is not null")


@F.pandas_udf(T.ArrayType(T.StringType()))
def ranked_grams(letters: pd.Series) -> pd.Series:
    """The distinct trigrams of short texts, the most frequent first (equal counts: by the trigram)."""

    def one(s: str | None) -> list[str] | None:
        if s is None:
            return None
        n = Counter(s[i : i + 3] for i in range(len(s) - 2))
        return sorted(n, key=lambda g: (-n[g], g))

    return letters.map(one)


def trigram_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = PROFILE) -> DataFrame:
    """lang, gram, place: the most frequent trigrams of each language, over whole texts, by their places from 1 (equal counts: by the trigram)."""
    n = _grams(docs.where(F.col(lang).isNotNull()), F.col(text), lang).groupBy(lang, "gram").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.expr(f"row_number() over (partition by `{lang}` order by n desc, gram)")).where(F.col("place") <= most).select(lang, "gram", "place")


def detect_language(docs: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = PROFILE, least: int = LEAST_LETTERS, furthest: float = FURTHEST) -> DataFrame:
    """key, detected, distance of each row: the language whose profile is nearest to the trigrams of the first 500 characters.

    The text's trigrams are ranked as the profiles' are; each is off by the difference of its places, or by most where the profile lacks
    it; the distance is the mean of that as a share of most. Null for fewer than least letters, and where the nearest profile
    is further than furthest or no trigram is in any; equal distances go to the first language by name. Rows that repeat a key with equal texts are one.
    A text's trigrams are ranked in its row and meet the profiles (at most `most` rows a language) there, so one row per text and language is shuffled."""
    some = F.substring(text, 1, 500)
    rows = docs.where(F.length(F.regexp_replace(some, r"[^\p{L}]", "")) >= least).select(key, some.alias("_s"), F.xxhash64(key, some).alias("_row"), F.monotonically_increasing_id().alias("_id"))
    ranked = rows.select("_id", "_row", ranked_grams(_letters(F.col("_s"))).alias("_g"))
    placed = ranked.select("_id", "_row", F.size("_g").alias("_all"), F.posexplode_outer("_g").alias("_at", "gram")).where("gram is not null").withColumn("_at", F.col("_at") + 1)
    off = placed.join(F.broadcast(profiles), "gram").groupBy("_id", "_row", lang, "_all").agg(F.sum(F.least(F.lit(most), F.abs(F.col("_at") - F.col("place")))).alias("off"), F.count("*").alias("met"))
    far = off.select("_row", F.struct(((F.col("off") + (F.col("_all") - F.col("met")) * most) / (F.col("_all") * most)).alias("distance"), F.col(lang).alias("l")).alias("b"))
    best = far.groupBy("_row").agg(F.min("b").alias("b")).select(F.col("_row").alias("_r"), "b")
    met = docs.select(key, F.xxhash64(key, some).alias("_row")).join(best, F.col("_row") == F.col("_r"), "left")
    near = F.col("b.distance") <= furthest
    return met.select(key, F.when(near, F.col("b.l")).alias("detected"), F.when(near, F.col("b.distance")).alias("distance"))


def two_letters(code: Column) -> Column:
    """A language in use by its code of three or two letters; null for others."""
    low = F.lower(F.trim(code))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in K.THREE_LETTERS.items() for x in kv)), low), F.when(low.isin(*K.LANGUAGES), low))


def mismatched(rows: DataFrame, detected: str, wanted: str) -> DataFrame:
    """The rows that are to be rejected: a language was detected, and it is another."""
    return rows.where(F.col(detected).isNotNull() & (F.col(detected) != F.col(wanted)))
