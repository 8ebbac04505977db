"""Word lists with levels out of printed lists, tables and norms, and the sinks of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import lemma as L
from glossa.functions.lex import trim

#: Rows of a page: items whose heights differ by at most this from the row's first. Bands of head words and of their examples.
SAME_ROW, BANDS = 2, (((30, 100), (100, 300)), ((300, 400), (400, 700)))


def _gold(words: DataFrame, language: str, level: Column | str, source: str) -> DataFrame:
    cefr = F.lit(level) if isinstance(level, str) else level
    return words.where("word is not null").select("word", F.lit(language).alias("language"), cefr.alias("cefr"), F.lit(source).alias("source"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a text."""
    return spark.read.text(path)


def tabbed(rows: DataFrame, level: str, source: str, language: str = "de") -> DataFrame:
    """Lines (value) of a head word, a tab and an example: each lemma once."""
    left = trim(F.split("value", "\t")[0])
    good = F.col("value").contains("\t") & (left != "") & (F.length(left) <= 40) & ~left.rlike(L.REJECTED) & ~left.startswith("•")
    return _gold(rows.where(good).select(L.lemma(left).alias("word")), language, level, source).dropDuplicates(["word"])


def positional(items: DataFrame, level: str, source: str, language: str = "de") -> DataFrame:
    """Items (page, x, y, text) of pages in two pairs of columns: a head word counts if a sentence begins beside it.

    Heights are folded from the top, so each row keeps the height of its first item; a page's items make one array."""
    some = items.where(F.coalesce(trim(F.col("text")), F.lit("")) != "").select("page", F.round("x").cast("int").alias("x"), F.round("y").cast("int").alias("y"), "text")
    heights = some.groupBy("page").agg(F.sort_array(F.collect_set("y"), False).alias("ys"))
    pair = lambda y, top: F.struct(y.alias("y"), top.alias("top"))
    start = F.array().cast("array<struct<y: int, top: int>>")

    def join(acc: Column, y: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))["top"]
        return F.array_append(acc, pair(y, F.when(last - y <= SAME_ROW, last).otherwise(y)))

    rows = heights.select("page", F.explode(F.aggregate("ys", start, join)).alias("h")).select("page", F.col("h.y").alias("y"), "h.top")
    cells = some.join(rows, ["page", "y"]).groupBy("page", "top").agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("y"), "x", "text"))).alias("c"))

    def band(at: tuple[int, int]) -> Column:
        inside = F.filter("c", lambda c: (c["x"] >= at[0]) & (c["x"] < at[1]))
        return trim(F.regexp_replace(F.array_join(F.transform(inside, lambda c: c["text"]), " "), r"\s+", " "))

    heads = cells.select(F.explode(F.array(*(F.struct(band(a).alias("head"), band(b).alias("example")) for a, b in BANDS))).alias("e")).select("e.*")
    good = heads.where((F.col("head") != "") & (F.length("head") <= 50) & F.col("example").rlike("^[A-ZÄÖÜ0-9(]") & ~F.col("head").rlike(L.REJECTED))
    return _gold(good.select(L.lemma(F.col("head")).alias("word")), language, level, source).dropDuplicates(["word"])


def _cells(rows: DataFrame) -> DataFrame:
    """Cells of lines in columns that three blanks or more keep apart, with their line."""
    line = F.regexp_replace("value", r"\s+$", "")
    return rows.select(trim(line).alias("line"), F.explode(F.filter(F.transform(F.split(line, " {3,}"), trim), lambda c: c != "")).alias("cell"))


def chapters(rows: DataFrame, level: str, source: str, language: str = "de") -> DataFrame:
    """Lines (value) of chapter lists in columns; tails of broken brackets and headings are no entries."""
    cell = F.col("cell")
    closed = F.regexp_count(cell, F.lit(r"\)")) <= F.regexp_count(cell, F.lit(r"\("))
    good = _cells(rows).where(~F.col("line").rlike(L.SKIPPED) & ~cell.rlike(L.SKIPPED) & closed)
    # As an array, a lemma is made once: tests of a plain column are moved below it and would make it again.
    return _gold(good.select(F.explode(F.array(L.chapter_lemma(cell))).alias("word")), language, level, source).dropDuplicates(["word"])


def labelled_cells(rows: DataFrame, source: str, language: str = "en") -> DataFrame:
    """Lines (value, and ordinal, their order) of cells with a head word and labels: the lowest label; the first cell of a word counts."""
    line = F.regexp_replace("value", r"\s+$", "")
    cells = rows.select("ordinal", trim(line).alias("line"), F.posexplode(F.filter(F.transform(F.split(line, " {3,}"), trim), lambda c: c != "")).alias("at", "cell"))
    good = cells.where(~F.col("line").rlike(L.HEADER)).select("ordinal", "at", L.headword(F.col("cell")).alias("word"), L.lowest_label(F.col("cell")).alias("cefr")).where("word is not null and cefr is not null")
    first = good.groupBy("word").agg(F.min_by("cefr", F.struct("ordinal", "at")).alias("cefr"))
    return _gold(first, language, F.col("cefr"), source)


def frequency_list(table: DataFrame, word: str, levels: dict[str, str], language: str | Column, source: str) -> DataFrame:
    """A list of words with a rate for each level (levels: the columns of the rates): a word gets the first level at which it is frequent."""
    rates = {k: F.expr(f"try_cast(`{c}` as double)") for k, c in levels.items()}
    of = F.lit(language) if isinstance(language, str) else language
    rows = table.select(L.lemma(L.unquoted(F.col(word))).alias("word"), L.frequency_level(rates).alias("cefr"), of.alias("language"))
    return _gold(rows.where("cefr is not null"), F.col("language"), F.col("cefr"), source)


def norms(table: DataFrame, word: str, value: str, order: str) -> DataFrame:
    """word, value (two digits, half up) of a table of norms; the last row of a word counts."""
    rows = table.select(F.lower(trim(F.col(word))).alias("word"), F.expr(f"try_cast(`{value}` as double)").alias("v"), F.col(order).alias("o"))
    good = rows.where("word <> '' and v is not null and not isnan(v) and abs(v) < double('infinity')")
    return good.groupBy("word").agg(F.max_by("v", "o").alias("v")).select("word", (F.floor(F.col("v") * 100 + 0.5) / 100).alias("value"))


def senses(words: DataFrame, pos: DataFrame) -> DataFrame:
    """word, raw (the least level of its senses), pristine (that level is whole), level 1..6 of a list of words and one of their senses, joined on word_id."""
    met = words.select("word_id", F.lower("word").alias("word")).join(pos.select("word_id", F.expr("try_cast(level as double)").alias("raw")), "word_id")
    good = met.where(F.col("word").rlike("^[a-z][a-z'-]*$") & F.col("raw").between(1, 6))
    least = good.groupBy("word").agg(F.min("raw").alias("raw"))
    return least.select("word", "raw", (F.col("raw") == F.floor("raw")).alias("pristine"), L.whole_level(F.col("raw")).alias("level"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("error").json(path)


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A report (a small result: one row a figure) as a table in Markdown."""
    say = lambda x: "—" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    rows = [df.columns, ["---"] * len(df.columns), *([say(x) for x in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"
