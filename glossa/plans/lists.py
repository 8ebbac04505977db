"""Queries that set the vocabulary in the forms of printed lists, norms and reports, and read these again."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import article as R
from glossa.functions import constants as K
from glossa.functions import lemma as L
from glossa.operators import adapters as A
from glossa.operators import predict as P
from glossa.operators import store as S
from glossa.operators.adapters import oracle
from glossa.plans.base import query
from glossa.sources import goldlists as G
from glossa.sources.readers import scratch

_REJECTED, _SKIPPED = (p.replace("(?iu)", "(?i)").replace("'", "''") for p in (L.REJECTED, L.SKIPPED))
_WORD = r"original, '^\p{L}[\p{L}''\- ]*\p{L}?$'"


def _cards(spark, sf, levels=False):
    return A.vocabulary(spark, sf, levels).select("content_id", "pos", "original", "level")


@query(oracle("vocabulary", rf"SELECT DISTINCT original AS word, 'de' AS language, 'A1' AS cefr, 'list' AS source FROM vocabulary WHERE pos % 4 <> 1 AND pos % 4 <> 2 AND length(original) BETWEEN 2 AND 36 AND NOT (pos % 4 = 0 AND regexp_matches(original, '{_REJECTED}')) AND regexp_matches({_WORD})"))
def tabbed_list(spark, sf):
    """Lines of a head word, a tab and an example, written and read; some lack the tab, some are points of a list."""
    kind = F.col("pos") % 4
    head = F.when(kind == 2, F.concat(F.lit("• "), F.col("original"))).when(kind == 3, F.concat(F.lit("das "), F.col("original"), F.lit(", -n"))).otherwise(F.col("original"))
    path = scratch(spark, "tabbed")
    _cards(spark, sf).where("length(original) <= 36").select(F.when(kind == 1, head).otherwise(F.concat(head, F.lit("\tEin Satz."))).alias("value")).write.text(path)
    return G.tabbed(G.lines(spark, path), "A1", "list")


@query(oracle("vocabulary", rf"SELECT DISTINCT original AS word, 'de' AS language, 'B1' AS cefr, 'list' AS source FROM vocabulary WHERE pos % 3 <> 0 AND length(original) BETWEEN 2 AND 40 AND NOT regexp_matches(original, '{_REJECTED}') AND regexp_matches({_WORD})"))
def positional_list(spark, sf):
    """Items of pages in two pairs of columns: a head word, and beside it, a little lower, an example; some examples begin no sentence."""
    row, left = F.pmod("pos", F.lit(50)), F.floor(F.col("pos") / 25) % 2 == 0
    page, y = F.col("content_id") * 1_000_000 + F.floor(F.col("pos") / 50), (F.lit(1000) - 20 * row).cast("double")
    item = lambda x, y, text: F.struct(x.cast("double").alias("x"), y.alias("y"), text.alias("text"))
    example = F.when(F.col("pos") % 3 == 0, "ein Satz.").otherwise("Ein Satz.")
    items = F.array(item(F.when(left, 40).otherwise(310), y, F.col("original")), item(F.when(left, 120).otherwise(420), y - 2, example))
    return G.positional(_cards(spark, sf).select(page.alias("page"), F.explode(items).alias("i")).select("page", "i.*"), "B1", "list")


@query(oracle("vocabulary", rf"SELECT DISTINCT original AS word, 'de' AS language, 'B2' AS cefr, 'list' AS source FROM vocabulary WHERE pos % 5 <> 0 AND regexp_matches(original, '^[a-zäöüß]+$') AND length(original) BETWEEN 2 AND 40"))
def chapter_list(spark, sf):
    """Lines of cells in columns: a number and a noun with brackets, a pair by a slash; a fifth has a bracket that isn't opened."""
    cell = F.when(F.col("pos") % 5 == 0, F.concat(F.col("original"), F.lit(" von hier)"))).when(F.col("pos") % 5 == 1, F.concat(F.lit("1a der/die "), F.col("original"), F.lit("/in (ein (guter) Satz), -n"))).otherwise(F.concat(F.col("original"), F.lit(" (so)")))
    some = _cards(spark, sf).where(F.col("original").rlike("^[a-zäöüß]+$"))
    return G.chapters(some.select(F.concat(F.lit("Seite x     "), cell, F.lit("      Kapitel 3")).alias("value")), "B2", "list").where("word <> 'seite x'")


@query(oracle("vocabulary", "SELECT original AS word, min_by(cefr, (ordinal, original)) AS cefr FROM (SELECT original, content_id * 100000 + pos AS ordinal, CASE WHEN pos % 2 = 0 AND level > 'B1' THEN 'B1' ELSE level END AS cefr FROM vocabulary WHERE regexp_matches(original, '^[a-z]{2,40}$')) GROUP BY original"))
def labelled_list(spark, sf):
    """Cells of a head word and its labels, of which the lowest counts; the first cell of a word wins."""
    some = _cards(spark, sf, levels=True).where(F.col("original").rlike("^[a-z]{2,40}$"))
    cell = F.concat(F.col("original"), F.when(F.length("original") == 5, "2").otherwise(""), F.lit(" n. "), F.col("level"), F.when(F.col("pos") % 2 == 0, ", adj. B1").otherwise(""))
    rows = some.select((F.col("content_id") * 100_000 + F.col("pos")).alias("ordinal"), F.concat(F.lit("no label      "), cell).alias("value"))
    return G.labelled_cells(rows, "list").select("word", "cefr")


@query(oracle("vocabulary", "SELECT original AS word, max_by(floor((length(original) + pos % 100 / 8) * 100 + 0.5) / 100, content_id * 100000 + pos) AS value FROM (SELECT lower(trim(original)) AS original, content_id, pos FROM vocabulary WHERE pos % 9 <> 0) GROUP BY 1"))
def norms_table(spark, sf):
    """A table of norms, written and read: the last row of a word counts, and what is no number is left out."""
    path = scratch(spark, "norms")
    value = F.when(F.col("pos") % 9 == 0, "n/a").otherwise((F.length("original") + F.col("pos") % 100 / 8).cast("string"))
    _cards(spark, sf).select(F.concat(F.lit(" "), F.col("original")).alias("Word"), value.alias("AoA"), (F.col("content_id") * 100_000 + F.col("pos")).alias("row")).write.option("header", True).csv(path)
    return G.norms(spark.read.schema("Word string, AoA string, row long").option("header", True).csv(path), "Word", "AoA", "row")


@query(oracle("vocabulary", "SELECT row_number() OVER (ORDER BY lang) + 1 AS line, '| ' || lang || ' | ' || count(*) || ' | ' || format('{:.3f}', avg(length(original))) || ' |' AS text FROM vocabulary GROUP BY lang UNION ALL SELECT 0, '| lang | n | mean |' UNION ALL SELECT 1, '| --- | --- | --- |'"))
def markdown_report(spark, sf):
    """A report of a row per language as the lines of a table in Markdown."""
    figures = A.vocabulary(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.length("original")).alias("mean")).orderBy("lang")
    lines = G.markdown(figures).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


@query(f"SELECT doc_id, length(html[1:{R.SENT}]) AS sent, length(html[1:{R.READ}]) AS read, sha256(html[1:{R.SENT}]) AS sent_sha256 FROM (SELECT doc_id, repeat(text, 40) AS html FROM documents)")
def capped_pages(spark, sf):
    """How much of a large page goes into a request, and how much of it is read."""
    d = A.table(spark, sf, "documents").select("doc_id", F.repeat("text", F.lit(40)).alias("html"))
    return d.select("doc_id", F.length(R.sent(F.col("html"))).cast("long").alias("sent"), F.length(R.read(F.col("html"))).cast("long").alias("read"), F.sha2(R.sent(F.col("html")).cast("binary"), 256).alias("sent_sha256"))


@query(oracle("vocabulary", "SELECT id, CASE WHEN pos % 2 = 0 THEN NULL ELSE user_added END AS user_added, CASE WHEN pos % 2 = 1 THEN reverse(original) END AS source_forms FROM vocabulary"))
def migrated(spark, sf):
    """An old table without two columns takes rows that have them: old rows get nulls."""
    v = A.vocabulary(spark, sf).select("id", "pos", "user_added", F.reverse("original").alias("source_forms"))
    return S.upsert(v.where("pos % 2 = 0").select("id", "pos"), v.where("pos % 2 = 1"), "id", "pos").select("id", "user_added", "source_forms")


@query("SELECT doc_id, lang FROM documents WHERE list_contains(['" + "', '".join(K.LANGUAGES) + "'], lang)")
def supported_languages(spark, sf):
    """Languages of documents, each of them asserted to have a table; those without are left out before."""
    return A.table(spark, sf, "documents").where(F.col("lang").isin(*K.LANGUAGES)).select("doc_id", P.supported(F.col("lang")).alias("lang"))
