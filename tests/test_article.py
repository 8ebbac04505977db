"""Pages and what their articles come to."""

from pyspark.sql import functions as F

from glossa.functions import article as R
from glossa.operators import ingest

BODY = "<p>The body of the article goes on here.</p>"
#: page, article
PAGES = [
    (f"<div><p>An introduction with words.</p><table class='x'><tr><td>Partei</td></tr></table>{BODY}</div>", "An introduction with words.\n\nThe body of the article goes on here."),
    (f"<div><p>Main text here.</p><figure><img src='a'/><figcaption>Photo: agency</figcaption></figure>{BODY}</div>", "Main text here.\n\nThe body of the article goes on here."),
    ("<p>It was founded in 2021<sup><a href='#c'>[1]</a></sup> in Eger<sup>2</sup>, x<sup>th</sup>.</p>", "It was founded in 2021 in Eger, xth."),
    (f"<p><svg><title>Play</title></svg></p>{BODY}", "The body of the article goes on here."),
    (f"<div class='top Breadcrumb-list'>Home, News</div>{BODY}<div class='navbox'>More, links.</div><div class='social-bar'>Tell, all.</div>", "The body of the article goes on here."),
    (f"<nav>Menu, items</nav>{BODY}<aside>Side, matter</aside>", "The body of the article goes on here."),
    ("<p>The course is open until day 23.</p><p>The course is open until day 23. Details follow.</p><p>Second, other.</p>", "The course is open until day 23. Details follow.\n\nSecond, other."),
    ("<p>O Regimento de Infantaria está a acolher o Curso, sempre</p><p>O Regimento de Infantaria está a acolher o Curso, sempre 2026. Mais detalhes.</p>", "O Regimento de Infantaria está a acolher o Curso, sempre 2026. Mais detalhes."),
    ("<div>DR</div><div>Atualidade</div><div>Aveiro</div><p>O curso abriu, enfim.</p>", "O curso abriu, enfim."),
    (f"{BODY}<p>Abril 16, 2026 . 08:45</p>", "The body of the article goes on here."), (f"{BODY}<p>2026-04-16 08:45</p>", "The body of the article goes on here."), (f"{BODY}<p>16 Juni 2026</p>", "The body of the article goes on here."),
    (f"{BODY}<p>Publisert</p><p>15.04.2026, kl. 23.49</p><p>Oppdatert</p><p>16.04.2026, kl. 09.24</p>", "The body of the article goes on here."),
    (f"{BODY}<p>Dziękujemy za przeczytanie artykułu!</p>", "The body of the article goes on here."), (f"{BODY}<p>Em destaque</p><p>Edição impressa</p><p>16 de Abril de 2026</p><p>Ver mais</p><p>Opinião</p>", "The body of the article goes on here."),
    ("<div>00:00</div><div>01:20</div>" + BODY, "The body of the article goes on here."),
    ("<p>En utskrift från Dagens Nyheter, 2026-04-16 10:59</p><p>Artikelns ursprungsadress: https://www.dn.se/a/</p>" + BODY, "The body of the article goes on here."),
    ("<p>Opening, words.</p><p>Société Société Société</p><p>Faits divers Faits divers</p>" + BODY, "Opening, words.\n\nSociété\n\nFaits divers\n\nThe body of the article goes on here."),
    ("<div>One block, first.</div>\n\n\n<div>Second block, too.</div><li>An item.</li>a, b<br>c, d", "One block, first.\n\nSecond block, too.\n\nAn item.\n\na, b\n\nc, d"),
    (f"<p>Outside, all.</p><article>{BODY}</article>", "The body of the article goes on here."),
    ("", ""), ("   ", ""), ("<div>   </div>", ""), (None, None), ("<p>Unclosed, here", "Unclosed, here"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "i int, html string")
    got = {r.i: r.article for r in ingest.article(df).collect()}
    assert {i: (w, got[i]) for i, (_, w) in enumerate(PAGES) if got[i] != w} == {}


def test_answers_about_pages(spark):
    body = "x" * 50
    rows = [("TITLE: A b\n---\n" + body, "u"), (body, "u"), ("title:  \n---" + body, "u"), ("NO_ARTICLE_CONTENT", "u"), ("TITLE: a\n---\nshort", "u"), (None, "u")]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "a string, u string").select(R.parsed_answer(F.col("a"), F.col("u"))).collect()]
    assert got == [("A b", body, True), ("u", body, True), ("u", body, True), ("u", "NO_ARTICLE_CONTENT", False), ("a", "short", False), ("u", None, False)]
    assert len(spark.createDataFrame([("y" * 70_000,)], "h string").select(R.sent(F.col("h"))).first()[0]) == 60_000


def test_scanned_texts(spark):
    known = spark.createDataFrame([("readable",), ("lines",), ("these",)], "word string")
    docs = spark.createDataFrame([(1, "These are readable\nlines of text.\n7\nxX3bq zzzkrtwq\n\nMore readable lines"), (2, "no"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.reason, r.text) for r in ingest.scanned(docs, known).collect()}
    assert got == {1: (None, "These are readable lines of text.\n\nMore readable lines"), 2: ("short", None), 3: (None, None)}


def test_garbage_lines(spark):
    known = spark.createDataFrame([("readable",), ("line",)], "word string")
    rows = [(1, "plain words here\nxX3bq zzzkrtwq\nreadable xX3bq zzzkrtwq\nABCDEF\n12-ab9c\nABCDEF Line\n\nкириллица bcdfghk"), (2, "xX3bq\nzzzkrtwq"), (3, None), (4, ""), (5, "a\nb\n(zzzkrtwq)\nREADABLE\nab7cd, here")]
    got = {r.doc_id: r.text for r in ingest.garbage_free(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {1: "plain words here\nreadable xX3bq zzzkrtwq\nABCDEF Line\n", 2: rows[1][1], 3: None, 4: "", 5: "a\nb\nREADABLE"}
