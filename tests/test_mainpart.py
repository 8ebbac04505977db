"""Main parts of pages without an article element, against what a reader would take."""

from pyspark.sql import functions as F

from glossa.operators import mainpart

ONE = "The river had risen in the night, and by morning the lower road was gone, so the school stayed closed."
TWO = "People carried their boxes up the hill, two streets at a time, while the fire brigade counted pumps and sandbags."
MENU = "<ul class='menu'>" + "".join(f"<li><a href='/{w}'>{w}, and more of it here</a></li>" for w in ("Home", "News", "Sport", "Weather", "Culture")) + "</ul>"
TALK = "".join(f"<div class='comment'><p>I was there too, and I must say, it was loud, wet and cold, number {i}.</p></div>" for i in range(6))
BOTH = f"{ONE}\n\n{TWO}"
#: page, main text
PAGES = [
    (f"<body>{MENU}<div id='content'><p>{ONE}</p><p>{TWO}</p></div><div id='comments'>{TALK}</div><footer><p>All rights, as ever, are reserved, in every country.</p></footer></body>", BOTH),
    (f"<body><div class='teaser'><p><a href='/x'>Read this, and that, and all of the others, now, today.</a></p></div><section><div><p>{ONE}<p>{TWO}</div></section></body>", BOTH),
    (f"<table><tr><td>{MENU}</td><tr><td>side</table><div>{ONE}<br><br>{TWO}</div>", BOTH),
    (f"<div><div class='story-text'><p>{ONE}</p></div><div class='story-text'><p>{TWO}</p></div></div>{MENU}", BOTH),
    (f"<main><p>{ONE} <a href='/y'>More, on rivers.</a></p><p>{TWO}</p><div class='share-bar'><p>Tell your friends, family, and the mayor.</p></div></main>", f"{ONE} More, on rivers.\n\n{TWO}"),
    (f"<article><h1>Flood</h1><p>{ONE}</p><p>{TWO}</p></article><div class='related'><p>Ten more floods, of ten more years, in ten more towns, for you.</p></div>", BOTH),
    (f"<div>{MENU}</div>", None), ("<div><p>Too short, alas, for anything.</p></div>", None), ("", None), (None, None), ("<p></p></div></p><<>", None),
    ("<div><p>" + "a.b(c); {d: e} #f { g.h(i); } " * 12 + "</p></div>", None),
    (f"<div><p>{ONE}</p><p>{TWO}", BOTH),
    ("<div>" * 3000 + f"<p>{ONE}</p><p>{TWO}</p>" + "</div>" * 3000, BOTH),
]


def test_main_parts(spark):
    df = spark.createDataFrame([(i, p, "x") for i, (p, _) in enumerate(PAGES)], "i int, html string, article string")
    got = {r.i: r.article for r in mainpart.main_articles(df).collect()}
    assert {i: (w, got[i]) for i, (_, w) in enumerate(PAGES) if (got[i] or "").removeprefix("Flood\n\n") != (w or "")} == {}
    assert mainpart.main_articles(df.limit(0)).count() == 0


def test_a_long_page_is_read_whole(spark):
    rows = [(0, "<div id='content'>" + f"<p>{ONE}</p><p>{TWO}</p>" * 4000 + "</div>" + MENU)]
    got = mainpart.main_articles(spark.createDataFrame(rows, "i int, html string")).select(F.length("article").alias("n")).first().n
    assert got > 4000 * (len(ONE) + len(TWO))
