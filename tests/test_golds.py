"""Printed lists, tables, norms, labels, samples and reports on literal rows."""

from pyspark.sql import functions as F

from glossa.functions import lemma as L
from glossa.operators import predict as R
from glossa.sources import goldlists as G


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def text(spark, s):
    return spark.createDataFrame([(i, x) for i, x in enumerate(s.split("\n"))], "ordinal int, value string")


def test_tabbed_lines(spark):
    s = "der Hund\tDer Hund bellt.\nSeite 3\tx\n12 Euro\tx\n• Schule\tx\nno tab\nHund\tWieder ein Hund.\ndas ist eine sehr lange linke Seite, die nicht passt\tx\n\tleer\ndie Katze, -n\tEine Katze."
    got = [tuple(r) for r in G.tabbed(text(spark, s), "A1", "list").orderBy("word").collect()]
    assert got == [("hund", "de", "A1", "list"), ("katze", "de", "A1", "list")]


def test_positional_rows(spark):
    items = [(1, 40, 700, "der"), (1, 60, 700, "Hund"), (1, 120, 699, "Der Hund bellt."), (1, 310, 700, "laufen,"), (1, 330, 700, "läuft"), (1, 420, 700, "Ich laufe."), (1, 40, 650, "klein"), (1, 120, 650, "klein geschrieben"), (1, 40, 600, "Inhalt"), (1, 120, 600, "Das"), (2, 40, 700, "Hund"), (2, 120, 700, "Noch ein Hund."), (2, 40, 500, " "), (2, 40, 400, "Katze"), (2, 120, 397, "Zu tief.")]
    df = spark.createDataFrame(items, "page int, x int, y int, text string").select("page", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "text")
    assert sorted(r.word for r in G.positional(df, "B1", "list").collect()) == ["hund", "laufen"]
    # Rows are told by the height of their first item, not by steps.
    steps = spark.createDataFrame([(1, 40.0, 10.0, "Haus"), (1, 120.0, 8.0, "Das Haus."), (1, 310.0, 6.0, "Tor"), (1, 420.0, 6.0, "Das Tor.")], "page int, x double, y double, text string")
    assert sorted(r.word for r in G.positional(steps, "B1", "list").collect()) == ["haus", "tor"]


def test_chapter_lists(spark):
    s = "Kapitel 1   Modul 2\n1a die Vorstellung, -en (Meine Vorstellung von Heimat ist …)      der/die Grafiker/in, -/-nen\nempfinden, empfand, hat empfunden   abenteuerlich\nder Tail of brackets)   Pate/Patin\ngeben, gibt (einen (guten) Kuss geben)   Die Vorstellung\n   Seite 12\n3 x1?"
    assert sorted(r.word for r in G.chapters(text(spark, s), "B2", "list").collect()) == ["abenteuerlich", "empfinden", "geben", "grafiker", "pate", "vorstellung"]


def test_labelled_cells(spark):
    s = "The Oxford 5000 B2\nabolish v. C1    acid n. B2, adj. C1    bow1 v., n. C1\nwrist n.B2   viable adj., C1   no label here\nacid n. A1   x n. B1"
    got = {r.word: r.cefr for r in G.labelled_cells(text(spark, s), "list").collect()}
    assert got == {"abolish": "C1", "acid": "B2", "bow": "C1", "wrist": "B2", "viable": "C1"}


def test_lemmas_and_labels(spark):
    rows = [("der Hund, die Hündin", "hund"), ("l'école", "l'école"), ("A", None), ("x2", None), ("", None), (None, None), ("sich freuen", "freuen"), ("Groß-Stadt", "groß-stadt"), ("die", "die"), ("y" * 41, None)]
    assert [r[0] for r in values(spark, [(a,) for a, _ in rows], "w string", L.lemma(F.col("w")))] == [b for _, b in rows]
    said = [("It is B2.", "B2"), ("C22 or A1", "A1"), ("none", None), ("b1", None), (None, None), ("A2/B1", "A2")]
    assert [r[0] for r in values(spark, [(a,) for a, _ in said], "w string", L.first_label(F.col("w")))] == [b for _, b in said]
    assert values(spark, [("“A1”", "'x'"), (None, '"y')], "a string, b string", L.clean_cell(F.col("a")), L.unquoted(F.col("b"))) == [("A1", "x"), ("", "y")]
    assert [r[0] for r in values(spark, [(0.2,), (1.5,), (2.49,), (9.0,)], "x double", L.whole_level(F.col("x")))] == [1, 2, 2, 6]


def test_norms(spark):
    rows = spark.createDataFrame([(1, " Dog ", "3.456"), (2, "dog", "2.005"), (3, "cat", "x"), (4, "", "1"), (5, "cow", "1e400"), (6, "ant", "NaN")], "n int, Word string, AoA string")
    assert [tuple(r) for r in G.norms(rows, "Word", "AoA", "n").collect()] == [("dog", 2.0)] or [tuple(r) for r in G.norms(rows, "Word", "AoA", "n").collect()] == [("dog", 2.01)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.12345, None), ("c", 2.0, 1)], "name string, x double, n int")
    assert G.markdown(df) == "| name | x | n |\n| --- | --- | --- |\n| a\\|b | 0.123 | — |\n| c | 2.000 | 1 |\n"
    G.write_json(df, str(tmp_path / "out"))
    assert sorted(r.name for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a|b", "c"]


def test_samples(spark):
    rows = [("en", f"w{i}", "A1" if i < 50 else "B2") for i in range(60)] + [("en", "w1", "C1"), ("de", "x", "Z9"), ("de", "y", "A1")]
    df = spark.createDataFrame(rows, "lang string, word string, cefr string")
    got = R.balanced_sample(df, 8, 42)
    one, two = (sorted(map(tuple, R.balanced_sample(df, 8, 42).collect())) for _ in range(2))
    assert one == two != sorted(map(tuple, R.balanced_sample(df, 8, 43).collect()))
    assert {tuple(r): n for *r, n in got.groupBy("lang", "cefr").count().collect()} == {("en", "A1"): 8, ("en", "B2"): 8, ("de", "A1"): 1}
    corpus = df.select("lang", F.col("word").alias("url"))
    assert [r.url for r in R.picked_entries(corpus.where("lang = 'en'"), "url", index=1).collect()] == ["w1"]
    some = R.picked_entries(corpus, "url", skip=2, limit=4).collect()
    assert len([r for r in some if r.lang == "en"]) == 4 == len({r["index"] for r in some if r.lang == "en"}) and min(r["index"] for r in some) >= 2
    assert R.picked_entries(corpus, "url", skip=60).count() == 1


def test_unsupported_languages_are_refused(spark):
    import pytest

    df = spark.createDataFrame([("de",), ("xx",)], "lang string")
    assert [r[0] for r in df.where("lang = 'de'").select(R.supported(F.col("lang"))).collect()] == ["de"]
    with pytest.raises(Exception, match="unsupported language: xx"):
        df.select(R.supported(F.col("lang"))).collect()
