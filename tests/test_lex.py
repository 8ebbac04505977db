from pyspark.sql import functions as F

from glossa.functions import lex, model, text
from glossa.operators import extract, ingest, store
from glossa.streaming.state import sliding_limiter


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_normalisation(spark):
    rows = [("der Hund, die Hündin",), ("l'école",), ("The House",), ("to go",)]
    got = values(spark, rows, "o string", lex.sort_key(F.col("o")), lex.lookup_key(F.col("o")))
    assert got == [("hund", "hund"), ("l'école", "école"), ("house", "house"), ("go", "go")]
    terms = values(spark, [("der große Hund, die Hündin",)], "o string", lex.search_terms(F.col("o")))
    assert terms[0][0] == ["große Hund", "große", "Hund", "Hündin"]


def test_filters(spark):
    o, t, lang = F.col("o"), F.col("t"), F.col("l")
    rows = [("NASA", "noun", "en"), ("die EU", "noun", "de"), ("Paris", "noun", "fr"), ("Hund", "noun", "de"), ("le grand chien", "noun", "fr"), ("parle", "verb", "fr"), ("parler", "verb", "fr"), ("to run", "verb", "en"), (None, "noun", "en")]
    got = values(spark, rows, "o string, t string, l string", lex.is_abbreviation(o), lex.is_proper_noun(o, lang), lex.is_multi_word_noun(o, t), lex.is_not_infinitive(o, t, lang))
    assert [r[0] for r in got] == [True, True] + [False] * 7
    assert [r[1] for r in got] == [True, False, True] + [False] * 6
    assert [r[2] for r in got] == [False] * 4 + [True] + [False] * 4
    assert [r[3] for r in got] == [False] * 5 + [True] + [False] * 3


def test_pairs_and_german(spark):
    got = values(spark, [("rot, rote", "adjective", "de"), ("a, A", "noun", "en"), ("x, y, z", "noun", "en")], "o string, t string, l string", lex.collapse_adjective(F.col("o"), F.col("t"), F.col("l")), lex.collapse_identical(F.col("o")))
    assert got == [("rot", "rot, rote"), ("a, A", "a"), ("x, y, z", "x, y, z")]
    assert values(spark, [("der hund, die große katze",)], "o string", lex.capitalise_german(F.col("o"), F.lit("noun"))) == [("der Hund, die große Katze",)]


def test_answers_and_counts(spark):
    rows = [("Hund", "der Hund"), ("hunt", "der Hund"), ("le chien", "le chien"), ("maisn", "maison"), ("x", "y"), ("", "y")]
    assert [r[0] for r in values(spark, rows, "a string, b string", lex.match_answer(F.col("a"), F.col("b")))] == ["tolerant", "none", "exact", "tolerant", "none", "none"]
    got = values(spark, [(999.0,), (1200.0,), (100000.0,), (1200000.0,), (-1.0,), (1000.0,)], "n double", lex.format_count(F.col("n")))
    assert [r[0] for r in got] == ["999", "1.2k", "100k", "1.2M", "0", "1k"]


def test_answers_with_parts_articles_and_marks(spark):
    rows = [
        ("Hund", "der Hund, die Hündin", "tolerant"), ("die Hündin", "der Hund, die Hündin", "tolerant"), ("der Hund, die Hündin", "der Hund, die Hündin", "exact"), ("l'école", "école", "tolerant"), ("école", "l'école", "tolerant"), ("ECOLE", "école", "tolerant"),
        ("e\u0301cole", "école", "exact"), ("der Ba\u0308r", "Bär", "tolerant"), ("maison", "la maisons", "tolerant"), ("chat", "chats", "none"), ("katze", "die Katzen", "tolerant"), ("abcde", "abxye", "none"), ("  der   Hund ", "Der Hund", "exact"), ("un", "un chat", "none"), ("", "x", "none"),
    ]
    got = values(spark, [r[:2] for r in rows], "a string, b string", lex.match_answer(F.col("a"), F.col("b")))
    assert [(r[:2], g) for r, (g,) in zip(rows, got) if r[2] != g] == []
    assert store.searched(spark.createDataFrame([("Tion", "x"), ("y", "z")], "original string, translation string"), " ").count() == 2


def test_model(spark):
    z, a = F.col("z"), F.col("a")
    got = values(spark, [(7.0, 2.0), (0.0, 18.0), (None, None)], "z double, a double", model.level(model.difficulty(z, a)), model.confidence(z, a))
    assert got == [("A1", "high"), ("C2", "high"), ("B2", "low")]
    due = values(spark, [(1, None), (1, 0), (5, 0), (2, 10 * 86_400_000)], "b int, t long", model.due(F.col("b"), F.col("t"), 11 * 86_400_000))
    assert [r[0] for r in due] == [True, True, False, False]


def test_text(spark):
    t = F.col("t")
    got = values(spark, [("One. Two! Three",), ("abc def ghi",), ("short",)], "t string", text.truncated(t, 9), text.join_wraps(t))
    assert [r[0] for r in got] == ["One. Two!", "abc def ghi", "short"]
    assert values(spark, [("a\nb\n\nc  d",)], "t string", text.join_wraps(t)) == [("a b\n\nc d",)]
    assert values(spark, [("x",), ("This is readable text, really.",), ("1234 5678 9012 34567 89 1234",)], "t string", text.ocr_reason(t)) == [("short",), (None,), ("symbols",)]
    parts = values(spark, [("x" * 50 + ". Élan " + "y" * 60,), ("x" * 50 + ". ārs " + "y" * 60,), ("x" * 50 + "! Ωmega " + "y" * 60,), ("x" * 50 + "? Жук " + "y" * 60,), (None,)], "t string", ingest.chunk(100)("t"))
    assert [p and len(p[0]) for (p,) in parts] == [51, 100, 51, 51, None]
    long = "Aa bb. " * 100
    chunks = values(spark, [(long,)], "t string", ingest.chunk(200)("t"))[0][0]
    assert all(len(c) <= 200 for c in chunks) and "".join(chunks).replace(" ", "") == long.replace(" ", "")


def test_answers_are_parsed_and_repaired(spark):
    rows = [(1, 'Sure: [{"original": "a", "translation": "b"}]'), (2, '[{"original": "a [x", "type": "noun"}, {"original": "b'), (3, "nothing"), (4, "[]")]
    got = extract.parsed(spark.createDataFrame(rows, "id int, answer string")).orderBy("id", "ordinal").collect()
    assert [(r.id, r.original, r.type) for r in got] == [(1, "a", "other"), (2, "a [x", "noun")]


def test_store(spark):
    old, new = spark.createDataFrame([("a", 1)], "k string, s int"), spark.createDataFrame([("a", 2), ("b", 3), ("b", 2)], "k string, s int")
    assert [tuple(r) for r in store.insert_or_ignore(old, new, "k", ["s"]).collect()] == [("b", 2)]
    assert sorted(tuple(r) for r in store.upsert(old, new, "k", "s").collect()) == [("a", 2), ("b", 3)]
    calls = spark.createDataFrame([(1, i, i * 1000) for i in range(15)] + [(1, 99, 61_000)], "u int, event_id long, ms long").selectExpr("u", "event_id", "timestamp_millis(ms) as ts")
    got = sliding_limiter(calls, "u").orderBy("event_id").collect()
    assert [r.accepted for r in got] == [True] * 10 + [False] * 5 + [True]
