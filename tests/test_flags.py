"""Flags, rules and categories of extracted entries on literal rows."""

from pyspark.sql import functions as F

from glossa.functions import flags as X

SCHEMA = "learn string, native string, original string, translation string, word_type string, forms array<string>"
#: entry, the flags that it gets
FLAGGED = [
    (("fr", "de", "le café", "das Cafe", "noun", ["café"]), {"h1"}), (("de", "en", "der Hund", "x", "noun", ["Hund"]), {"h2"}), (("de", "en", "der Hund", None, "noun", ["Hund"]), {"h2"}), (("de", "fr", "der Hund", "y" * 61, "noun", ["Hund"]), {"h3"}),
    (("de", "en", "der Hund", "the Rex", "noun", ["Hund"]), {"h4"}), (("de", "fr", "der Hund", "the Rex", "noun", ["Hund"]), set()), (("fr", "en", "la NASA", "agency", "noun", ["NASA"]), {"h5"}), (("fr", "en", "l'ONU", "agency", "noun", ["ONU"]), {"h5"}),
    (("de", "en", "der Hund, die Hund", "dog", "noun", ["Hund"]), {"h6"}), (("de", "en", "der Hund", "dog", "noun", [" ", None]), {"h11"}), (("de", "en", "der Hund", "dog", "noun", None), {"h11"}),
    (("de", "en", "sehr gut", "very good", "adverb", ["x"]), {"h12"}), (("sv", "en", "att gå", "to go", "verb", ["x"]), set()), (("no", "en", "å gå", "to go", "verb", ["x"]), set()), (("de", "en", "å gå", "to go", "adverb", ["x"]), {"h12"}),
    (("de", "en", "das Wort-ende", "word", "noun", ["x"]), {"h14"}), (("de", "en", "das -ende", "word", "noun", ["x"]), set()), (("de", "en", "läuft", "runs", "verb", ["x"]), {"h15"}), (("es", "en", "freír", "to fry", "verb", ["x"]), set()),
    (("de", "en", "Hund", "dog", "noun", ["x"]), {"h17"}), (("fr", "en", "l’année", "year", "noun", ["x"]), set()), (("en", "de", "the dog", "der Hund", "noun", ["x"]), {"h17"}), (("pl", "en", "pies", "dog", "noun", ["x"]), set()),
    (("de", "en", "in Ordnung", "fine", "other", ["x"]), {"h12", "h19"}), (("de", "en", "der die Hund", "dog", "noun", ["x"]), {"h20"}),
]


def test_flags(spark):
    df = spark.createDataFrame([(i, *e) for i, (e, _) in enumerate(FLAGGED)], "i int, " + SCHEMA)
    got = {r.i: {k for k in X.flags() if r[k]} for r in df.select("i", *(c.alias(k) for k, c in X.flags().items())).collect()}
    assert {i: (e, got[i]) for i, (e, want) in enumerate(FLAGGED) if got[i] != want} == {}


def test_categories(spark):
    rows = [("en", "the dog", "def"), ("en", "dog", "bare"), ("de", "einen Hund", "indef"), ("fr", "l’eau", "def"), ("it", "un'amica", "indef"), ("it", "l'amica", "def"), ("sv", "en hund", "indef"), ("sv", "hunden", "def"), ("sv", "bil", "bare"), ("pl", "ten pies", "bare"), ("xx", "a", "unknown"), ("nl", "een huis", "indef")]
    df = spark.createDataFrame(rows, "n string, t string, w string")
    assert [r[0] for r in df.select(X.translation_category(F.col("n"), F.col("t"))).collect()] == [r[2] for r in rows]
    pairs = [("de", "en", "def"), ("de", "pl", "bare"), ("sv", "de", "indef"), ("sv", "cs", "bare"), ("pl", "de", "def"), ("pl", "sv", "indef"), ("cs", "pl", "bare"), ("xx", "fr", "def")]
    assert [r[0] for r in spark.createDataFrame(pairs, "l string, n string, w string").select(X.expected_category(F.col("l"), F.col("n"))).collect()] == [p[2] for p in pairs]


def test_rules(spark):
    rows = [
        ("sv", "de", "en hund", "ein Hund", "noun", None, {"r34": True, "r42": True, "r33": True, "short": True, "r40": True}),  # not counted for German case: no article, and not def
        ("sv", "de", "hund", "der hund", "noun", None, {"r34": False, "r42": False, "german": False, "r33": True, "short": True, "r40": True}),
        ("pl", "en", "the pies", "the dog", "noun", None, {"r41a": False, "r42": True, "r33": True, "short": True, "r40": True}),
        ("en", "de", "the dog", "Hund", "noun", None, {"r41b": True, "r42": False, "german": False, "r33": True, "short": True, "r40": True}),
        ("de", "en", "rot, rote", "red", "adjective", None, {"r38": False, "short": True, "r40": True}),
        ("fr", "en", "s’asseoir", "to sit", "verb", None, {"r39": True, "short": True, "r40": False}),
        ("de", "en", "zum Beispiel", "for example", "other", None, {"r37": False, "short": True, "r40": True}),
        ("de", "sv", "der Hund", "hund", "noun", None, {"r42": False, "r33": True, "short": True, "r40": True}),
        ("no", "sv", "en a b c", "bil", "noun", None, {"r34": True, "r42": True, "r33": False, "short": True, "r40": True}),
    ]
    df = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(rows)], "i int, " + SCHEMA)
    cols = [F.when(about, kept).alias(k) for k, (about, kept) in X.rules().items()]
    got = {r.i: {k: r[k] for k in X.rules() if r[k] is not None} for r in df.select("i", *cols).collect()}
    assert {i: (r[:5], got[i]) for i, r in enumerate(rows) if got[i] != r[6]} == {}


def test_anomalies(spark):
    rows = [(6.0, "C1", "noun", "high"), (5.9, "C2", "noun", None), (6.5, "B2", "noun", None), (0.0, "A2", "noun", "low"), (0.0, "A1", "phrase", None), (0.0, "B1", "noun", None), (0.0, "", "noun", "low")]
    df = spark.createDataFrame(rows, "z double, l string, k string, w string")
    assert [r[0] for r in df.select(X.zipf_anomaly(F.col("z"), F.col("l"), F.col("k"))).collect()] == [r[3] for r in rows]
