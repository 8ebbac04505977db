"""Small cases of what a review found: results on odd inputs, and steps that grew faster than the tables."""

import contextlib
import io

from pyspark.sql import functions as F

from glossa.functions import lemma, lex, model
from glossa.operators import adapters
from glossa.plans import registry
from glossa.sources import jsonarray

SF = "/root/testdata/sf0.001"


def plan(df, mode="simple"):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain(mode)
    return out.getvalue()


def documents(spark, tmp_path, rows):
    """A folder with documents (doc_id, text, lang) only."""
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_answers_are_cut_without_a_shuffle(spark, tmp_path):
    text = " ".join("Wort" if i % 2 else "x" for i in range(1003))
    sf = documents(spark, tmp_path, [(3, text, "de"), (4, "Ein Satz", "de"), (5, " 1, 2", "de"), (6, None, "de")])
    got = registry.QUERIES["json_parse_repair"](spark, sf)
    assert "hashpartitioning" not in plan(got)
    rows = sorted(tuple(r) for r in got.select("doc_id", "part", "ordinal", "original", "type").collect())
    # Document 3's answers are cut off, so each of its parts lacks its last item.
    want = [(3, i // 500, i % 500, "wort" if i % 2 else "x", "noun" if i % 3 else "other") for i in range(1003) if i not in (499, 999, 1002)]
    assert rows == [*want, (4, 0, 0, "ein", "other"), (4, 0, 1, "satz", "noun")]


def test_a_double_s_at_the_start_stays(spark, tmp_path):
    sf = documents(spark, tmp_path, [(1, "ßer ßer Être être", "fr"), (2, "ßer", "de")])
    assert sorted(tuple(r) for r in registry.QUERIES["corpus_tsv"](spark, sf).collect()) == [("fr", "ßer", 2), ("fr", "être", 2)]


def test_counts_of_many_millions_have_no_decimals(spark):
    got = spark.createDataFrame([(99_900_000.0,), (100_000_000.0,), (100_340_000.0,), (9_683_150_409.0,)], "n double").select(lex.format_count(F.col("n")))
    assert [r[0] for r in got.collect()] == ["99.9M", "100M", "100M", "9683M"]


def test_words_of_a_document_stay_with_it(spark, tmp_path):
    sf = documents(spark, tmp_path, [(1, "Der Hund der " * 70, "de"), (1, "Katze", "de"), (2, "", "de"), (3, None, "de")])
    chunks, rated = (registry.QUERIES[n](spark, sf) for n in ("chunks_in_order", "rating_maps"))
    assert plan(chunks).count("hashpartitioning") == 1 and "Join" not in plan(rated)
    one = [r.item for r in chunks.where("doc_id = 1").orderBy("ordinal").collect()]
    assert sorted(one) == sorted(["der", "hund", "der"] * 70 + ["katze"])
    assert sorted(tuple(r) for r in rated.collect()) == [(1, "der", 3.3, None), (1, "hund", 4.3, None), (1, "katze", 5.3, "A1")]


def test_languages_are_ranked_without_a_window_over_texts(spark):
    assert "partition by _row" not in (shown := plan(registry.QUERIES["lang_detect"](spark, SF))) and "_row#" not in "".join(x for x in shown.splitlines() if "Window" in x)


def test_texts_are_split_once(spark):
    for name, most in (("article_post", 10), ("ocr_valid", 2), ("ocr_pipeline", 10)):
        shown = plan(registry.QUERIES[name](spark, SF))
        assert shown.count("split(") <= most, (name, shown.count("split("))


def test_levels_and_lemmas_are_made_once(spark):
    for made, pattern, most in ((model.level(model.difficulty(F.log10("x"), F.col("x"))), "LOG10(", 1), (lemma.chapter_lemma(F.reverse("x")), "reverse(", 1)):
        shown = plan(spark.createDataFrame([], "x double").select(made.alias("y")).where("y is not null"))
        assert shown.count(pattern) <= 2 * most, shown.count(pattern)  # in the filter and in the result
    cells = ["1a der/die Maler/in (ein (guter) Satz), -n", "Hund (so)", "von hier)", "12 die/der Katze/r", "der/die ", "!", "", None]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(lemma.chapter_lemma(F.col("c"))).collect()
    assert [r[0] for r in got] == ["maler", "hund", None, "katze", "der", None, None, None]


def test_words_are_read_once_for_counts_and_sums(spark, tmp_path):
    sf = documents(spark, tmp_path, [(2, "Der Hund der", "de"), (1, "hund", "de"), (3, "x", None), (None, "Maus", "fr")])
    v = adapters.vocabulary(spark, sf)
    rows = v.select("lang", "original", "pos", "level").collect()
    assert sorted((str(r.lang), r.original, r.pos) for r in rows) == [("None", "x", 0), ("de", "der", 0), ("de", "hund", 0), ("fr", "maus", None)]
    assert "ReusedExchange" in plan_run(v) and "Join" not in plan(adapters.vocabulary(spark, sf, levels=False))


def plan_run(df):
    """The plan of a run as it has come out."""
    run = df._jdf.queryExecution()
    run.executedPlan().execute().count()
    return run.executedPlan().toString()


def test_dumps_read_the_texts_once(spark, monkeypatch, tmp_path):
    sf, calls = documents(spark, tmp_path, [(i, f"wort{i} Hund der Hund", "de") for i in range(5)]), []
    real = jsonarray.pieces
    monkeypatch.setattr(jsonarray, "pieces", lambda *a: calls.append(a) or real(*a))
    got = registry.QUERIES["vocab_csv"](spark, sf)
    assert len(calls) == 1 and "lineSep" not in plan(got) and got.count() == 3


def test_terms_are_cut_after_their_words_are_grouped(spark, tmp_path):
    sf = documents(spark, tmp_path, [(1, "...Ab ab-x, ab9 É", "de"), (2, "ab cd", "de"), (3, None, "de")])
    got = registry.QUERIES["highlights"](spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 5, "de:ab"), (1, 6, 8, "de:ab"), (2, 3, 5, "de:cd")]
    assert not any("Filter" in x and "regexp_extract(lower" in x for x in plan(got).splitlines())


def test_counts_and_terms_are_written_once(spark):
    for name in ("list_variants", "two_phase"):
        assert "posexplode" not in plan(registry.QUERIES[name](spark, SF))
