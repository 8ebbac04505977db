import json

import pytest

from glossa.sources import readers as R


def test_word_lists(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tDer\t5\n2\tder\t3\n3\tx\n4\ty\tmany\n")
    assert [tuple(r) for r in R.corpus_counts(spark, str(tmp_path / "c.tsv"), "de").collect()] == [("de", "der", 8)]


def test_gold(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"word": "a", "language": "de", "cefr": "A1", "source": "s"}\nnope\n{"word": "b", "language": "xx", "cefr": "A1"}\n{"word": "c", "language": "de", "cefr": "Z"}\n')
    good, bad = R.gold_lines(spark, str(tmp_path / "g.jsonl"), ["de"], ["A1"])
    assert [r.word for r in good.collect()] == ["a"] and {r.why: r.n for r in bad.collect()} == {"malformed": 1, "language": 1, "level": 1}


def test_columns(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id;lemma;level\n1;haus;A1\n2;baum;B2\n3;see;C1\n")
    assert R.level_columns(R.sniffed_csv(spark, str(tmp_path / "s.csv"))) == ("level", "lemma")


def test_rate_columns():
    names = ["tag", '"Word"', "tf-idf@A1", "D@A1", "SFI@A1", "U@A1", "nb_doc_a1", "F@A1", "freq_A1", "level_freq@a2", "A2", "total@B1", "b1", "xb2x", "C1_freq"]
    assert R.rate_columns(names, ("A1", "A2", "B1", "B2", "C1")) == ('"Word"', {"A1": "F@A1", "A2": "level_freq@a2", "B1": "b1", "C1": "C1_freq"})
    for bad in (["tag", "F@A1"], ["lemma", "D@A1", "total_a1"]):
        with pytest.raises(ValueError, match="no column"):
            R.rate_columns(bad, ("A1",))


def test_figures_are_no_words(spark, tmp_path):
    for i in range(3):  # a table in several files, each with the header
        (tmp_path / f"{i}.csv").write_text("tf-idf;total_word;lemma;level\n" + "".join(f"eins;wort{i}{k};haus{'abcdefghij'[k]}{'xyz'[i]};B2\n" for k in range(10)))
    assert R.level_columns(R.sniffed_csv(spark, str(tmp_path))) == ("level", "lemma")


def test_dumps(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"d{i}.json").write_text(json.dumps({"ranAt": "t", "results": [{"url": f"u{i}", "lang": "de", "native": "en", "ok": True, "levelDistribution": {"A1": 2, "Q": i}, "vocab": [{"original": "a", "translation": "b", "level": "A1", "type": "noun", "source_forms": ["x", "y"]}]}]}))
    r = R.merged_dumps(spark, [str(tmp_path / "d0.json"), str(tmp_path / "d1.json")])
    assert sorted(x.source_forms for x in R.vocab_rows(r).collect()) == ["x|y", "x|y"]
    wide = R.summary_rows(r, ["A1", "A2"])
    assert wide.columns[-3:] == ["A1", "A2", "Q"] and sorted(x.Q for x in wide.collect()) == [0, 1]
    R.write_csv(R.vocab_rows(r), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
