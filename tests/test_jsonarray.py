"""Arrays cut by many tasks against the plain JSON reader."""

from __future__ import annotations

import json
import random

import pytest

from glossa.sources import jsonarray as J

NASTY = ['a"b', "back\\slash", "\\", 'end\\"', "{", "}", "[{", "}]", '"results": [{', "\\\\", "x\ny", "é😀", "", "tab\t}", '\\"}', ","]


def word(rng):
    return "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4)))


def value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 2)
    if kind <= 2:
        return [word(rng), rng.randint(-5, 5), None][kind]
    if kind <= 4:
        return {word(rng) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def dump(rng, n):
    out = {"ranAt": word(rng), "meta": {"results": [{"url": "inner", "n": -1}], "x": value(rng)}, "other": [{"url": "other"}, {"results": [{"url": "deep"}]}], "natives": ["en", "}"], "seed": rng.randint(0, 3), "promptVersion": "v"}
    out["results"] = [{"url": f"u{i}{word(rng)}", "n": i, "more": value(rng), "results": [{"url": word(rng)}]} for i in range(n)]
    return out | {"totals": {"wallSec": 2.5, "note": word(rng)}, "tail": [{"url": "tail"}]}


@pytest.mark.parametrize("indent", [None, 2])
def test_records_equal_the_plain_reader(spark, tmp_path, indent):
    rng, plain = random.Random(7), {}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # many byte ranges, most borders inside of records and strings
    try:
        for name, n in (("a", 60), ("b", 1), ("c", 0), ("d", 9)):
            plain[name] = dump(rng, n)
            (tmp_path / f"validation-{name}.json").write_text(json.dumps(plain[name], indent=indent, ensure_ascii=rng.random() < 0.5), encoding="utf-8")
        at = str(tmp_path)
        assert J.pieces(spark, at).select("file", "block").distinct().count() > 8
        got = {}
        for r in J.records(spark, at).where("record is not null").orderBy("file", "ordinal").collect():
            got.setdefault(r.file[-6], []).append(json.loads(r.record))
        assert got == {k: v["results"] for k, v in plain.items() if v["results"]}
        frames = {r.file[-6]: r.r for r in J.frames(spark, at, J.META).collect()}
        assert {k: (f.ranAt, f.seed, f.promptVersion, f.totals.wallSec) for k, f in frames.items()} == {k: (v["ranAt"], v["seed"], "v", 2.5) for k, v in plain.items()}
        rows = J.elements(spark, at, "url string, n long").collect()
        assert sorted((r.r.n, r.r.url) for r in rows) == sorted((x["n"], x["url"]) for v in plain.values() for x in v["results"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_array_as_the_root(spark, tmp_path):
    rng = random.Random(3)
    want = [{"n": i, "x": value(rng)} for i in range(40)]
    (tmp_path / "root.json").write_text(" " + json.dumps(want) + "\n")
    got = J.records(spark, str(tmp_path), key=None).where("record is not null").orderBy("ordinal").collect()
    assert [json.loads(r.record) for r in got] == want
    (tmp_path / "root.json").write_text("[]")
    assert J.records(spark, str(tmp_path), key=None).where("record is not null").count() == 0


def test_first_file_wins_and_others_are_told(spark, tmp_path):
    for name, more in (("a", {"seed": 1}), ("b", {"seed": 2, "promptVersion": "v1", "maxChars": 9, "ranAt": "2026-02"}), ("c", {"seed": 3, "promptVersion": "v2", "ranAt": "2026-01"}), ("d", {"promptVersion": "v1", "totals": {"wallSec": 4}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(more | {"results": [{"url": name}]}))
    frames = J.frames(spark, str(tmp_path), J.META)
    assert tuple(J.merged_frame(frames).first()) == ("2026-01", 2, 9, "v1", None, None, 4.0, 4)
    assert sorted((r.file[-6], r.field, r.value, r.first) for r in J.disagreements(frames).collect()) == [("c", "promptVersion", "v2", "v1"), ("c", "seed", "3", "2")]
