"""Transactions over several tables: counts, conflicts, two writers, failed ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glossa.sources.tables import Conflict, Table, TableStore

TABLES = {
    "contents": Table("id long, title string", "id", buckets=4),
    "cards": Table("id string, content_id long, original string, box int", "id", unique="original", parent=("contents", "content_id"), buckets=4),
    "notes": Table("id long, card string", "id", parent=("cards", "card"), buckets=2),
    "days": Table("day date", "day", buckets=1),
}


@pytest.fixture
def store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"), TABLES)

    def fill(tx):
        assert tx.insert("contents", spark.range(10).select("id", F.concat(F.lit("t"), "id").alias("title"))) == 10
        assert tx.insert_or_ignore("cards", cards(spark, 30), ["id"]) == 30
        assert tx.insert("notes", spark.range(60).select("id", F.concat(F.lit("c"), F.col("id") % 30).alias("card"))) == 60

    store.run(fill)
    return store


def cards(spark, n, start=0):
    i = F.col("id")
    return spark.range(start, start + n).select(F.concat(F.lit("c"), i).alias("id"), (i % 10).alias("content_id"), F.concat(F.lit("w"), i).alias("original"), F.lit(1).alias("box"))


def rows(store, name, version=None):
    return sorted(map(tuple, store.read(name, version).collect()))


def test_cascade_goes_down_and_is_one_version(store, spark):
    gone = store.run(lambda tx: tx.delete("contents", spark.createDataFrame([(3,), (4,), (77,), (None,)], "id long")))
    assert gone == {"contents": 2, "cards": 6, "notes": 12}
    assert {r[0] for r in rows(store, "contents")} == {0, 1, 2, 5, 6, 7, 8, 9} and len(rows(store, "cards")) == 24 and len(rows(store, "notes")) == 48
    assert store.newest() == 2 and len(rows(store, "cards", 1)) == 30  # the version before is still there
    assert store.run(lambda tx: tx.delete("contents", spark.createDataFrame([], "id long"))) == {"contents": 0, "cards": 0, "notes": 0} and store.newest() == 2


def test_clear(store):
    assert store.run(lambda tx: tx.clear(*TABLES)) == {"contents": 10, "cards": 30, "notes": 60, "days": 0}
    assert all(rows(store, n) == [] for n in TABLES) and store.run(lambda tx: tx.clear(*TABLES)) == dict.fromkeys(TABLES, 0)
    assert store.newest() == 2


def test_insert_or_ignore_as_one_after_the_other(store, spark):
    offered = [("n1", "a"), ("n1", "b"), ("n2", "b"), ("n3", "b"), ("n3", "c"), ("c5", "d"), ("n4", "d"), ("n5", "w7"), ("n6", None), (None, "e"), ("n7", "a"), ("n7", "f"), ("n7", "f")]
    ids, words, want = {f"c{i}" for i in range(30)}, {f"w{i}" for i in range(30)}, []
    for i, w in offered:
        if i is not None and w is not None and i not in ids and w not in words:
            ids.add(i), words.add(w), want.append((i, w))
    df = spark.createDataFrame([(i, 1, w, 1, k) for k, (i, w) in enumerate(offered)], "id string, content_id long, original string, box int, k int")
    assert store.run(lambda tx: tx.insert_or_ignore("cards", df, ["k"])) == len(want) == 5
    assert sorted(r[0::2][:2] for r in rows(store, "cards") if r[0].startswith("n")) == sorted(want)
    assert store.run(lambda tx: tx.insert_or_ignore("cards", df, ["k"])) == 0 and store.newest() == 2


def test_upsert_and_update(store, spark):
    changed = spark.createDataFrame([("c1", 1, "w1", 4, 1), ("c1", 1, "w1", 5, 2), ("x", 2, "wx", 2, 1)], "id string, content_id long, original string, box int, seq int")
    assert store.run(lambda tx: tx.upsert("cards", changed, "seq")) == 1
    assert {r for r in rows(store, "cards") if r[3] > 1} == {("c1", 1, "w1", 5), ("x", 2, "wx", 2)} and len(rows(store, "cards")) == 31
    n = store.run(lambda tx: tx.update("cards", spark.createDataFrame([("c2", 3, None), ("zz", 3, "no"), ("c3", None, "new")], "id string, box int, original string"), ["box", "original"]))
    got = {r[0]: r for r in rows(store, "cards")}
    assert n == 2 and got["c2"][2:] == ("w2", 3) and got["c3"][2:] == ("new", 1)
    untouched = {p for p in store.parts(2) if p[0] == "cards"} & {p for p in store.parts(3) if p[0] == "cards"}
    assert untouched  # buckets without a change are the same files


def test_conflicts_commit_nothing(store, spark):
    before = store.parts()
    for bad in ([("c1", "new")], [("a", "w1")], [("a", "x"), ("a", "y")], [("a", "x"), ("b", "x")], [(None, "x")]):
        df = spark.createDataFrame([(i, 1, w, 1) for i, w in bad], "id string, content_id long, original string, box int")
        with pytest.raises(Conflict):
            store.run(lambda tx, df=df: (tx.clear("contents"), tx.insert("cards", df)))
    with pytest.raises(Conflict):
        store.run(lambda tx: tx.update("cards", spark.createDataFrame([("c1", "w2")], "id string, original string"), ["original"]))
    with pytest.raises(Conflict):
        store.run(lambda tx: tx.upsert("cards", spark.createDataFrame([("c1", 1, "w2", 1)], "id string, content_id long, original string, box int"), "box"))
    assert store.parts() == before and store.newest() == 1


def test_a_failed_writer_leaves_nothing(store, spark):
    def fails(tx):
        assert tx.insert("cards", cards(spark, 5, 100)) == 5 and tx.read("cards").count() == 35  # seen inside only
        assert store.read("cards").count() == 30
        raise KeyError("power cut")

    with pytest.raises(KeyError):
        store.run(fails)
    assert store.newest() == 1 and len(rows(store, "cards")) == 30
    assert store.vacuum() == 0 and store.vacuum(seconds=0) > 0 and len(rows(store, "cards")) == 30 and len(rows(store, "notes")) == 60


def test_two_writers_both_commit(store, spark):
    other, runs = TableStore(spark, store.root, TABLES), []

    def slow(tx):
        runs.append(tx.count("cards"))
        n = tx.insert_or_ignore("cards", cards(spark, 10, 25), ["id"])
        if len(runs) == 1:  # another writer commits meanwhile, twice, and clears old files
            other.run(lambda tx: tx.insert("cards", cards(spark, 3, 30)))
            other.run(lambda tx: tx.delete("contents", spark.createDataFrame([(0,)], "id long")))
            other.vacuum()
        return n

    # Of 25 to 34 the first run would put in five; after the other writer 30 is gone again with its content, 31 and 32 are there.
    assert store.run(slow) == 3 and runs == [30, 29]
    assert store.newest() == 4 and len({r[0] for r in rows(store, "cards")}) == len(rows(store, "cards")) == 32
    # Late by any number of versions: the number stays taken.
    assert not store._claim(2, "late") and not store._claim(4, "late") and store.newest() == 4


def test_vacuum_keeps_what_versions_name(store, spark):
    for i in range(3):
        store.run(lambda tx, i=i: tx.update("cards", spark.createDataFrame([(f"c{i}", 5)], "id string, box int"), ["box"]))
    assert store.vacuum() == 0 and len(rows(store, "cards", 1)) == 30  # all of them are young
    assert store.vacuum(keep=2, seconds=0) > 0
    assert len(rows(store, "cards", 3)) == len(rows(store, "cards")) == 30 and store.vacuum(keep=2, seconds=0) == 0


def test_rows_without_a_table(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "new"), TABLES)
    assert store.newest() == 0 and rows(store, "cards") == [] and store.vacuum() == 0
    assert store.run(lambda tx: tx.insert_or_ignore("cards", cards(spark, 0), ["id"])) == 0 and store.newest() == 0
    assert store.run(lambda tx: tx.insert("days", spark.createDataFrame([("2024-02-29",)], "day string"))) == 1 and str(rows(store, "days")[0][0]) == "2024-02-29"
