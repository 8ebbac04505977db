"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import random
from collections import Counter

import duckdb
import pytest
import regex as re

from glossa.operators import adapters, ingest
from glossa.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in registry.ORACLE_SQL:
        got = con.execute(registry.ORACLE_SQL[name])
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(df.columns, rows) == plain(columns, got.fetchall())


def test_full_chain_reads_every_document(spark):
    plain = adapters.vocabulary(spark, SF).where("pos % 8 = 7 and word_type in ('adjective', 'phrase')").groupBy("content_id").count().collect()
    kept = registry.QUERIES["full_chain"](spark, SF).join(adapters.vocabulary(spark, SF).select("id", "content_id", "pos", "word_type"), "id")
    kept = {r.content_id: r["count"] for r in kept.where("pos % 8 = 7 and word_type in ('adjective', 'phrase')").groupBy("content_id").count().collect()}
    # Entries left as they are, of kinds that no step drops, all stay.
    assert kept == {r.content_id: r["count"] for r in plain} and {k % 4 for k in kept} == {0, 1, 2, 3}


def test_languages_are_told_by_the_ranks_of_trigrams(spark):
    rng = random.Random(6)
    speak = {"aa": "banolit", "bb": "gurksempy", "cc": "banoxyzw"}
    say = lambda lang, n: " ".join("".join(rng.choice(speak[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))
    known = [(lang, say(lang, 400)) for lang in speak for _ in range(3)] + [("aa", "ban " * 500), (None, "q" * 900)]
    texts = [say(rng.choice("abc") * 2, rng.randint(1, 40)) for _ in range(40)] + [None, "", "ban", "ban" * 3 + "ä", "!?", "0123456789 0123", "q" * 40, "ÖÄÜ éèê " * 5, known[0][1] * 3]
    profiles = ingest.trigram_profiles(spark.createDataFrame(known, "lang string, text string"))
    got = {r.doc_id: (r.detected, r.distance) for r in ingest.detect_language(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), profiles).collect()}

    def grams(t):
        s = " " + re.sub(r"[^\p{L}]+", " ", t).lower().strip() + " "
        n = Counter(s[i : i + 3] for i in range(len(s) - 2))
        return {g: i + 1 for i, g in enumerate(sorted(n, key=lambda g: (-n[g], g)))}

    want = {}
    for lang in speak:
        n = Counter()
        for x, t in known:
            if x == lang:
                s = " " + re.sub(r"[^\p{L}]+", " ", t).lower().strip() + " "
                n.update(s[i : i + 3] for i in range(len(s) - 2))
        want[lang] = {g: i + 1 for i, g in enumerate(sorted(n, key=lambda g: (-n[g], g))[:300])}
    for i, t in enumerate(texts):
        s = (t or "")[:500]
        mine, best = grams(s), None
        if len(re.sub(r"[^\p{L}]", "", s)) >= 10:
            far = [(sum(min(300, abs(at - p[g])) if g in p else 300 for g, at in mine.items()) / (300 * len(mine)), lang) for lang, p in want.items() if set(p) & set(mine)]
            best = min(far, default=None)
        expect = (best[1], best[0]) if best and best[0] <= ingest.FURTHEST else (None, None)
        assert got[i][0] == expect[0] and (expect[1] is None or abs(got[i][1] - expect[1]) < 1e-12), (i, t[:50] if t else t, got[i], expect)
    assert {d for d, _ in got.values()} == {"aa", "bb", "cc", None}
