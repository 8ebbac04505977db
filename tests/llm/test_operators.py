"""Operators against brute force, round trips and held-out accuracy, with the awkward cases of each."""

import base64
import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F

from glossa.llm import bpe, chat, common, counts, decontaminate, graph, jaccard, pii, quality, shards, topk, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


DOC = "doc_id long, text string, lang string, source string, n_chars long, dk string, node string, token string, n int, spans string"


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i if ids is None else ids[i], t, None, None, len(t or ""), "x", "y", "z", 1, "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " \n\t ", "one", "a b", "one", "é中😀 ẞ", "word " * 30_000, None, ""]


def test_bpe_equals_tiktoken(spark, tik):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab 's't're'll  \n\t'é1२9!?.—D\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 5000, " " * 3000, "ab" * 700]
    got = {r.doc_id: r for r in bpe.round_trip(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = tik.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(documents(spark, [])).count() == 0
    some = documents(spark, texts[:30])
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(some)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts[:30])}


def test_short_and_long_merges_agree():
    vocab, rng = bpe.vocabulary(PATH), random.Random(8)
    pieces = ["".join(rng.choice("theandio ") for _ in range(rng.randint(2, 64))).encode() for _ in range(300)]
    assert vocab.merge_short(pieces, 64) == [vocab.merge_long(p) for p in pieces]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k, percent):
    sets, root = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(range(len(texts)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, k, percent):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 20, 80, 200]))] for _ in range(12)]
    passage = [rng.choice(vocab) for _ in range(40)]
    texts = list(ODD)
    for b in base:
        for _ in range(rng.randint(1, 9)):
            w = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w if rng.random() < 0.7 else w + passage))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.clusters(documents(spark, texts), k, percent).collect()}
    want = brute_components(texts, k, percent)
    assert [got[i] for i in range(len(texts))] == want
    kept = sorted(r.doc_id for r in jaccard.deduplicated(documents(spark, texts), k, percent).collect())
    assert kept == [i for i, (_, c) in enumerate(want) if c == i]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_of_lone_pairs(spark, k, percent):
    rng = random.Random(4)
    new = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    texts = []
    for more in range(5, 30):
        a, b = new(50), new(50)
        texts += [f"{a} {b}", f"{a} {b} {new(more)}", a := f"{new(50)} {new(50)}", f"{new(more)} {a}", f"{(b := new(60))} {(c := new(40))}", f"{b} {new(more)} {c}"]
    got = {r.doc_id: r.component_id for r in jaccard.clusters(documents(spark, texts), k, percent).collect()}
    want = [c for _, c in brute_components(texts, k, percent)]
    assert len(set(want)) < len(texts) - 30
    assert [got[i] for i in range(len(texts))] == want


def test_deduplicated_keeps_one_row_of_a_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, a), (3, b), (5, b + " more"), (None, c), (None, a), (None, c + " more"), (7, c + " end"), (None, "lone"), (None, "lone"), (8, None), (8, None), (8, ""), (None, "other")]
    texts, ids = [t for _, t in rows], [i for i, _ in rows]
    kept = sorted((str(r.doc_id), str(r.text)) for r in jaccard.deduplicated(documents(spark, texts, ids)).collect())
    assert kept == sorted((str(i), str(t)) for i, t in [(5, a), (3, b), (7, c + " end"), (None, "lone"), (8, None), (8, ""), (None, "other")])


def test_classes_of_one_node_stay_apart(spark, monkeypatch):
    def key(tokens):
        total = int(tokens.sum(dtype=np.uint64))
        return total % 3, total % (1 << 61)

    monkeypatch.setattr(jaccard, "class_key", key)
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    texts += [f"{t} more" for t in texts[:5]] + texts[:3] + ["", None]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.clusters(documents(spark, texts), 4, 85).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 4, 85)


def test_scrambled_orders_drop_unrelated_pairs_of_long_texts(spark):
    rng = np.random.default_rng(4)
    n = 20_000
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(16)]
    sets.append(np.unique(np.concatenate([sets[0][:19_000], sets[1][:500]])))
    rows = [(i, *([(np.sort(t * by)[: jaccard._prefix(len(t), 85)] >> np.uint64(8)).astype(np.uint32).view(np.int32).tolist() for by in jaccard._SCRAMBLE])) for i, t in enumerate(sets)]
    classes = spark.createDataFrame(rows, "node long, p2 array<int>, p3 array<int>")
    pairs = spark.createDataFrame(list(combinations(range(17), 2)), "a long, b long")
    kept = {tuple(r) for r in jaccard._filtered(pairs, classes).collect()}
    assert (0, 16) in kept and len(kept) < 10


def test_spread_join(spark):
    left = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(60)] + [(60, None), (61, None)], "id long, k long")
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v")).where("k <> 9")
    for share in (1, 3, 1000):
        got = common.spread_join(left, right, "k", "n", 62, "id", share)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right.drop("n"), "k", "left").select("id", "k", "v").collect()))


def test_jaccard_of_nothing(spark):
    assert jaccard.clusters(documents(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.clusters(documents(spark, [None, ""])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 52), (52, 50), (60, 60), (None, 1)] + [(100, 100 + i) for i in range(1, 40)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(31)} | {i: 50 for i in (50, 51, 52)} | {i: 100 for i in range(100, 140)}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = [(int(i), [float(x) for x in np.round(rng.normal(size=8), 1)], "extra") for i in range(700)]
    vecs += [(900, vecs[0][1], "copy"), (950, None, ""), (951, [1.0, None], ""), (952, [float("nan")] * 8, ""), (None, [1.0] * 8, ""), (1000, [0.0] * 8, ""), (1050, [], "")] + [vecs[3]] * 2
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v, _ in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 50 == 0):
        score = lambda v: int(sum(a * b for a, b in zip(good[q], v)))
        best = sorted((-score(v), i) for i, v in good.items() if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, one, 5).count() == 0
    cost = topk.search_costs(df, df.where("vec_id % 50 = 0"), 5).first()
    assert 0 < cost.share_scored <= 1


def test_threshold_stops_and_stays_small():
    """On lists that fall off steeply few vectors are scored; a task's memory is that of one block and one query."""
    import tracemalloc

    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.exponential(size=(8192, 64)) ** 3)
    tracemalloc.start()
    block = topk.Lists(rng.permutation(8192), v)
    reads = []
    for i in range(30):
        q = np.zeros(64)
        q[rng.integers(0, 64, 3)] = 1 + rng.integers(0, 5, 3)
        ids, scores, read = block.best(q, -1, 5)
        every = block.vectors @ q
        assert ids.tolist() == block.ids[np.lexsort((block.ids, -every))[:5]].tolist() and scores.tolist() == sorted(every.tolist(), reverse=True)[:5]
        reads.append(read)
    for q in rng.normal(size=(5, 64)):
        block.best(np.floor(256 * q), 7, 5)
    assert np.mean(reads) < 800 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def brute_hits(text, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = words(text), set(), set()
    for name, t in items:
        b = words(t)
        for i in range(max(len(b) - size, 0) + 1) if b else ():
            win = b[i : i + size]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "of", "and"] * 6 + [f"w{i}" for i in range(40)] + ["É1", "naïve"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 9, 10, 14, 25])))) for i in range(12)] + [(3, "the of"), (20, None), (21, "?!"), (22, "w1")]
    texts = list(ODD)
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            b = rng.choice(items[:12])[1].split()
            w[len(w) // 2 : len(w) // 2] = b[rng.choice([0, 0, 1, 3]) :]
        texts.append(rng.choice(["", " ", ", "]) + rng.choice([" ", ", ", "\n"]).join(w).upper() + rng.choice(["", "."]))
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(docs, bench).collect()}
    want = {i: brute_hits(t, items) for i, t in enumerate(texts)}
    assert got == want
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [i for i, x in want.items() if not x[4]]
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.report(documents(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, bench.where("item_id < 0")).collect())


def test_proximity(spark):
    docs = documents(spark, ["alpha x y beta z gamma", "alpha " + "x " * 20 + "beta", "beta gamma alpha"])
    queries = spark.createDataFrame([Row(query_id=1, terms=["alpha", "beta", "gamma"])])
    got = sorted((r.query_id, r.doc_id) for r in decontaminate.near(docs, queries, 6).collect())
    assert got == [(1, 0), (1, 2)]


def test_proximity_tells_rows_apart(spark):
    kind = "doc_id long, text string, pos int, word string, n int"
    rows = [(1, "alpha x x"), (1, "y y beta"), (None, "beta alpha"), (None, "beta x alpha"), (2, "alpha beta"), (2, "alpha beta"), (3, None), (4, ""), (5, "alpha " + "x " * 9 + "beta"), (6, "z " * 40_000 + "Beta-ALPHA")]
    docs = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], kind)
    queries = spark.createDataFrame([("q", ["alpha", "beta"]), ("q", ["alpha"]), (None, ["alpha"]), ("none", ["nowhere", "alpha"]), ("void", []), ("null", None)], "query_id string, terms array<string>")
    got = sorted(((r.query_id, r.doc_id) for r in decontaminate.near(docs, queries, 3).collect()), key=str)
    want = [("q", d) for d, t in rows if t and any(abs(i - j) <= 3 for i, a in enumerate(re.split("[ -]", t.lower())) for j, b in enumerate(re.split("[ -]", t.lower())) if (a, b) == ("alpha", "beta"))]
    assert got == sorted(want, key=str) and ("q", None) in got and ("q", 1) not in got
    assert not decontaminate.near(docs.limit(0), queries, 3).count() and not decontaminate.near(docs, queries.limit(0), 3).count()
    three = spark.createDataFrame([("t", ["alpha", "beta", "x"])], queries.schema)
    assert {r.doc_id for r in decontaminate.near(docs, three, 3, most=2).collect()} >= {2, None}


def test_sample_is_bounded_by_rows(spark):
    rows = [(1, f"text {i}") for i in range(300)] + [(2, "two"), (2, "two"), (3, None), (4, "long " * 9000), (None, "no id")]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 0), (4, 0, 0), (None, 0, 0), (9, 1, 1)], "doc_id long, toxic int, quality int")
    texts, y = toxicity.bounded_sample(docs, labels, "toxic", F.lit(True), size=7)
    assert sum(y) == 7 and len(set(texts)) == len(texts) == 9 and {t for t, v in zip(texts, y) if not v} == {"two", ""}
    assert toxicity.bounded_sample(docs, labels, "toxic", F.lit(True), size=7)[0] == texts
    assert toxicity.bounded_sample(docs.limit(0), labels, "toxic", F.lit(True)) == ([], [])
    assert toxicity.bounded_sample(docs, labels.limit(0), "toxic", F.lit(True)) == ([], [])


def test_chat(spark):
    rows = [(1, 1, "assistant", "b </s>[INST] \\ x"), (1, 0, "user", "hi [/INST]"), (1, 2, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "user", "lost"), (3, 0, "assistant", "é" * 20_000), (3, 1, "assistant", "<\\s> <s>")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, input_ids string")
    made = chat.formatted(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda x: x)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    table = bpe.vocabulary(PATH).table
    for r in made.collect():
        text = chat.render(np.array(r.input_ids), table)
        assert text.count("[INST]") == got[r.conv_id].n_turns == text.count("</s>") and len(text) == got[r.conv_id].formatted_chars
    assert chat.digests(chat.formatted(df.where("conv_id > 99"))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<s>", "<\\s>", "\\<s>\\\\", "[INST][/INST]</s>", "a\\[INST]"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and not any(m in chat.escape(text) for m in chat.MARKS.values())


def replaced(text, start, stop, new):
    a = max(0, min(start, len(text)))
    return text[:a] + new + text[max(a, min(stop, len(text))) :]


def test_counts_equal_full_encoding(spark, tik):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab 's't  \n'é1!D") for _ in range(rng.choice([5, 300]))) for _ in range(60)]
    edits = [(i, k, rng.randint(0, 200), rng.randint(0, 210), rng.choice(["", " x", "'s\n", "é 12"])) for i in range(len(texts)) for k in range(rng.randint(0, 4))]
    table = spark.createDataFrame(edits + [(None, 0, 0, 0, "x")], "doc_id long, seq int, start long, stop long, text string")
    docs = documents(spark, texts).withColumn("edits", F.lit(1)).withColumn("k", F.lit(2))
    got = {r.doc_id: r for r in counts.counted(counts.attached(docs, table), keep=True).collect()}
    now = []
    for i, t in enumerate(texts):
        new = t or ""
        for _, _, a, b, s in sorted(e for e in edits if e[0] == i):
            new = replaced(new, a, b, s)
        now.append(new)
        assert (got[i].text, got[i].n_tokens, got[i].n_tokens_edited) == (new, len(tik.encode_ordinary(t or "")), len(tik.encode_ordinary(new)))
        assert sum(got[i].lengths) == len(new) and sum(got[i].counts) == got[i].n_tokens_edited and sum(got[i].leaves) == len(got[i].lengths)
    assert got[7].n_encoded < 100
    # The table that was kept takes the next edits.
    kept = counts.attached(counts.updated(counts.attached(counts.trees(docs), table), keep=True), table.selectExpr("doc_id", "seq", "stop as start", "start + 20 as stop", "text"))
    again = {r.doc_id: r for r in counts.updated(kept, keep=True).collect()}
    for i, new in enumerate(now):
        for _, _, a, b, s in sorted(e for e in edits if e[0] == i):
            new = replaced(new, b, a + 20, s)
        assert (again[i].text, again[i].n_tokens_edited) == (new, len(tik.encode_ordinary(new)))
    assert counts.updated(counts.sample_edits(counts.trees(documents(spark, [])))).count() == 0


def test_edits_of_a_forest(tik):
    """Thousands of edits, large ones and such that empty leaves, against full encoding."""
    rng = random.Random(7)
    vocab = bpe.vocabulary(PATH)
    encode = lambda pieces: [len(x) // 4 for x in vocab.encode_pieces(pieces)]
    word = lambda n: "".join(rng.choice("ab 's't  \n'é1!Dwe're  the of 日本") for _ in range(n))
    texts = [word(rng.choice([0, 1, 40, 900, 3000])) for _ in range(25)]
    raw = "".join(texts).encode()
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    pieces, _, of, _ = bpe.split_pieces(np.frombuffer(raw, np.uint8), offs)
    lengths, sizes = np.array([len(p.decode()) for p in pieces], np.int32), np.array(encode(pieces), np.int32)
    leaves, leaf_of = [], [0]
    for a, b in zip(of[:-1], of[1:]):
        leaves += [min(8, b - x) for x in range(a, b, 8)] or [0]
        leaf_of.append(len(leaves))
    f = counts.Forest(raw, lengths, sizes, of, np.array(leaves), np.array(leaf_of), encode)
    assert f.tokens[f.base + 1].tolist() == [len(tik.encode_ordinary(t)) for t in texts]
    for r in range(150):
        docs = np.array(sorted(rng.sample(range(25), rng.randint(1, 25))))
        start = [rng.randint(-3, len(texts[d]) + 5) for d in docs]
        stop = [s + rng.choice([-4, 0, 0, 1, 7, 60, 2000]) for s in start]
        new = [word(rng.choice([0, 1, 3, 30]) if rng.random() < 0.98 else 6000) for _ in docs]
        f.edit(docs, np.array(start), np.array(stop), new)
        for d, a, b, s in zip(docs, start, stop, new):
            texts[d] = replaced(texts[d], a, b, s)
        for d in docs:
            text, a, b, leaf = f.parts(d)
            assert text == texts[d] and a.sum() == len(text) and leaf.sum() == len(a)
            assert f.tokens[f.base[d] + 1] == b.sum() == len(tik.encode_ordinary(text)) and f.chars[f.base[d] + 1] == len(text)


def test_personal_data(spark):
    texts = ODD + ["mail a.b@c.de, +1 (415) 555-2671 or 10.0.0.1; 4111 1111 1111 1111.", "ip 999.1.1.1 4111111111111112 +12", "call (212) 555-0187 or 555-123-4567 now", "card 4111.1111.1111.1111 gone"]
    got = {r.doc_id: r for r in pii.scanned(documents(spark, texts)).collect()}
    a = got[len(ODD)]
    assert (a.n_email, a.n_ip, a.n_card, a.n_phone) == (1, 1, 1, 1) and a.spans == "email:5:13,ip:36:44,card:46:65,phone:15:32"
    assert a.base_sha256 == hashlib.sha256(a.spans.encode()).hexdigest() and a.redacted == "mail <EMAIL>, <PHONE> or <IP>; <CARD>."
    b, c, d = (got[len(ODD) + i] for i in (1, 2, 3))
    assert (b.n_email, b.n_ip, b.n_card, b.n_phone) == (0, 0, 0, 0) and b.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert c.redacted == "call <PHONE> or <PHONE> now" and c.n_phone == 0 and d.redacted == "card <CARD> gone"
    assert all(got[i].spans == "" for i in range(len(ODD)))
    out = pii.redacted(documents(spark, texts))
    assert out.columns == documents(spark, texts).columns and {r.doc_id: r.text for r in out.collect()}[0] is None


def test_field_learns_its_table():
    w, move = pii.model()
    for tokens, labels in pii._labelled():
        e, size = pii._padded([pii._features(tokens)], w)
        assert pii.viterbi(e, size, move)[0].tolist() == labels


def test_emails_equal_the_pattern():
    rx, rng = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), random.Random(6)
    for _ in range(5000):
        t = "".join(rng.choice("ab@@..1- é") for _ in range(rng.randint(0, 25)))
        assert [x[1:] for x in pii.base_spans(t) if x[0] == "email"] == [m.span() for m in rx.finditer(t)]


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}


def plain_spans(text):
    return [(kind, *m.span()) for kind, (rx, good) in BASE.items() for m in re.finditer(rx, text) if good(m)]


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(16)
    alphabets = ["ab@@..1- é", "0125.  a", "0 -19 4x", "+0 (1).-9a", "12.34-56 +7@a.b中"]
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1112", "6011000990139424", "378282246310005", "4222222222222222222"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 45))) for _ in range(400) for a in alphabets]
    texts += [f"{rng.choice('x 中')}{rng.choice(cards)}{rng.choice(['', ' ', '0', '-'])}{rng.choice(['+1 415 555 2671', '10.0.0.256', '255.255.255.255.1', 'a@b.c.'])}" for _ in range(300)]
    got = {r.doc_id: r for r in pii.scanned(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in BASE), t
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}, t


SF = "/root/testdata/sf0.1"


def held(spark, module, label, folds, fold):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = module.rated(docs, labels).join(labels, "doc_id").where("held_out").select("doc_id", "predicted", label).collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % folds == fold for r in rows)
    return np.array([(r.predicted, r[label]) for r in rows])


def test_toxicity_on_held_out_rows(spark):
    p, y = held(spark, toxicity, "toxic", 5, 0).T
    assert (p == y).mean() > 0.96 and (p[y == 0] == 1).mean() < 0.02


def test_letter_triples_have_places_of_their_own():
    x = np.arange(1, 27, dtype=np.uint32)
    code = toxicity._code(x[:, None, None], x[:, None], x)
    assert code.max() < toxicity.TABLE and len(np.unique(code)) > 0.85 * code.size


def test_the_table_equals_an_explicit_kernel():
    rng = np.random.default_rng(6)
    word = lambda: bytes([0, *rng.integers(1, 27, rng.integers(3, 14)).tolist(), 0])

    def vector(w):
        out = {}
        for at in combinations(range(len(w)), 3):
            if at[2] - at[0] <= toxicity.SPAN:
                t = tuple(w[i] for i in at)
                out[t] = out.get(t, 0) + toxicity.DECAY ** (at[2] - at[0] + 1)
        size = np.sqrt(sum(toxicity.DECAY ** (2 * (c - a + 1)) for a, b, c in combinations(range(len(w)), 3) if c - a <= toxicity.SPAN))
        return {t: x / size for t, x in out.items()}

    def place(t):
        return int(toxicity._code(*(np.array([c], np.uint32) for c in t))[0])

    taken, words = {}, []
    while len(words) < 60:  # triples of these words have places of their own
        v = vector(w := word())
        new = {place(t): t for t in v}
        if len(new) == len(v) and all(taken.get(p, t) == t for p, t in new.items()):
            taken |= new
            words.append(w)
    marks, others = words[:20], words[20:]
    dot = lambda a, b: sum(x * b.get(t, 0) for t, x in a.items())
    want = np.array([[dot(vector(w), vector(m)) for m in marks] for w in others])
    columns = toxicity._features(marks)
    assert np.abs(toxicity._kernel(others, columns) - want).max() < 1e-5
    alpha = rng.normal(size=20)
    flat = np.frombuffer(b"".join(others), np.uint8)
    starts = np.cumsum([len(w) for w in others]) - [len(w) for w in others]
    got = toxicity.margins(flat, starts, (columns @ alpha).astype(np.float32), 0.25)
    assert np.abs(got - (want @ alpha + 0.25)).max() < 1e-4


def test_toxicity_without_witnesses_keeps_documents(spark):
    docs = documents(spark, ["horrible insults", "nastier phrases", "friendly greetings", "", None])
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.without(docs, toxicity.trained(docs, labels, F.lit(True))).count() == 5


def test_quality_on_held_out_rows(spark):
    p, y = held(spark, quality, "quality", 4, 2).T
    assert (p == y).mean() > 0.97


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_rows(spark, module):
    docs = documents(spark, ODD)
    label = {toxicity: "toxic", quality: "quality"}[module]
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert {r.score for r in module.rated(docs, none).collect()} == {0.0}
    some = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))], f"doc_id long, {label} int")
    rows = module.rated(docs, some).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert module.rated(documents(spark, []), none).count() == 0


def test_inserted_characters_are_tolerated():
    insults, rest = ["idiot", "moron", "clown", "scum", "trash", "loser"], ["the", "of", "and", "house", "tree"]
    rng = random.Random(9)
    rest += ["".join(rng.choice("abdefghklnprvwy") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(rest) for _ in range(20)) for _ in range(600)]
    labels = [i % 2 for i in range(600)]
    texts = [f"{t} {rng.choice(insults)} {rng.choice(rest)} {rng.choice(insults)}" if y else t for t, y in zip(texts, labels)]
    model = toxicity.fit(texts, labels)
    tests = ["the i.d.i.o.t and mor-on", "you c l o w n and l o s e r", "idixot and clo*wn here", "the house and the tree", ""]
    raw = [t.encode() for t in tests]
    s = toxicity.score_texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), model)
    assert (s[:3] > 0.5).all() and (s[3:] < 0.5).all()


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    w, v = rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32)
    index, value = rng.integers(0, 50, 12), rng.normal(size=12).astype(np.float32)
    got = quality._forward(index, value, np.array([0]), w, v)[0][0]
    want = (w[index] * value).sum() + sum((v[index[i]] * v[index[j]]).sum() * value[i] * value[j] for i, j in combinations(range(12), 2))
    assert abs(got - want) < 1e-3


def test_shards(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=3, base_bytes=1 << 14)
    docs = documents(spark, ODD * 3)
    assert store.read(docs.schema).count() == 0 and store.versions() == []
    for i in range(7):
        store.append(docs.where(f"doc_id % 7 = {i}"))
        store.compact(docs.schema)
    store.append(docs.where("doc_id < 0"))
    key = lambda rows: sorted(map(repr, rows))
    assert key(store.read(docs.schema).collect()) == key(docs.collect())
    tiers = [r[1] for r in store.runs()]
    assert all(tiers.count(t) < 3 for t in tiers)
    before = store.versions()
    store.vacuum()
    assert store.versions() == before
    store.vacuum(seconds=0)
    assert store.versions() == before[-1:] and key(store.read(docs.schema).collect()) == key(docs.collect())
    assert not any(store._claim(v, "late") for v in before) and sorted(map(int, store._names("commits", False))) == before and store._names(f"commits/{before[-1]}", False) == []
    assert len(store._names("data", False)) == len(store.runs()) and len(store._names("manifests", False)) == 1
    clashing = docs.select("*", *(F.col("n").alias(c) for c in ("run", "tier", "shard", "_arrival", "arrival", "at", "path", "bytes", "version")))
    out = shards.sharded(clashing, base_bytes=1 << 14).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.collect()) and out[0].run.startswith("run-")
    other = shards.ShardStore(spark, str(tmp_path / "t"), fan_in=2, base_bytes=1 << 14)
    other.append(clashing, by="arrival")
    want = clashing.drop("arrival")
    assert key(other.read(want.schema).collect()) == key(want.collect())
    assert {r.where.tier for r in other.read(want.schema, where="where").collect()} == {r[1] for r in other.runs()}
    empty = shards.sharded(docs.where("doc_id < 0"))
    assert empty.count() == 0 and "shard" in empty.columns


def test_shards_of_two_writers(spark, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    one, two = (shards.ShardStore(spark, str(tmp_path / "s"), fan_in=2, base_bytes=1 << 20) for _ in range(2))
    for i in range(2):
        one.append(rows.where(f"doc_id % 2 = {i}"))
    # Two merges of the same runs: the second finds them gone.
    runs = one.runs()
    assert one.merge(runs, 0, rows.schema) == 3 and two.merge(runs, 0, rows.schema) is None
    assert sorted(r[0] for r in one.read(rows.schema).collect()) == list(range(100))
    # An append between another's plan and its claim: both stay.
    claim = two._claim

    def late(version, token):
        two._claim = claim
        one.append(spark.range(100, 110).withColumnRenamed("id", "doc_id"))
        return claim(version, token)

    two._claim = late
    two.append(spark.range(200, 210).withColumnRenamed("id", "doc_id"))
    assert sorted(r[0] for r in two.read(rows.schema).collect()) == [*range(110), *range(200, 210)] and two.versions() == [1, 2, 3, 4, 5]
    # What writers left that died before their claim, and a commit that holds no token, is no version.
    one._fs.create(one._path(f"{one.root}/commits/.new-dead/dead"), False).close()
    one._fs.mkdirs(one._path(f"{one.root}/commits/6"))
    assert one.read(rows.schema).count() == 120 and one.versions() == [1, 2, 3, 4, 5]
    one._fs.delete(one._path(f"{one.root}/commits/6"), True)
    one.append(spark.range(300, 301).withColumnRenamed("id", "doc_id"))
    assert one.compact(rows.schema) == one.versions()[-1] and one.read(rows.schema).count() == 121


def test_pipeline_equals_brute_force(spark, tmp_path, tik):
    import corpus_pipeline

    rng = random.Random(12)
    vocab = ["".join(rng.choice("abdefghklnprvwy") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(vocab) for _ in range(80)) for _ in range(240)]
    bench = [" ".join(rng.choice(vocab) for _ in range(15)) for _ in range(3)]
    for i in range(0, 240, 4):
        texts[i] += " idiot moron clown"
    texts += [t + " x" for t in texts[:20]] + [t + " " + bench[1] for t in texts[1:4]] + ["mail me a@b.cd " + texts[5], "", None]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("idiot" in (t or "")), 1) for i, t in enumerate(texts)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [(i, t) for i, t in enumerate(texts) if "idiot" not in (t or "")]
    comp = brute_components([t for _, t in left], 5, 80)
    left = [x for x, (i, c) in zip(left, enumerate(c for _, c in comp)) if i == c]
    left = [(i, t) for i, t in left if not brute_hits(t, list(enumerate(bench)))[4]]
    left = [(i, (t or "").replace("a@b.cd", "<EMAIL>")) for i, t in left]
    assert got == {i: (len(tik.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in left}


def test_shards_with_a_vacuum_between_plan_and_claim(spark, tmp_path, monkeypatch):
    ids = lambda a, b: spark.range(a, b).withColumnRenamed("id", "doc_id")
    late, other = (shards.ShardStore(spark, str(tmp_path / "s"), fan_in=99) for _ in range(2))
    late.append(ids(0, 10))
    # Versions count as followed long ago, files as young: what vacuum finds after a slow writer's plan.
    monkeypatch.setattr(shards.ShardStore, "_age", lambda self, path: 1e6 if path.startswith("commits") else 0.0)
    claim = late._claim

    def meanwhile(version, token):
        late._claim = claim
        for a in (10, 20, 30):
            other.append(ids(a, a + 10))
        other.vacuum()
        assert other.versions() == [4]
        return claim(version, token)

    late._claim = meanwhile
    assert late.append(ids(40, 50)) == 5
    assert sorted(r[0] for r in other.read(ids(0, 1).schema).collect()) == list(range(50))
    # The manifest that a change is planned on goes before it is read: planned anew, and nothing is lost.
    manifest = late.manifest

    def gone(version=None):
        late.manifest = manifest
        found = manifest(version)
        other.append(ids(50, 60))
        other.vacuum()
        return found

    late.manifest = gone
    assert late.append(ids(60, 70)) == 7
    assert sorted(r[0] for r in other.read(ids(0, 1).schema).collect()) == list(range(70)) and other.versions() == [6, 7]
    other.vacuum()
    assert other.versions() == [7] and len(other._names("commits", False)) == 7
    # Files of a writer that died go once they are old enough, those of the newest version stay.
    ids(0, 5).write.parquet(f"{late.root}/data/run-dead")
    other.vacuum(seconds=10)
    assert "run-dead" in other._names("data", False)
    other.vacuum(seconds=0)
    assert "run-dead" not in other._names("data", False) and other.read(ids(0, 1).schema).count() == 70
