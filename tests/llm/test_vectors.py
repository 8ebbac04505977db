"""Cover trees, ranked search and whitening, held against plain versions."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from glossa.llm import covertree, lexical, whiten

NAN, INF = float("nan"), float("inf")


def _groups(n, pairs):
    root = list(range(n))
    for x, y in sorted(pairs):
        a, b = root[x], root[y]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def _clusters(rows, threshold):
    """(n_links, component_id, kept) of rows (id, vector, label), pair by pair."""
    unit = []
    for _, v, lab in rows:
        v = None if v is None or lab is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, float)
        unit.append(None if v is None else (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()))
    wide = max((len(u) for u in unit if u is not None), default=0)
    unit = [None if u is None else np.pad(u, (0, wide - len(u))) for u in unit]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= threshold]
    n, root = Counter(x for p in pairs for x in p), _groups(len(rows), pairs)
    least = [min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    return [(n[i], least[i], rows[i][0] == least[i]) for i in range(len(rows))]


def _vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dims))
    out = [(int(i), (base[rng.integers(len(base))] + rng.normal(size=dims) * spread).tolist(), int(rng.integers(3))) for i in range(n)]
    return out + [(n + i, out[0][1], out[0][2]) for i in range(12)]


def _found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return sorted(map(tuple, covertree.clusters(df, **more).collect()), key=str)


@pytest.mark.parametrize(("dims", "spread", "block"), [(3, 0.2, 2048), (3, 0.2, 24), (16, 0.15, 24), (16, 1e-9, 24), (48, 5.0, 24)])
def test_clusters_as_pair_by_pair(spark, monkeypatch, dims, spread, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rows = _vectors(dims, 240, dims, spread)
    assert _found(spark, rows) == sorted([(r[0], *c) for r, c in zip(rows, _clusters(rows, 0.93))], key=str)


def test_clusters_of_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [2.0, 4.0], 1), (None, [1.0, 2.0], 1), (4, [1.0, 2.0], None), (5, [0.0, 0.0], 1), (6, [], 1), (7, None, 1), (8, [1.0, None], 1), (9, [NAN], 1), (10, [1.0, 2.0, 0.0], 1), (11, [INF, 1.0], 1), (12, [1.0, 2.0], 2), (13, [1e-200, 2e-200], 2), (None, [5.0, -1.0], 3)]
    assert _found(spark, rows) == sorted([(r[0], *c) for r, c in zip(rows, _clusters(rows, 0.93))], key=str)
    assert _found(spark, []) == []
    odd = spark.createDataFrame([("b", 1, [1.0, 0.0], "x", 3), ("a", 2, [1.0, 0.1], "x", 4)], "name string, ck int, v array<float>, of string, node int")
    assert sorted(map(tuple, covertree.clusters(odd, key="name", vector="v", label="of").collect())) == [("a", 1, "a", True), ("b", 1, "a", False)]


def test_a_tree_covers_and_drops():
    rng = np.random.default_rng(3)
    u = covertree.units(rng.normal(size=(2000, 2)) + 3 * rng.normal(size=(8, 2))[rng.integers(8, size=2000)])
    order, balls = covertree.cover(u)
    lo, hi, radius = (np.array(x) for x in zip(*balls))
    assert sorted(order.tolist()) == list(range(2000))
    assert all((covertree.distances(u[order[a:b]], u[order[a]][None]) <= r + 1e-7).all() for a, b, r in balls)
    tree = covertree.Tree(u[order], lo, hi, radius)
    assert all(radius[k] <= radius[p] + covertree.EPS for p in range(len(lo)) for k in tree.kids[tree.start[p] : tree.start[p + 1]])
    stats, tau = {}, math.sqrt(2 - 2 * 0.9999)
    found = sum(int((b - a).sum()) for a, b, _, _ in covertree.dual(tree, None, tau, 0.9999, stats))
    assert found and stats["looked"] < 2000 * 1999 / 2 / 10  # on a circle most pairs of balls are dropped, or linked whole


def _searched(docs, items, k, repeats=False):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    have = [(d, Counter(w)) for d, t in docs if (w := words(t))]
    total, df = sum(c.total() for _, c in have), Counter(t for _, c in have for t in c)
    out = []
    for item in {i for i, _ in items if i is not None}:
        asked = Counter(t for i, text in items if i == item for t in words(text))
        scores = []
        for d, c in have:
            m = 50 + (50 * c.total() * len(have)) // total
            s = sum((n if repeats else 1) * math.floor(1000 * math.log((2 * len(have) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, n in asked.items() if c[t])
            scores += [(d, s)] if s > 0 else []
        scores.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, i + 1, *x) for i, x in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("repeats", [False, True])
def test_search_as_document_by_document(spark, monkeypatch, repeats):
    monkeypatch.setattr(lexical, "ITEMS", 7)
    monkeypatch.setattr(lexical, "BLOCK", 13)
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(["Ab", "cd", "É1", "x", "yy-z", "7", "ab", "-"], n, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]))
    docs = [(int(rng.integers(60)), text(int(rng.integers(0, 30)))) for _ in range(150)] + [(None, "ab cd"), (3, None), (4, ""), (5, "yy " * 40_000), (None, "ab cd")]
    items = [(int(i), text(int(rng.integers(0, 9)))) for i in rng.integers(30, size=40)] + [(None, "ab"), (99, None), (98, "nowhere")]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k=6, repeats=repeats)
    assert sorted(map(tuple, got.collect()), key=str) == _searched(docs, items, 6, repeats)


def test_search_of_awkward_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "t"), (2, "b", 8, "u")], "doc_id long, text string, score int, terms string")
    items = spark.createDataFrame([("i", "A", 1), ("e", "", 2)], "item_id string, text string, rank int")
    assert [r["doc_id"] for r in lexical.ranked(docs, items).collect()] == [1]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id > 9"), items.limit(0))):
        out = lexical.ranked(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and not out.count()


def test_lengths_beyond_64_bits():
    assert lexical.lengths(np.array([3, 10**12]), 10**9, 10**13).tolist() == [50 + 50 * 3 * 10**9 // 10**13, 50 + 50 * 10**12 * 10**9 // 10**13]


def test_whitened_as_numpy(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * np.linspace(0.05, 1, 12)).tolist()
    rows = [(i, x, 1) for i, x in enumerate(v)] + [(900, None, 1), (901, [1.0, None], 1), (902, [NAN] * 12, 1), (903, [INF] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").repartition(4)
    got = {(r["vec_id"], r["component"]): r for r in whiten.whitened(df, k=8).collect()}
    assert len(got) == 300 * 8
    x = np.floor(1024 * np.array(v)).astype(np.int64) + 100_000
    off = 300 * x - x.sum(0)
    value, axes = np.linalg.eigh(off.T / 300 @ (off / 300) / 300)
    want = off / 300 @ axes[:, ::-1][:, :8] / np.sqrt(value[::-1][:8])
    for c in range(8):
        mine = np.array([got[i, c + 1]["whitened"] for i in range(300)])
        assert min(np.abs(mine - want[:, c]).max(), np.abs(mine + want[:, c]).max()) < 1e-8
        assert got[0, c + 1]["explained"] == pytest.approx(value[::-1][c] / value.sum(), rel=1e-9)
    assert all(got[i, 1]["deviation"] == int((off[i] ** 2).sum()) and got[i, 1]["n"] == 300 for i in range(300))
    assert got[0, 1]["identity_error"] < 1e-9


def test_whitened_of_awkward_tables(spark):
    kind = "vec_id long, embedding array<float>, x string, whitened int"
    rows = [(1, [1.0, 2.0], "a", 1), (1, [1.0, 2.0], "b", 2), (None, [3.0, 2.0], "c", 3), (9, [], "d", 4)]
    got = whiten.whitened(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((i, c) for i in ("1", "1", "9", "None") for c in (1, 2))
    assert {r["n"] for r in got} == {4} and sum(r["explained"] for r in got) == pytest.approx(4.0)
    same = whiten.whitened(spark.createDataFrame(rows[:2], kind)).collect()
    assert {(r["whitened"], r["explained"], r["deviation"]) for r in same} == {(None, 0.0, 0)}
    assert not whiten.whitened(spark.createDataFrame([], kind)).count()
    line = whiten.whitened(spark.createDataFrame([(1, [0.0, 1.0], "", 0), (2, [1.0, 1.0], "", 0)], kind)).collect()
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: r["component"])] == [False, False, True, True]
    huge = whiten.whitened(spark.createDataFrame([(1, [3e9], "", 0), (2, [-3e9], "", 0)], kind)).collect()
    assert {r["deviation"] for r in huge} == {None}
