"""Quality classifier: a factorisation machine (operator 6).

A document's features are its hashed words, each occurrence weighing one over their number, and for each structure
statistic (shares of kinds of characters, word and line repetition, lengths; the text's own size stands in for metadata)
the bin that its value falls in. Every pair of features interacts through the inner product of their short factor vectors;
by the identity sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2 a document is scored in time linear
in its words. The model is fitted by Adam on a bounded sample of labelled documents.

Cases: null and empty texts are scored by their statistics alone; texts of any length are read whole; repeated rows get
equal scores; without labelled rows of both kinds every score is 0; labels of a doc_id that repeats count as good if one
is; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import byte_table, chunks, hashes, lower_table, spans
from glossa.llm.toxicity import bounded_sample

WORDS, BINS, FACTORS = 1 << 14, 8, 8
#: Words weigh so much, all together, against one bin of a statistic.
WORD_WEIGHT = 4.0
SAMPLE = 3000
_LOWER = lower_table()
_WORD = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
_KINDS = {
    "upper": lambda b: 65 <= b < 91, "digit": lambda b: 48 <= b < 58, "blank": lambda b: b == 32, "line": lambda b: b == 10, "wide": lambda b: b >= 128,
    "stop": lambda b: b in b".,;:", "loud": lambda b: b in b"!?", "sign": lambda b: b in b"#$%&*@^~=+<>\\_", "bar": lambda b: b in b"|/", "bracket": lambda b: b in b"()[]{}\"'",
}
_CLASS = np.full(256, len(_KINDS), np.uint8)
for _i, _f in enumerate(_KINDS.values()):
    _CLASS[[b for b in range(256) if _f(b)]] = _i
STATISTICS = (*_KINDS, "letters", "bytes", "words", "word_length", "distinct", "again", "line_length", "lines_again", "top")


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed words of all texts, for each text the index of its first, statistics: a row per text)."""
    n = len(offs) - 1
    size = np.diff(offs)
    kind = _CLASS[data]
    text = np.repeat(np.arange(n), size)
    share = np.bincount(text * (len(_KINDS) + 1) + kind, minlength=n * (len(_KINDS) + 1)).reshape(n, -1) / np.maximum(size, 1)[:, None]
    s, e, of = spans(_WORD[data], offs)
    h = hashes(_LOWER[data], s, e)
    words = np.diff(of)
    owner = np.repeat(np.arange(n), words)
    length = np.bincount(owner, e - s, n) / np.maximum(words, 1)
    by = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (owner[by][1:] != owner[by][:-1])
    distinct = np.bincount(owner[by][new], minlength=n) / np.maximum(words, 1)
    run = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, owner[by][new], run)
    again = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / np.maximum(words, 1)
    ls, le, lof = spans(data != 10, offs)
    lines = np.diff(lof)
    lowner = np.repeat(np.arange(n), lines)
    key = np.stack([lowner.astype(np.uint64), hashes(data, ls, le)])
    key = key[:, np.lexsort(key[::-1])]
    fresh = np.ones(key.shape[1], bool)
    fresh[1:] = (key[:, 1:] != key[:, :-1]).any(0)
    once = np.bincount(key[0, fresh].astype(np.int64), minlength=n)
    rest = [np.log1p(size), np.log1p(words), length, distinct, again, np.log1p(size / np.maximum(lines, 1)), 1 - once / np.maximum(lines, 1), top / np.maximum(words, 1)]
    return (h & np.uint64(WORDS - 1)).astype(np.int64), of, np.concatenate([share, np.stack(rest, 1)], 1)


def _binned(stats: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Feature numbers of the bins: a column per statistic."""
    return np.stack([WORDS + i * BINS + np.searchsorted(c, stats[:, i], side="right") for i, c in enumerate(cuts)], 1)


def _rows(words, of, stats, cuts):
    """Sparse rows: (feature numbers, values, where each text begins), its words before its bins."""
    n, k = stats.shape
    size = np.diff(of)
    at = of[:-1] + np.arange(n) * k
    index, value = np.empty(len(words) + n * k, np.int64), np.ones(len(words) + n * k, np.float32)
    place = np.arange(len(words)) + np.repeat(np.arange(n) * k, size)
    index[place], value[place] = words, np.repeat(WORD_WEIGHT / np.maximum(size, 1), size)
    index[(at + size)[:, None] + np.arange(k)] = _binned(stats, cuts)
    return index, value, at


def _forward(index, value, at, w, v):
    """(scores, sums of factor vectors) of sparse rows."""
    x = v[index] * value[:, None]
    total = np.add.reduceat(x, at)
    return np.add.reduceat(w[index] * value, at) + 0.5 * ((total**2).sum(1) - np.add.reduceat((x**2).sum(1), at)), total


def fit(texts: list[str], labels: list[int], epochs: int = 12, batch: int = 64) -> dict | None:
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    some = []
    for i in range(0, len(texts), 200):  # a part of the sample at a time: its arrays take many times its bytes
        raw = [t.encode() for t in texts[i : i + 200]]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words, of, stats = features(np.frombuffer(b"".join(raw), np.uint8), offs)
        some.append((words.astype(np.int32), np.diff(of), stats))
    words, sizes, stats = (np.concatenate(x) for x in zip(*some))
    of = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    rng = np.random.default_rng(11)
    size = WORDS + len(STATISTICS) * BINS
    par = {"w": np.zeros(size, np.float32), "v": rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32), "b": np.zeros(1, np.float32)}
    first, second, step = {k: np.zeros_like(p) for k, p in par.items()}, {k: np.zeros_like(p) for k, p in par.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), batch):
            some = order[start : start + batch]
            part = np.concatenate([words[of[i] : of[i + 1]] for i in some])
            index, value, at = _rows(part, np.concatenate([[0], np.cumsum([of[i + 1] - of[i] for i in some])]), stats[some], cuts)
            out, total = _forward(index, value, at, par["w"], par["v"])
            slope = 1 / (1 + np.exp(-np.clip(out + par["b"][0], -30, 30))) - y[some]
            each = (np.repeat(slope, np.diff(np.append(at, len(index)))) * value).astype(np.float32)
            owner = np.repeat(np.arange(len(some)), np.diff(np.append(at, len(index))))
            pull = each[:, None] * (total[owner] - par["v"][index] * value[:, None])
            used, back = np.unique(index, return_inverse=True)
            grad = {"b": (np.array([0]), np.array([slope.sum()])), "w": (used, np.bincount(back, each) + 1e-3 * par["w"][used]),
                    "v": (used, np.stack([np.bincount(back, pull[:, f]) for f in range(FACTORS)], 1) + 1e-3 * par["v"][used])}
            step += 1
            for k, (rows, g) in grad.items():
                g = g / len(some)
                first[k][rows] = 0.9 * first[k][rows] + 0.1 * g
                second[k][rows] = 0.99 * second[k][rows] + 0.01 * g**2
                par[k][rows] -= 0.02 * first[k][rows] / (np.sqrt(second[k][rows]) + 1e-6) / (1 - 0.9 ** min(step, 200))
    return {**par, "cuts": cuts}


def score_texts(data: np.ndarray, offs: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(offs) - 1)
    words, of, stats = features(data, offs)
    out, _ = _forward(*_rows(words, of, stats, model["cuts"]), model["w"], model["v"])
    return 1 / (1 + np.exp(-np.clip(out.astype(float) + model["b"][0], -50, 50)))


def rated(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """key, held_out, score, predicted of each document; rows whose fold is held are not learnt from."""
    fold = F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds))
    train: Column = fold != held
    shared = docs.sparkSession.sparkContext.broadcast(fit(*bounded_sample(docs, labels, "quality", train, key, text, SAMPLE)))

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(data, offs, shared.value))], [key, "score"])

    rows = docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
    return rows.select(key, F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
