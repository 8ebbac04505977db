"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks (operator 3).

A text is read as segments: runs without white space, of which the letters count (a few digits and signs stand for the
letters they imitate); single letters in a row are one segment, so spaced-out words are whole again. The kernel of two
segments compares their subsequences of three letters within SPAN + 1, each weighted by DECAY to the power of the length
it covers, so inserted characters and gaps weaken a match but don't break it. Landmarks are segments of the sample; on
their Nystroem map a linear SVM is trained. As kernel values are inner products of explicit feature vectors, the landmarks'
weights collapse into one table over letter triples, and a segment is scored by a sum of table entries.

Labels belong to documents. A toxic sentence is one whose most toxic segment is toxic, a toxic document one that has such a
sentence: the SVM learns from the witness of each toxic document, chosen anew each round, against segments of the others.
A logistic curve, fitted on the sample, turns a document's greatest margin into its score.

Cases: null and empty texts, and texts without letters, get the score of a text without any segment; texts of any length
are read whole; repeated rows get equal scores; without labelled rows of both kinds, or a segment that stands out in toxic ones, every score is 0; labels of a doc_id
that repeats count as toxic if one is; other columns are ignored."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import chunks

SPAN, DECAY, TABLE = 5, 0.7, 1 << 16
PAIRS = [(a, b, DECAY ** (b + 1)) for a, b in combinations(range(1, SPAN + 1), 2)]
#: Bounds of the sample that a model is fitted on: documents of each label, and bytes of a document.
SAMPLE, SAMPLE_BYTES = 2500, 20_000
LANDMARKS, ROUNDS, LEAST_ODDS = 256, 4, 1.5
#: Further bounds of the fit (none of a score): bytes of a segment that can be a witness; segments of clean documents taken at random, and
#: hard ones added a round; and how many kept documents with an equal least hash a document is held against to find copies in the
#: sample. Where more than COPIES kept ones share a hash, a copy of an earlier one may stay and count once more.
WITNESS_BYTES, NEGATIVES, HARD, COPIES = (5, 42), 5000, 300, 20
#: A document is judged by its TOP greatest margins (of different segments), each taken between FLOOR and CEILING.
TOP, FLOOR, CEILING = 3, -0.5, 2.0
#: Letters that digits and signs imitate.
IMITATED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


def _letter_table() -> np.ndarray:
    """Byte to letter (1-26; 27-58: second bytes of letters outside ASCII, case folded), 0 (dropped) or 255 (white space)."""
    t = np.zeros(256, np.uint8)
    t[128:192] = 27 + (np.arange(128, 192) & 31)
    for b in range(26):
        t[65 + b] = t[97 + b] = b + 1
    for c, like in IMITATED.items():
        t[ord(c)] = ord(like) - 96
    t[[32, *range(9, 14)]] = 255
    return t


_TABLE = _letter_table()


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all segments with a 0 at both ends of each, where segments begin, for each text the index of its first segment)."""
    kind = _TABLE[data]
    border = np.zeros(len(kind) + 1, bool)
    border[offs[offs <= len(kind)]] = True
    word = np.cumsum((kind == 255) | border[:-1])
    at = np.flatnonzero((kind > 0) & (kind < 255))
    letters, word = kind[at], word[at]
    first = np.ones(len(at), bool)
    first[1:] = word[1:] != word[:-1]
    starts = np.flatnonzero(first)
    single = np.diff(np.append(starts, len(at))) == 1
    text = np.searchsorted(offs, at[starts], side="right")
    keep = np.ones(len(starts), bool)
    keep[1:] = ~(single[1:] & single[:-1] & (text[1:] == text[:-1]))
    starts = starts[keep]
    of = np.searchsorted(at[starts], offs)
    size = np.diff(np.append(starts, len(at)))
    out = np.zeros(len(at) + 2 * len(starts), np.uint8)
    out[np.arange(len(at)) + 2 * np.repeat(np.arange(len(starts)), size) + 1] = letters
    return out, starts + 2 * np.arange(len(starts)), of


def _code(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A place in the table for a triple of letters (uint32)."""
    return ((x << np.uint32(12) | y << np.uint32(6) | z) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def norm(n: np.ndarray) -> np.ndarray:
    """The length of a segment's feature vector, by its number of letters, as if no triple came twice."""
    return np.sqrt(np.maximum(sum(w * w * np.maximum(0, n - b) for _, b, w in PAIRS), 1e-9))


def _each(letters: np.ndarray, starts: np.ndarray):
    """For each way to choose a triple: (places of its first letter, codes, weight)."""
    n = len(letters)
    left = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))) - np.arange(n) if len(starts) else np.zeros(0, np.int64)
    wide = letters.astype(np.uint32)
    for a, b, w in PAIRS:
        if n > b:
            at = np.flatnonzero(left[: n - b] > b)
            yield at, _code(wide[at], wide[at + a], wide[at + b]), w


def margins(letters: np.ndarray, starts: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The SVM's margin for each segment."""
    n = len(letters)
    if not len(starts):
        return np.zeros(0, np.float32)
    ends = np.append(starts[1:], n)
    left = (np.repeat(ends, ends - starts) - np.arange(n)).astype(np.int16 if n < 1 << 15 else np.int32)
    wide, total = letters.astype(np.uint32), np.zeros(n, np.float32)
    for a, b, w in PAIRS:
        if n > b:
            total[: n - b] += np.where(left[: n - b] > b, table[_code(wide[: n - b], wide[a : n - b + a], wide[b:])] * np.float32(w), np.float32(0))
    return np.add.reduceat(total, starts) / norm(ends - starts) + np.float32(bias)


def _features(words: list[bytes]) -> np.ndarray:
    """Normalised feature vectors (dense columns) of segments given as letters."""
    letters = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(x) for x in words])
    starts = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    out = np.zeros((TABLE, len(words)), np.float32)
    for at, code, w in _each(letters, starts):
        np.add.at(out, (code, of[at]), np.float32(w))
    out /= norm(size).astype(np.float32)
    return out


def _kernel(words: list[bytes], columns: np.ndarray) -> np.ndarray:
    """Kernel values of words (rows) with landmarks, whose feature vectors are the columns."""
    out = np.empty((len(words), columns.shape[1]), np.float32)
    for i in range(0, len(words), 500):
        some = words[i : i + 500]
        letters = np.frombuffer(b"".join(some), np.uint8)
        size = np.array([len(x) for x in some])
        starts = np.cumsum(size) - size
        total = np.zeros((len(letters), columns.shape[1]), np.float32)
        for at, code, w in _each(letters, starts):
            total[at] += columns[code] * np.float32(w)
        out[i : i + 500] = np.add.reduceat(total, starts, 0) / norm(size)[:, None]
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss (weight: of each row), by Newton steps on the rows inside the margin."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    ridge, w, before = np.diag(np.append(np.ones(x.shape[1] - 1), 1e-3)), np.zeros(x.shape[1]), None
    for _ in range(steps):
        inside = y * (x @ w) < 1
        if before is not None and (inside == before).all():
            break
        before, some = inside, x[inside] * weight[inside][:, None]
        w = np.linalg.solve(ridge + some.T @ x[inside], some.T @ y[inside])
    return w[:-1], w[-1]


def _logistic(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last: a constant) of a logistic model, by Newton steps with a little ridge."""
    x = np.concatenate([m, np.ones((len(m), 1))], 1)
    t = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        t = t - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-1 * np.eye(len(t)), x.T @ (p - y) + 1e-1 * t)
    return t


def _near(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """word with one letter more at each inner place."""
    return [word[:i] + bytes([int(rng.integers(1, 27))]) + word[i:] for i in range(2, len(word) - 1)]


def _without_copies(docs: list[list[bytes]]) -> list[int]:
    """The documents of a sample that don't share half of their segments with one before them, as least hashes tell."""
    kept: dict[int, list[int]] = {}
    out = []
    for i, words in enumerate(docs):
        least = [min((zlib.crc32(w, k) for w in words), default=k) for k in range(4)]
        mine = set(words)
        if words and any(2 * len(mine & (other := set(docs[j]))) >= len(mine | other) for h in least for j in kept.get(h, [])[-COPIES:]):
            continue
        out.append(i)
        for h in least:
            kept.setdefault(h, []).append(i)
    return out


def fit(texts: list[str], labels: list[int]) -> dict | None:
    """The model from documents and their labels; None unless both labels occur and a segment tells them apart."""
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(7)
    number: dict[bytes, int] = {}
    ids, ends = array("i"), [0]
    for i in range(0, len(texts), 200):  # a part of the sample at a time: its arrays take many times its bytes
        raw = [t.encode() for t in texts[i : i + 200]]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        letters, starts, of = segments(np.frombuffer(b"".join(raw), np.uint8), offs)
        flat = letters.tobytes()
        ends += [len(ids) + k for k in of[1:].tolist()]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(flat)]):
            ids.append(number.setdefault(flat[a:b], len(number)))
    names, ids, of = list(number), np.frombuffer(ids, np.int32), np.array(ends)
    letters, size = np.frombuffer(b"".join(names), np.uint8), np.array([len(w) for w in names], np.int64)
    starts = np.cumsum(size) - size
    docs = [sorted({w for i in np.unique(ids[a:b]).tolist() if WITNESS_BYTES[0] <= len(w := names[i]) <= WITNESS_BYTES[1]}) for a, b in zip(ends, ends[1:])]
    seen: dict[bytes, list[int]] = {}
    single = _without_copies(docs)
    for i in single:
        for w in docs[i]:
            seen.setdefault(w, [0, 0])[y[i]] += 1
    n = np.bincount(y[single], minlength=2)
    # Witnesses of toxic documents are taken among the segments whose log odds, bounded from below, stand out.
    mean = lambda c: np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
    odds = {w: x for w, c in seen.items() if c[1] >= 3 and (x := mean(c)) > 2 * LEAST_ODDS and x - 3 * np.sqrt(1 / (c[1] + 0.5) + 1 / (c[0] + 0.5)) > 0.25 * LEAST_ODDS}
    clean = sorted({w for words, label in zip(docs, y) if not label for w in words})
    rest = [clean[i] for i in rng.permutation(len(clean))[:NEGATIVES]]
    hard: list[bytes] = []
    score = odds
    for _ in range(ROUNDS):
        witness = [w for words, label in zip(docs, y) if label for w in words if w in odds and score[w] > -0.5]
        best = [w for w, k in Counter(witness).most_common(LANDMARKS)]
        if not best:
            return None
        more = [x for w in best for x in _near(w, rng)]
        negative = [w for w in dict.fromkeys(rest + hard) if w not in set(best)]
        marks = (best + hard + rest)[: max(LANDMARKS, min(len(best), LANDMARKS) * 2)]
        columns = _features(marks)
        value, vector = np.linalg.eigh((columns.T @ columns).astype(float))
        root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
        x = _kernel(best + more + negative, columns) @ root
        sign = np.array([1.0] * (len(best) + len(more)) + [-1.0] * len(negative))
        weight = 20 * np.concatenate([np.full(len(best), 50.0), np.full(len(more), 2.0), [min(100.0, 2.0 + 5 * seen.get(w, (0, 0))[0]) for w in negative]])
        w, bias = _svm(x, sign, weight)
        own = root @ w
        table = np.concatenate([columns[i : i + 4096] @ own for i in range(0, TABLE, 4096)]).astype(np.float32)  # in parts: doubles of all columns take 268 MB
        del columns
        m = margins(letters, starts, table, bias)
        score = dict(zip(names, m.tolist()))
        hard = list(dict.fromkeys(hard + sorted(clean, key=lambda w: (-score[w], w))[:HARD]))
    return {"table": table, "bias": float(bias), "curve": _logistic(_top(m[ids], of), y)}


def _top(m: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The TOP greatest different margins of each text, down to FLOOR."""
    out = np.full((len(of) - 1, TOP), FLOOR)
    at = np.flatnonzero(m > FLOOR)
    text, m = np.searchsorted(of, at, side="right") - 1, m[at]
    by = np.lexsort((-m, text))
    text, m = text[by], m[by]
    new = np.ones(len(m), bool)
    new[1:] = (text[1:] != text[:-1]) | (m[1:] != m[:-1])
    text, m = text[new], m[new]
    rank = np.arange(len(m)) - np.searchsorted(text, text)
    some = rank < TOP
    out[text[some], rank[some]] = np.minimum(m[some], CEILING)
    return out


def score_texts(data: np.ndarray, offs: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(offs) - 1)
    letters, starts, of = segments(data, offs)
    top = _top(margins(letters, starts, model["table"], model["bias"]), of)
    return 1 / (1 + np.exp(-np.clip(top @ model["curve"][:-1] + model["curve"][-1], -50, 50)))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, key: str = "doc_id", text: str = "text", size: int = SAMPLE, most: int = SAMPLE_BYTES) -> DataFrame:
    """key, text and y (the label) of at most size documents of each label, where train holds and the text has at most most bytes.

    The size labelled ids of each label with the least hashes are asked; their different texts, of which an id may have many,
    are counted by hashes, and the first size of a label by (hash of the id, hash of the text) are fetched."""
    of = labels.where(F.col(label).isin(0, 1) & train).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    chosen = of.where("y = 0").orderBy(F.xxhash64(key), key).limit(size).unionAll(of.where("y = 1").orderBy(F.xxhash64(key), key).limit(size))
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("text")).where(F.octet_length("text") <= most)
    ids = rows.join(F.broadcast(chosen), key).select(key, "y", F.xxhash64("text").alias("h")).distinct()
    picked = None
    for y in (0, 1):
        some = ids.where(F.col("y") == y).orderBy(F.xxhash64(key), key, "h").limit(size)
        picked = some if picked is None else picked.unionAll(some)
    picked = picked.select(F.col(key).alias("_key"), F.col("h").alias("_h"), "y")
    return rows.join(F.broadcast(picked), (F.col(key) == F.col("_key")) & (F.xxhash64("text") == F.col("_h"))).groupBy(key, "text").agg(F.max("y").alias("y"))


def _in_order(rows: pa.Table, key: str) -> tuple[list[str], list[int]]:
    got = rows.sort_by([(key, "ascending"), ("text", "ascending")])
    return got["text"].to_pylist(), got["y"].to_pylist()


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, key: str = "doc_id", text: str = "text", size: int = SAMPLE, most: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """The texts and labels of such a sample, in the order of key and text."""
    return _in_order(sample(docs, labels, label, train, key, text, size, most).toArrow(), key)


def scored(docs: DataFrame, model: dict | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = text if text in keep else "_text"

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, source):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(score_texts(data, offs, shared.value))], [*keep, "score"])

    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(source))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"]))


def without(docs: DataFrame, model: dict | None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that score below the threshold."""
    kinds, shared = docs.schema, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, text):
                yield part.filter(pa.array(score_texts(data, offs, shared.value) < threshold))

    return docs.mapInArrow(run, kinds)


def trained(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id") -> dict | None:
    """The model of a bounded sample, fitted by one task, which can be repeated; the driver gets the table and the curve alone."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got and (model := fit(*_in_order(pa.Table.from_batches(got), key))):
            yield pa.RecordBatch.from_pydict({"table": [model["table"].tobytes()], "bias": [model["bias"]], "curve": [model["curve"].tolist()]})

    found = sample(docs, labels, "toxic", train, key).repartition(1).mapInArrow(run, "table binary, bias double, curve array<double>").head()
    return found and {"table": np.frombuffer(found["table"], np.float32), "bias": found["bias"], "curve": np.array(found["curve"])}


def rated(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted of each document; rows whose fold is held are not learnt from."""
    fold = F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds))
    rows = scored(docs, trained(docs, labels, fold != held, key), [key])
    return rows.select(key, F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
