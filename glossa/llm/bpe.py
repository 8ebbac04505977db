"""Byte-level BPE encoding and decoding (operator 9).

A text is cut into pre-tokens by the tokenizer's pattern; the cut is made on arrays of character classes. The bytes of a
pre-token are the leaves of a segment tree that holds, at each node, the least rank of a pair that starts below it. The
root tells the next merge, the way down that prefers the left child finds its leftmost place, and a merge changes three
leaves: the merged pair's own, its right part's (which dies) and that of the live neighbour on the left. Short
pre-tokens are merged side by side as rows of arrays, long ones one at a time; a worker keeps what it has merged.

Cases: a null or empty text has no tokens; texts of any length are taken whole; bytes that are not UTF-8 become U+FFFD;
repeated rows give repeated results; other columns are ignored."""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glossa.llm.common import chunks

#: Pre-tokens that a worker remembers, and the bytes of the longest of them.
REMEMBERED, SHORT = 1 << 17, 64
LETTER, NUMBER, SPACE = 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
NONE = np.int32(2**31 - 1)


@cache
def char_classes() -> np.ndarray:
    """Code point to LETTER, NUMBER, SPACE or 0."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[list(WHITE_SPACE)] = SPACE
    return out


def piece_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """True where a pre-token begins. points: the code points of several texts; borders: where texts begin."""
    n, kind = len(points), char_classes()[points]
    first = np.zeros(n + 2, bool)
    first[borders[borders < n]] = True
    first[n:] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # White space before something else gives up its last character: a blank joins what follows, others stand alone.
    e = np.flatnonzero(start[1:n] & ~first[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[e - 1] = True
    start[e[points[e - 1] == 32]] = False
    # Contractions: a lone apostrophe at the start of a match takes the letters that follow it.
    q = np.flatnonzero((points == 39) & start[:n])
    q = q[(q + 1 < n)]
    q = q[(kind[q + 1] == LETTER) & ~first[q + 1]]
    if len(q):
        a, b = points[q + 1], np.where(first[q + 2], 0, points[np.minimum(q + 2, n - 1)])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        q, size = q[one | two], np.where(one, 1, 2)[one | two]
        start[q + 1] = False
        start[q + 1 + size] = True
    return start[:n]


class Vocabulary:
    """Ranks of a tiktoken file, and the rank of each pair of tokens whose bytes together are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.table = [b""] * (max(self.ranks.values()) + 1)
        pairs = []
        for t, r in self.ranks.items():
            self.table[r] = t
            pairs += [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        pairs.sort()
        self.keys, self.values = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int32)
        self.pairs = dict(pairs)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[bytes, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.values[at], NONE)

    def merge_short(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Merges pieces of up to width bytes (a power of two) side by side: one tree a row."""
        p = len(pieces)
        size = np.fromiter(map(len, pieces), np.int32, p)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(p, width)
        ids = np.concatenate([self.single[raw], np.zeros((p, 1), np.int32)], 1)
        place = np.arange(width + 1, dtype=np.int32)
        right = np.where(place + 1 < size[:, None], place + 1, width).astype(np.int32)
        left = np.broadcast_to(np.where(place > 0, place - 1, width), (p, width + 1)).astype(np.int32).copy()
        tree = np.full((p, 2 * width), NONE, np.int32)
        pairs = self.pair_ranks(ids[:, : width - 1], ids[:, 1:width])
        tree[:, width : 2 * width - 1] = np.where(place[1:width] < size[:, None], pairs, NONE)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        dead = np.broadcast_to(place[:width] >= size[:, None], (p, width)).copy()
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            rank, node = tree[rows, 1], np.ones(len(rows), np.int32)
            while node[0] < width:
                node *= 2
                node += tree[rows, node] != rank
            i = node - width
            j = right[rows, i]
            k, h = right[rows, j], left[rows, i]
            ids[rows, i] = rank
            right[rows, i] = k
            left[rows, k] = i
            dead[rows, j] = True
            mine = np.where(k < width, self.pair_ranks(rank, ids[rows, k]), NONE)
            before = np.where(h < width, self.pair_ranks(ids[rows, h], rank), NONE)
            for leaf, value in ((j, NONE), (i, mine), (np.where(h < width, h, i), np.where(h < width, before, mine))):
                node = leaf + width
                tree[rows, node] = value
                while node[0] > 1:
                    node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] != NONE]
        live = ids[:, :width][~dead].astype("<u4").tobytes()
        ends = np.cumsum((~dead).sum(1)) * 4
        return [live[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one piece of any length, on lists."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none, pairs, ids = int(NONE), self.pairs, [int(self.single[b]) for b in piece]
        right, left = [*range(1, n), -1], [*range(-1, n - 1)]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = pairs.get(ids[i] << 32 | ids[i + 1], none)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least

        while (rank := tree[1]) != none:
            i = 1
            while i < width:
                i *= 2
                i += tree[i] != rank
            i -= width
            j = right[i]
            k, h = right[j], left[i]
            ids[i], right[i], ids[j] = rank, k, -1
            put(j, none)
            if k >= 0:
                left[k] = i
            put(i, pairs.get(rank << 32 | ids[k], none) if k >= 0 else none)
            if h >= 0:
                put(h, pairs.get(ids[h] << 32 | rank, none))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """The ids of new pieces; the short ones are added to those that are known."""
        new: dict[bytes, bytes] = {}
        by: dict[int, list[bytes]] = {}
        for x in pieces:
            if (r := self.ranks.get(x)) is not None:
                new[x] = r.to_bytes(4, "little")
            elif len(x) > SHORT:
                new[x] = self.merge_long(x)
            else:
                by.setdefault(max(4, 1 << (len(x) - 1).bit_length()), []).append(x)
        for width, some in by.items():
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                new.update(zip(part, self.merge_short(part, width)))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        self.known.update((x, y) for x, y in new.items() if len(x) <= SHORT)
        return new

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece its ids, as little-endian unsigned 32-bit integers."""
        out = list(map(self.known.get, pieces))
        if None in out:
            more = self.learn({x for x, y in zip(pieces, out) if y is None})
            out = [more[x] if y is None else y for x, y in zip(pieces, out)]
        return out

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def split_pieces(data: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The pre-tokens of several texts, the bytes where they start, for each text its first, and the (valid) offsets of texts."""
    raw = data.tobytes()
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        parts = [raw[a:b].decode(errors="replace").encode() for a, b in zip(offs[:-1], offs[1:])]
        raw, offs = b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        text, data = raw.decode(), np.frombuffer(raw, np.uint8)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    starts = at[piece_starts(points, np.searchsorted(at, offs[:-1]))]
    begin = starts.tolist()
    return [raw[a:b] for a, b in zip(begin, [*begin[1:], len(raw)])], starts, np.searchsorted(starts, offs), offs


def encode_texts(data: np.ndarray, offs: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """For each text its ids, as little-endian unsigned 32-bit integers."""
    pieces, _, of, _ = split_pieces(data, offs)
    ids = vocab.encode_pieces(pieces)
    of = of.tolist()
    return [b"".join(ids[a:b]) for a, b in zip(of[:-1], of[1:])]


def encode_text(text: str, vocab: Vocabulary) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.frombuffer(encode_texts(raw, np.array([0, len(raw)], np.int64), vocab)[0], "<u4").tolist()


def encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, token_ids (array of int): the ids of each whole text."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part, data, offs in chunks(batch, text):
                ids = encode_texts(data, offs, vocab)
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                at = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, flat)], [key, "token_ids"])

    docs = docs.select(key, text)
    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, token_ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, decoded (binary): the bytes of each row of token_ids (null: no bytes)."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            out = [vocab.decode(np.asarray(x.values, "<u4").tobytes()) if x.is_valid else b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "decoded"])

    encoded = encoded.select(key, "token_ids")
    return encoded.mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the bytes that they decode to, made in one pass."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part, data, offs in chunks(batch, text):
                ids = encode_texts(data, offs, vocab)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(vocab.decode(x)).hexdigest() for x in ids])],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    docs = docs.select(key, text)
    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
