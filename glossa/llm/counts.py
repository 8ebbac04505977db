"""Edit-aware token counts (operator 8).

A document is kept as a row of a table: its text, the lengths and token counts of its pre-tokens, and a segment tree over
runs of them (leaves) whose inner nodes hold the sums of characters and tokens below. An edit (replace the characters from
start to stop) goes down the tree by characters, cuts the pattern's pre-tokens anew from a little before the edit until a
new border meets an old one, encodes only what is new there, and updates the sums on the way up. A batch's trees lie side
by side in flat arrays: the first edits of all its documents go down together, are cut as one array and encoded together,
then the second ones, and so on; each edit works on the text that the ones before it left.

Cases: null and empty texts have no tokens and can be edited; positions beyond the end are drawn back to it, a stop below
its start counts as the start; documents without edits keep their counts; repeated rows are counted each by itself; edits
of one place in the order (seq) go by start, stop and text; other columns are ignored, attached replaces a column edits."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.bpe import piece_starts, split_pieces, vocabulary
from glossa.llm.common import chunks, free

#: Pre-tokens in a fresh leaf. Characters of context that decide where a pre-token of the pattern ends. Characters behind
#: an edit that are cut anew at first.
LEAF, CONTEXT, BEHIND = 64, 3, 32
#: A document's tree: lengths and counts of its pre-tokens, pre-tokens of each leaf, sums at its nodes (node 1 is the root).
TREE = {"lengths": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "leaves": pa.list_(pa.int32()), "node_chars": pa.list_(pa.int64()), "node_tokens": pa.list_(pa.int64())}
_DDL = "text string, lengths array<int>, counts array<int>, leaves array<int>, node_chars array<long>, node_tokens array<long>"
_NONE = np.zeros(0, np.int32)


def _lists(flat: np.ndarray, of: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(flat, kind.value_type))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an array of lists."""
    of = np.asarray(column.offsets)
    return np.asarray(column.values)[of[0] : of[-1]], (of - of[0]).astype(np.int64)


def _below(width: np.ndarray) -> np.ndarray:
    """Where each document's nodes begin (and the end), for trees of so many places for leaves."""
    return np.concatenate([[0], np.cumsum(2 * width)]).astype(np.int64)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every start, size of them."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


class Forest:
    """The trees of several documents. raw: their texts' bytes; lengths, counts, leaves and nodes (None: to be summed) as in
    the table, with of, leaf_of and base as their offsets by document. encode: pieces (bytes) to their numbers of tokens."""

    def __init__(self, raw: bytes, lengths, counts, of, leaves, leaf_of, encode, nodes=None, base=None):
        self.raw, self.lengths, self.counts, self.encode = raw, lengths, counts, encode
        n = np.diff(leaf_of)
        self.leaf_of, self.n_leaves = leaf_of[:-1].copy(), n.copy()
        self.width = 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(leaves)]).astype(np.int64)
        self.encoded = np.zeros(len(n), np.int64)
        self.changed: dict[int, tuple] = {}
        self._bytes = None
        if nodes is not None:
            (self.chars, self.tokens), self.base = nodes, base[:-1].copy()
        else:
            base = _below(self.width)
            self.base = base[:-1].copy()
            spot = _spread(self.base + self.width, n)
            sums = [np.zeros(base[-1], np.int64) for _ in range(2)]
            total = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (lengths, counts)]
            for s, t in zip(sums, total):
                s[spot] = np.diff(t[self.first])
            w = self.width >> 1
            while (some := w > 0).any():
                at, own = _spread(w[some], w[some]), np.repeat(self.base[some], w[some])
                for s in sums:
                    s[own + at] = s[own + 2 * at] + s[own + 2 * at + 1]
                w >>= 1
            self.chars, self.tokens = sums

    def leaf(self, d: int, k: int) -> tuple[str, np.ndarray, np.ndarray]:
        """Text, lengths and counts of leaf k of document d."""
        g = int(self.leaf_of[d]) + k
        if (x := self.changed.get(g)) is not None:
            return x
        if self._bytes is None:
            data = np.frombuffer(self.raw, np.uint8)
            at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            self._bytes = at[np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])[self.first]]
        a, b = self.first[g], self.first[g + 1]
        return self.raw[self._bytes[g] : self._bytes[g + 1]].decode(), self.lengths[a:b], self.counts[a:b]

    def find(self, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf that holds character at of each document (the last one with text, if at is the end), and the characters before it."""
        node, before, width, base = np.ones(len(docs), np.int64), np.zeros(len(docs), np.int64), self.width[docs], self.base[docs]
        rows = np.flatnonzero(node < width)
        while len(rows):
            left = base[rows] + 2 * node[rows]
            here = self.chars[left]
            right = (at[rows] >= before[rows] + here) & (self.chars[left + 1] > 0)
            before[rows] += np.where(right, here, 0)
            node[rows] = 2 * node[rows] + right
            rows = rows[node[rows] < width[rows]]
        return np.minimum(node - width, self.n_leaves[docs] - 1), before

    def _put(self, docs: np.ndarray, leaf: np.ndarray, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Sets the sums of leaves and of all nodes above them."""
        base, node = self.base[docs], self.width[docs] + leaf
        self.chars[base + node], self.tokens[base + node] = chars, tokens
        rows = np.flatnonzero(node > 1)
        while len(rows):
            node[rows] >>= 1
            at, child = base[rows] + node[rows], base[rows] + 2 * node[rows]
            self.chars[at], self.tokens[at] = self.chars[child] + self.chars[child + 1], self.tokens[child] + self.tokens[child + 1]
            rows = rows[node[rows] > 1]

    def _window(self, job: dict, behind: int) -> str:
        """Takes pre-tokens from before the edit to so many characters behind it into the job; returns their edited text."""
        d, lo, hi, start, stop = (job[x] for x in ("doc", "lo", "hi", "start", "stop"))
        text, lengths, counts, base = job["text"], job["lengths"], job["counts"], job["base"]
        ends = base + np.cumsum(lengths, dtype=np.int64)
        if "keep" not in job:
            # What stays before: the pre-tokens that end at least CONTEXT characters before the edit, but for one of them,
            # whose blanks may have been cut with regard to what follows.
            keep = int(np.searchsorted(ends, start - CONTEXT, side="right"))
            while keep == 0 and lo > 0:
                lo -= 1
                t, a, b = self.leaf(d, lo)
                keep, base = len(a), base - len(t)
                text, lengths, counts = t + text, np.concatenate([a, lengths]), np.concatenate([b, counts])
            job["keep"] = max(0, keep - 1)
            ends = base + np.cumsum(lengths, dtype=np.int64)
        more = [(text, lengths, counts)]
        have, n = int(ends[-1]) if len(ends) else base, int(self.n_leaves[d])
        while have < stop + behind and hi + 1 < n:
            hi += 1
            more.append(self.leaf(d, hi))
            have += len(more[-1][0])
        if len(more) > 1:
            text, lengths, counts = "".join(x[0] for x in more), np.concatenate([x[1] for x in more]), np.concatenate([x[2] for x in more])
            ends = base + np.cumsum(lengths, dtype=np.int64)
        upto = min(len(lengths), int(np.searchsorted(ends, stop + behind)) + 1)
        begin = int(ends[job["keep"] - 1]) if job["keep"] else base
        end = int(ends[upto - 1]) if upto else begin
        job |= dict(lo=lo, hi=hi, text=text, lengths=lengths, counts=counts, base=base, ends=ends, upto=upto, begin=begin, last=upto == len(lengths) and have >= int(self.chars[self.base[d] + 1]))
        return text[begin - base : start - base] + job["new"] + text[stop - base : end - base]

    def edit(self, docs: np.ndarray, start: np.ndarray, stop: np.ndarray, texts: list[str]) -> None:
        """One edit of each of several (different) documents."""
        n = self.chars[self.base[docs] + 1]
        start = np.clip(start, 0, n)
        stop = np.clip(stop, start, n)
        lo, before = self.find(docs, np.maximum(start - CONTEXT, 0))
        jobs = []
        for d, k, b, x, y, s in zip(docs.tolist(), lo.tolist(), before.tolist(), start.tolist(), stop.tolist(), texts):
            t, a, c = self.leaf(d, k)
            jobs.append(dict(doc=d, lo=k, hi=k, base=b, start=x, stop=y, new=s, text=t, lengths=a, counts=c))
        behind, done, fresh = BEHIND, [], []
        while jobs:
            after = [self._window(j, behind) for j in jobs]
            joined = "".join(after)
            border = np.concatenate([[0], np.cumsum([len(x) for x in after])])
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            mask = np.append(piece_starts(points, border[:-1]), False) if len(points) else np.zeros(1, bool)
            at = np.append(np.flatnonzero(mask), len(points))
            of, grown = np.searchsorted(at, border), []
            for i, j in enumerate(jobs):
                ends, keep, upto, shift = j["ends"], j["keep"], j["upto"], len(j["new"]) - (j["stop"] - j["start"])
                # Old borders beyond the edit; without the text's end the last pre-tokens may end otherwise.
                old = np.concatenate([[j["begin"]], ends[keep : upto - 1]]) if upto > keep else _NONE
                first = int(np.searchsorted(old, j["stop"]))
                spots = old[first : len(old) if j["last"] else max(len(old) - 2, first)] + (shift - j["begin"] + int(border[i]))
                met = np.flatnonzero(mask[spots]) if len(spots) else spots
                if len(met):
                    a, b, rest = int(of[i]), int(np.searchsorted(at, spots[met[0]])), keep + first + int(met[0])
                elif j["last"]:
                    a, b, rest = int(of[i]), int(of[i + 1]), upto
                else:
                    grown.append(j)
                    continue
                done.append(j)
                stays = (int(ends[rest - 1]) if rest else j["base"]) - j["base"]
                head = j["begin"] - j["base"]
                j |= dict(rest=rest, text=j["text"][:head] + joined[border[i] : at[b]] + j["text"][stays:], sizes=at[a : b + 1])
                fresh += [joined[x:y] for x, y in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist())]
            jobs, behind = grown, 4 * behind
        tokens = np.array(self.encode([x.encode() for x in fresh]), np.int32)
        spot, put = 0, []
        for j in done:
            d, lo, keep, rest, m = j["doc"], j["lo"], j["keep"], j["rest"], len(j["sizes"]) - 1
            lengths = np.concatenate([j["lengths"][:keep], np.diff(j["sizes"]), j["lengths"][rest:]]).astype(np.int32)
            counts = np.concatenate([j["counts"][:keep], tokens[spot : spot + m], j["counts"][rest:]])
            spot, g = spot + m, int(self.leaf_of[d])
            self.encoded[d] += m
            self.changed[g + lo] = (j["text"], lengths, counts)
            put.append((d, lo, len(j["text"]), int(counts.sum())))
            for k in range(lo + 1, j["hi"] + 1):
                self.changed[g + k] = ("", _NONE, _NONE)
                put.append((d, k, 0, 0))
        if put:
            self._put(*(np.array(x, np.int64) for x in zip(*put)))
        for j in done:
            if len(self.changed[int(self.leaf_of[j["doc"]]) + j["lo"]][1]) > 8 * LEAF:
                self._regrow(j["doc"])

    def parts(self, d: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """Text, lengths, counts and leaf sizes of a document."""
        every = [self.leaf(d, k) for k in range(int(self.n_leaves[d]))]
        return "".join(x[0] for x in every), np.concatenate([x[1] for x in every]), np.concatenate([x[2] for x in every]), np.array([len(x[1]) for x in every], np.int32)

    def _regrow(self, d: int) -> None:
        """A new tree with leaves of equal size for document d, at the end of the arrays."""
        text, lengths, counts, _ = self.parts(d)
        at = np.arange(0, max(1, len(lengths)), LEAF)
        sizes = np.diff(np.append(at, len(lengths)))
        own = Forest(b"", lengths, counts, None, sizes, np.array([0, len(sizes)]), None)
        g, ends = len(self.first) - 1 + len(self.changed) + int(self.leaf_of.max()) + 1, np.concatenate([[0], np.cumsum(lengths)])
        for k, (a, b) in enumerate(zip(at.tolist(), (at + sizes).tolist())):
            self.changed[g + k] = (text[ends[a] : ends[b]], lengths[a:b], counts[a:b])
        self.leaf_of[d], self.n_leaves[d], self.width[d], self.base[d] = g, len(sizes), own.width[0], len(self.chars)
        self.chars, self.tokens = np.concatenate([self.chars, own.chars]), np.concatenate([self.tokens, own.tokens])


def trees(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, text, its tree (the columns of TREE), and the columns in more as they are."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part, data, offs in chunks(batch, text):
                raw, starts, of, valid = split_pieces(data, offs)
                sizes = np.array([len(x) // 4 for x in vocab.encode_pieces(raw)], np.int32)
                if valid is offs:
                    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    lengths = np.diff(before[np.append(starts, len(data))]).astype(np.int32)
                    texts = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
                else:  # bytes that are not UTF-8 were replaced
                    lengths = np.array([len(x.decode()) for x in raw], np.int32)
                    texts = pa.array([b"".join(raw[a:b]).decode() for a, b in zip(of[:-1], of[1:])], pa.string())
                n = np.diff(of)
                leaves = np.maximum(1, -(-n // LEAF))
                leaf_of = np.concatenate([[0], np.cumsum(leaves)])
                full = np.full(leaf_of[-1], LEAF, np.int32)
                full[leaf_of[1:] - 1] = n - (leaves - 1) * LEAF
                f = Forest(b"", lengths, sizes, of, full, leaf_of, None)
                base = _below(f.width)
                cols = [_lists(x, o, k) for x, o, k in zip((lengths, sizes, full, f.chars, f.tokens), (of, of, leaf_of, base, base), TREE.values())]
                yield pa.RecordBatch.from_arrays([part.column(0), texts, *cols, *(part.column(2 + i) for i in range(len(more)))], [key, "text", *TREE, *more])

    docs = docs.select(key, text, *more)
    kind = lambda c: docs.schema[c].dataType.simpleString()
    return docs.mapInArrow(run, f"`{key}` {kind(key)}, {_DDL}" + "".join(f", `{c}` {kind(c)}" for c in more))


def attached(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (or trees) with edits (array of start, stop, text) from a table of key, seq, start, stop, text, in the order of seq."""
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() != "edits"])
    k = free("k", [*docs.columns, *edits.columns])
    one = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("text").alias("text"))
    of = edits.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(k)).agg(F.sort_array(F.collect_list(one)).alias("edits"))
    of = of.select(k, F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["text"].alias("text"))).alias("edits"))
    return docs.join(of, F.col(key) == F.col(k), "left").drop(k)


def updated(forest: DataFrame, path: str | None = None, key: str = "doc_id", keep: bool = False) -> DataFrame:
    """Applies the column edits to a table of trees: key, n_tokens, n_tokens_edited, n_pieces (before), n_encoded (pre-tokens that the edits encoded).

    keep: with the edited texts and trees, for the edits to come."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = [key, "n_tokens", "n_tokens_edited", "n_pieces", "n_encoded"]

    def run(batches):
        vocab = vocabulary(path)
        encode = lambda pieces: [len(x) // 4 for x in vocab.encode_pieces(pieces)]
        for batch in batches:
            for part, data, _ in chunks(batch, "text"):
                col = {c: part.column(2 + i) for i, c in enumerate([*TREE, "edits"])}
                (lengths, of), (counts, _), (leaves, leaf_of), (chars, base), (tokens, _) = (_flat(col[c]) for c in TREE)
                forest_ = Forest(data.tobytes(), lengths, counts, of, leaves, leaf_of, encode, (chars.copy(), tokens.copy()), base)
                before = forest_.tokens[forest_.base + 1]
                edits, size = col["edits"], np.asarray(col["edits"].value_lengths().fill_null(0), np.int64)
                at = np.asarray(edits.offsets, np.int64)[:-1]
                start, stop = (np.asarray(edits.values.field(i).fill_null(0), np.int64) for i in (0, 1))
                for r in range(int(size.max(initial=0))):
                    docs = np.flatnonzero(size > r)
                    own = at[docs] + r
                    forest_.edit(docs, start[own], stop[own], [x or "" for x in edits.values.field(2).take(pa.array(own)).to_pylist()])
                out = [part.column(0), *(pa.array(x, pa.int64()) for x in (before, forest_.tokens[forest_.base + 1], np.diff(of), forest_.encoded))]
                if keep:
                    every = [forest_.parts(d) for d in range(part.num_rows)]
                    node = lambda x: [x[b : b + 2 * w] for b, w in zip(forest_.base, forest_.width)]
                    cols = [pa.array(x, k) for x, k in zip(([p[1] for p in every], [p[2] for p in every], [p[3] for p in every], node(forest_.chars), node(forest_.tokens)), TREE.values())]
                    out += [pa.array([p[0] for p in every], pa.string()), *cols]
                yield pa.RecordBatch.from_arrays(out, names + ["text", *TREE] * keep)

    forest = forest.select(key, "text", *TREE, "edits")
    return forest.mapInArrow(run, f"`{key}` {forest.schema[key].dataType.simpleString()}, n_tokens long, n_tokens_edited long, n_pieces long, n_encoded long" + f", {_DDL}" * keep)


def counted(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", keep: bool = False) -> DataFrame:
    """updated(trees(docs)) for docs with a column edits, without a table between."""
    return updated(trees(docs, path, text, key, ("edits",)), path, key, keep)


def sample_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with three edits of each text, at a third, the half and two thirds: an insertion, a deletion, a replacement."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    one = lambda at, size, new: F.struct(F.floor(n * at).alias("start"), (F.floor(n * at) + size).alias("stop"), F.lit(new).alias("text"))
    return docs.withColumn("edits", F.array(one(1 / 3, 0, " it's 2024 "), one(1 / 2, 5, ""), one(2 / 3, 7, "café's\n\n")))
