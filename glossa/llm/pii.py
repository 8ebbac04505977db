"""Personal data: fixed patterns and a linear-chain conditional random field (operator 4).

The base spans are what the patterns of four kinds match, leftmost and without overlap, if they pass the kind's test. The
field adds spans of the same kinds that the patterns miss (a phone without a plus, a card in dots, an address spelt out):
tokens between white space are labelled O or begin/inside of a kind from features of their word shape and their
neighbours', with weights trained on the small labelled table below; Viterbi decodes padded arrays of sequences at once.
A label other than O needs a token with a digit or one of @ ( [ at most REACH tokens away; so the chain is cut into short
sequences with O at both ends, exactly. Added spans that overlap a base span or each other are dropped.

Cases: null texts are empty; positions are code points; texts of any length are read whole; repeated rows get equal rows;
other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.llm.common import byte_table, chunks, spans

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH, BITS = 2, 14
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _emails(text: str):
    """Matches of [local characters]+@domain: a match begins where the run of local characters before its @ does."""
    done = last = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        left = text[max(done, last) : at]
        if size := len(left) - len(left.rstrip(_LOCAL)):
            done = m.end()
            yield at - size, done
        last = at + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


#: The labelled table: sentences in which {kind:...} marks a span. Nothing else is learnt from.
LABELLED = (
    "please write to {email:anna.berg@mail.example.org} before noon", "my address is {email:jo_smith99@post.example.com} thanks",
    "write {email:info (at) shop.example (dot) com} for details", "mail me : {email:kim [at] example [dot] net} or call", "contact {email:lee.wong(at)example.org} now", "reach us under {email:sales [at] example.com} today",
    "Server {email:root@localhost.localdomain} said hello", "die Adresse lautet {email:max.muster@beispiel.de} bitte", "escribe a {email:pepe.diaz (at) correo.es} hoy", "le courriel {email:luc [at] exemple.fr} suffit",
    "the host {ip:10.0.0.17} did not answer", "connect to {ip:192.168.4.20} first", "requests from {ip:84.12.200.3} were dropped", "from {ip:172.16.254.1} to {ip:8.8.4.4} in order", "address {ip:[203.0.113.7]} is blocked", "ping {ip:198.51.100.23} twice",
    "card {card:4111 1111 1111 1111} was charged", "she paid with {card:5500000000000004} yesterday", "number {card:3400-0000-0000-009} expires", "the card {card:4012.8888.8888.1881} is stolen", "use {card:6011/1111/1111/1117} instead", "Karte {card:4111.1111.1111.1111} wurde gesperrt", "carte {card:5105.1051.0510.5100} valable", "tarjeta {card:4222/2222/2222/2222} robada",
    "call me at {phone:+1 (415) 555-2671} tonight", "phone {phone:(212) 555-0187} after six", "tel. {phone:555-867-5309} or write", "her number is {phone:+44 20 7946 0958} in London", "dial {phone:0171 5550123} for help", "Telefon {phone:030/5550199} ist besetzt", "llame al {phone:(91) 555-0143} ahora", "appelez {phone:01.55.50.01.23} demain", "fax {phone:(303) 555-0156} only", "mobile {phone:1-800-555-0199} free", "ring {phone:(020) 7946-0321} please",
    "in 2024 we sold 1500 units of model 300", "version 3.2.1 was released on 2023-11-05 at 10:45", "the total is 1,234.56 for 12 items ( see page 7 )", "Licensed under CC BY-NC 4.0. All rights reserved", "Copyright (c) 2019-2022 the authors [1] and others", "chapter 12 section 4.3.2 figure 7", "a score of 98.6 % with 1000000 samples", "token = \"a3f9e04b7c2d88f1\" is secret", "room 42 on floor 3 (left side) is free", "see [12] and [13] for 250 more", "on 12/05/2021 it rained 33 mm", "build 20240115 passed 5120 tests (all)", "id 00012345 has 3 parts", "between 1914 and 1918 some 40000 left", "it weighs 12.5 kg and costs 99.99 now", "page @ 5 or so (maybe) at noon", "follow @someone or #123 there", "key sk_live_51H8x9Qz2Lm is rotated", "add 2 (two) spoons at 180 degrees", "array[10] = 5 and f(x) = 3",
    "word12 word345 and item7 then node34 with x99", "take line5 step10 part3b and file2024 to box9", "gpt4 mp3 h264 utf8 covid19 f16 b2b", "user123 wrote test1 test22 test333 in room7", "word1 word22 word333 word4444 word5", "w17 w208 w3 w99 w150 w4", "a1 b22 c333 d4 e55 f66", "Word12 Word300 , Item45 . Node6",
    "el capítulo 12 tiene 300 páginas (más o menos)", "im Jahr 2020 waren es 15000 Stück [3]", "en 1998 il y avait 27 pays (environ)", "price 1.299.000 or 2.500.000 pesos",
)


def _labelled() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in LABELLED:
        tokens, labels = [], []
        for m in re.finditer(r"\{(\w+):([^}]*)\}|\S+", line):
            parts = m[2].split() if m[1] else [m[0]]
            tokens += parts
            labels += [LABELS.index(f"{'I' if i else 'B'}-{m[1]}") if m[1] else 0 for i in range(len(parts))]
        out.append((tokens, labels))
    return out


def shape(token: str) -> str:
    """Letters as x, digits as 9, others as they are; runs of a kind are shortened to three."""
    s = re.sub(r"[^\W\d_]", "x", re.sub(r"\d", "9", token))
    return re.sub(r"(.)\1{3,}", r"\1\1\1", s)


@lru_cache(100_000)
def _hash(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "big") & ((1 << BITS) - 1)


@lru_cache(100_000)
def _own(token: str) -> tuple[tuple[int, ...], str, int]:
    """(features of the token itself, its shape, digits)."""
    core = token.strip(".,;:!?\"'")
    s, digits = shape(core), sum(c.isdigit() for c in core)
    names = [f"s={s}", f"d={min(digits, 20)}", f"l={min(len(core), 24) // 3}", f"at={'@' in core}", f"dots={min(core.count('.'), 4)}", f"dash={min(core.count('-'), 4)}", f"pre={s[:2]}", f"suf={s[-2:]}", f"plus={core[:1] == '+'}", f"par={core[:1] in '(['}{core[-1:] in ')]'}", f"alpha={core.isalpha()}", f"mix={any(c.isalpha() for c in core) and digits > 0}"]
    if core.lower() in ("(at)", "[at]", "(dot)", "[dot]"):
        names.append(f"w={core.lower()[1:-1]}")
    return tuple(map(_hash, names)), s, digits


@lru_cache(100_000)
def _beside(s: str, digits: int, where: str) -> tuple[int, ...]:
    return _hash(f"{where}s={s}"), _hash(f"{where}d={min(digits, 12)}")


def _features(tokens: list[str]) -> list[list[int]]:
    own = [_own(t) for t in tokens]
    edge = ((), "|", 0)
    return [[*x[0], *_beside(p[1], p[2], "<"), *_beside(q[1], q[2], ">")] for p, x, q in zip([edge, *own[:-1]], own, [*own[1:], edge])]


def _padded(sequences: list[list[list[int]]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emission scores (sequence, place, label) and lengths."""
    size = np.array([len(s) for s in sequences])
    flat = [f for s in sequences for f in s]
    each = np.array([len(f) for f in flat])
    sums = np.add.reduceat(weights[np.fromiter((x for f in flat for x in f), np.int64, each.sum())], np.cumsum(each) - each)
    out = np.zeros((len(sequences), size.max(), len(LABELS)))
    out[np.arange(size.max())[None, :] < size[:, None]] = sums
    return out, size


def _allowed() -> np.ndarray:
    """0 where a label may follow another, else a large negative score: I-k only follows B-k or I-k."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, of in enumerate(LABELS):
                out[i, j] = 0 if of[2:] == to[2:] else -1e4
    return out


def viterbi(emission: np.ndarray, size: np.ndarray, transition: np.ndarray) -> list[np.ndarray]:
    """The best label sequences of a padded batch; chains begin after an O and end before one."""
    n, t, _ = emission.shape
    best, back = emission[:, 0] + transition[0], np.zeros((n, t, emission.shape[2]), np.int8)
    for k in range(1, t):
        score = best[:, :, None] + transition
        step = score.max(1) + emission[:, k]
        back[:, k] = score.argmax(1)
        best = np.where((k < size)[:, None], step, best)
    last = (best + transition[:, 0]).argmax(1)
    out = [np.zeros(s, np.int64) for s in size]
    for i in range(n):
        x = last[i]
        for k in range(size[i] - 1, -1, -1):
            out[i][k] = x
            x = back[i, k, x]
    return out


@cache
def model() -> tuple[np.ndarray, np.ndarray]:
    """(weights of features by label, transition scores), trained on the labelled table by gradient ascent of the likelihood."""
    table = _labelled()
    sequences, gold = [_features(t) for t, _ in table], [y for _, y in table]
    w, move, fixed = np.zeros((1 << BITS, len(LABELS))), np.zeros((len(LABELS), len(LABELS))), _allowed()
    used = np.unique([x for s in sequences for f in s for x in f])
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    sw, sm = np.zeros_like(w[used]), np.zeros_like(move)
    flat = [f for s in sequences for f in s]
    each = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    names = np.searchsorted(used, [x for f in flat for x in f])
    for _ in range(150):
        e, size = _padded(sequences, w)
        tr = move + fixed
        n, t, k = e.shape
        live = np.arange(t)[None, :] < size[:, None]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + tr[0]
        for i in range(1, t):
            a[:, i] = np.where(live[:, i, None], lse(a[:, i - 1, :, None] + tr, 1) + e[:, i], a[:, i - 1])
        b[:, t - 1] = tr[:, 0]
        for i in range(t - 2, -1, -1):
            b[:, i] = np.where(live[:, i + 1, None], lse(tr + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), tr[:, 0])
        z = lse(a[:, t - 1] + tr[:, 0], 1)
        p = np.exp(np.minimum(a + b - z[:, None, None], 0)) * live[:, :, None]
        gm = -np.exp(np.minimum(a[:, :-1, :, None] + tr + (e + b)[:, 1:, None, :] - z[:, None, None, None], 0))[live[:, 1:]].sum(0)
        for i, y in enumerate(gold):
            p[i, np.arange(len(y)), y] -= 1
            np.add.at(gm, (y[:-1], y[1:]), 1)
        gw = np.zeros_like(w[used])
        np.add.at(gw, names, -p[live][each])
        gw, gm = gw - 0.05 * w[used], gm - 0.05 * move
        sw, sm = sw + gw**2, sm + gm**2
        w[used] += 0.3 * gw / (np.sqrt(sw) + 1e-6)
        move += 0.3 * gm / (np.sqrt(sm) + 1e-6)
    return w, move + fixed


_TOKEN = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
_MARK = byte_table(lambda b: 48 <= b < 58 or b in b"@([")


def added(texts: list[str], data: np.ndarray, offs: np.ndarray, trained, base: list[list[tuple[str, int, int]]]) -> None:
    """Adds the field's spans to those of each text (lists that are changed)."""
    if not _MARK[data].any():
        return
    s, e, of = spans(_TOKEN[data], offs)
    total = np.concatenate([[0], np.cumsum(_MARK[data])])
    hot = np.flatnonzero(total[e] > total[s])
    if not len(hot):
        return
    owner = np.searchsorted(of, hot, side="right") - 1
    lo, hi = np.maximum(hot - REACH, of[owner]), np.minimum(hot + REACH + 1, of[owner + 1])
    new = np.ones(len(hot), bool)
    new[1:] = (lo[1:] > hi[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    lo, hi, owner = lo[first], np.maximum.reduceat(hi, first), owner[first]
    raw = data.tobytes()
    tokens = [[raw[a:b].decode(errors="replace") for a, b in zip(s[x:y].tolist(), e[x:y].tolist())] for x, y in zip(lo, hi)]
    order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
    w, move = trained
    for at in range(0, len(order), 256):
        some = order[at : at + 256]
        emission, size = _padded([_features(tokens[i]) for i in some], w)
        for i, labels in zip(some, viterbi(emission, size, move)):
            if not labels.any():
                continue
            text, have = texts[owner[i]], base[owner[i]]
            k = 0
            while k < len(labels):
                if LABELS[labels[k]][0] == "B":
                    j = k + 1
                    while j < len(labels) and LABELS[labels[j]][0] == "I":
                        j += 1
                    begin = len(raw[offs[owner[i]] : s[lo[i] + k]].decode(errors="replace"))
                    end = begin + len(raw[s[lo[i] + k] : e[lo[i] + j - 1]].decode(errors="replace"))
                    while end > begin and text[end - 1] in ".,;:!?\"'*#$%&|":
                        end -= 1
                    while begin < end and text[begin] in ".,;:!?\"'*#$%&|":
                        begin += 1
                    if begin < end and not any(a < end and begin < b for _, a, b in have):
                        have.append((LABELS[labels[k]][2:], begin, end))
                    k = j
                else:
                    k += 1


def found(texts: list[str], data: np.ndarray, offs: np.ndarray, trained) -> list[tuple[list, list]]:
    """For each text (base spans, all spans), by kind as listed, then start."""
    base = [base_spans(t) for t in texts]
    every = [list(b) for b in base]
    added(texts, data, offs, trained, every)
    rank = {k: i for i, k in enumerate(KINDS)}
    return [(b, sorted(x, key=lambda y: (rank[y[0]], y[1]))) for b, x in zip(base, every)]


def _joined(spans_: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans_)


def redact(text: str, spans_: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first in the text counts, then the longest."""
    out, at = [], 0
    for k, a, b in sorted(spans_, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
            at = b
    return "".join(out) + text[at:]


def scanned(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, joined), redacted: a row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        for batch in batches:
            for part, data, offs in chunks(batch, text):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = found(texts, data, offs, shared.value)
                n = [pa.array([sum(x[0] == k for x in b) for b, _ in rows], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *n, pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in rows]), pa.array([_joined(x) for _, x in rows]), pa.array([redact(t, x) if x else t for t, (_, x) in zip(texts, rows)])],
                    [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"],
                )

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in text replaced by its kind; null texts stay null."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model()), docs.columns

    def run(batches):
        at = names.index(text)
        for batch in batches:
            for part, data, offs in chunks(batch, text):
                texts = part.column(at).to_pylist()
                rows = found([t or "" for t in texts], data, offs, shared.value)
                new = pa.array([redact(t, x) if t and x else t for t, (_, x) in zip(texts, rows)], pa.string())
                yield pa.RecordBatch.from_arrays([new if i == at else part.column(i) for i in range(len(names))], names)

    return docs.mapInArrow(run, docs.schema)
