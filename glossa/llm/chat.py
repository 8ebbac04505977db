"""Chat formatting by token-level assembly (operator 5).

A conversation becomes <s>, then for each turn [INST] role [/INST] text </s>. Role and text are encoded each by itself, so
no token crosses a border, and the four marks are spliced in as reserved ids that no text encodes to. Control strings
that occur in a role or text are escaped (a backslash after their first character; backslashes are doubled), so that the
rendered text, too, has marks only where the template put them. The loss mask is the prefix sum of steps: up behind an
assistant's [/INST], down at its </s>.

Cases: null texts and roles are empty; rows of a conversation stand by turn, then role, then text, repeated rows each as a
turn of its own; rows without conv_id form one conversation; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.bpe import encode_texts, vocabulary

#: The reserved ids of the template, and the strings that they stand for.
BEGIN, TURN, SAYS, END = 50256, 50257, 50258, 50259
MARKS = {BEGIN: "<s>", TURN: "[INST]", SAYS: "[/INST]", END: "</s>"}
_CONTROL = re.compile("|".join(re.escape(m) for m in MARKS.values()))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def assemble(segments: list[tuple[bytes, bytes, bool]]) -> np.ndarray:
    """Token ids of a conversation from its turns: (ids of the role, ids of the text, whether it is learnt)."""
    one = {k: np.array([k], "<u4").tobytes() for k in MARKS}
    return np.frombuffer(one[BEGIN] + b"".join(one[TURN] + r + one[SAYS] + t + one[END] for r, t, _ in segments), "<u4")


def loss_mask(ids: np.ndarray, learnt: list[bool]) -> np.ndarray:
    """True for the tokens of texts that are learnt: a prefix sum over the marks."""
    step = np.zeros(len(ids) + 1, np.int32)
    step[np.flatnonzero(ids == SAYS)[learnt] + 1] += 1
    step[np.flatnonzero(ids == END)[learnt]] -= 1
    return np.cumsum(step[:-1]) > 0


def parse(ids: np.ndarray, table: list[bytes]) -> list[tuple[str, str]]:
    """Roles and texts, unescaped, from token ids."""
    a, b, c = (np.flatnonzero(ids == m).tolist() for m in (TURN, SAYS, END))
    read = lambda x, y: unescape(b"".join([table[i] for i in ids[x + 1 : y].tolist()]).decode())
    return [(read(x, y), read(y, z)) for x, y, z in zip(a, b, c)]


def render(ids: np.ndarray, table: list[bytes]) -> str:
    marks = {k: m.encode() for k, m in MARKS.items()}
    return b"".join([marks[i] if i in marks else table[i] for i in ids.tolist()]).decode()


def formatted(turns: DataFrame, assistant: str = "assistant", path: str | None = None) -> DataFrame:
    """conv_id, input_ids (array of int), loss_mask (array of boolean): one row per conversation.

    Segments are encoded where the rows are; then the rows of a conversation meet, sorted by Spark, in one partition,
    where a task holds one conversation at a time."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def encoded(batches):
        vocab = vocabulary(path)
        for batch in batches:
            cols = []
            for c in ("role", "text"):
                raw = [escape(x or "").encode() for x in batch.column(batch.schema.get_field_index(c)).to_pylist()]
                for at in range(0, len(raw), 1000):
                    part = raw[at : at + 1000]
                    offs = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)
                    cols.append(encode_texts(np.frombuffer(b"".join(part), np.uint8), offs, vocab))
            half = len(cols) // 2
            role, text = (pa.array([x for part in some for x in part], pa.binary()) for some in (cols[:half], cols[half:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), role, text], ["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

    def joined(batches):
        def out(conv, segs):
            ids = assemble(segs)
            return pa.RecordBatch.from_arrays([conv, pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([loss_mask(ids, [s[2] for s in segs])], pa.list_(pa.bool_()))], ["conv_id", "input_ids", "loss_mask"])

        now, segs = None, []
        for batch in batches:
            conv = batch.column(0)
            for i, row in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                here = conv.slice(i, 1)
                if segs and not here.equals(now):
                    yield out(now, segs)
                    segs = []
                now = here
                segs.append((row[1], row[2], row[0] == assistant))
        if segs:
            yield out(now, segs)

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    keys = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}"
    rows = turns.select("conv_id", "turn", "role", "text").mapInArrow(encoded, f"{keys}, role string, text string, role_ids binary, text_ids binary")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "role_ids", "text_ids")
    return rows.mapInArrow(joined, f"conv_id {kinds['conv_id']}, input_ids array<int>, loss_mask array<boolean>")


def digests(chats: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted conversations."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        table = vocabulary(path).table
        for batch in batches:
            rows = []
            for ids, mask in zip(batch.column(1), batch.column(2)):
                ids, mask = np.asarray(ids.values, np.int64), np.asarray(mask.values.to_numpy(zero_copy_only=False), bool)
                turns = parse(ids, table)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                loss = "".join(unescape(b"".join([table[i] for i in ids[a:b].tolist()]).decode()) for a, b in zip(edge[::2], edge[1::2]))
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(render(ids, table))))
            n, t, lc, ls, fc = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(t, pa.string()), pa.array(lc, pa.int64()), pa.array(ls, pa.string()), pa.array(fc, pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
