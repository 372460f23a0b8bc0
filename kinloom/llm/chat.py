r"""Chat formatting by columnar byte assembly.

Template, one block for each turn:

    <|im_start|>ROLE\nTEXT<|im_end|>\n

Control strings inside roles and texts are escaped with a backslash after their
first character, and every backslash is doubled, so ``unescape`` gives back each
text and no escaped text holds a control string. In a role,
line breaks and backslashes are first written as ``\n`` and ``\b``.

Batches of turns, sorted by conversation and turn, are assembled column-wise:
numpy finds the bytes that need an escape, adds up segment lengths to offsets
and scatters headers and contents into one preallocated buffer, which becomes
the Arrow column without another copy. A conversation that crosses a batch is
continued as a further piece, so no conversation is ever held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = b"<|im_start|>", b"<|im_end|>"
CONTROL = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<|startoftext|>",
)
FORMATTED = "conv_id long, piece long, text string, loss array<struct<start:long,end:long>>, chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
ROWS = 4096  # turns assembled at a time


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, null as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _escapes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True for each byte after which a backslash goes."""
    after = raw == ord("\\")
    limit = np.repeat(offsets[1:], np.diff(offsets))
    openers = np.flatnonzero((raw == ord("<")) | (raw == ord("[")))
    for control in CONTROL:
        want = np.frombuffer(control.encode(), dtype=np.uint8)
        at = openers[openers + len(want) <= limit[openers]] if len(openers) else openers
        for k, byte in enumerate(want):
            at = at[raw[at + k] == byte]
        after[at] = True
    return after


def _scatter(out: np.ndarray, raw: np.ndarray, offsets: np.ndarray, after: np.ndarray, place: np.ndarray) -> None:
    """Copy row i's bytes to ``place[i]``, with a backslash after each marked byte."""
    shift = np.cumsum(after) - after
    base = np.repeat(place - offsets[:-1] - np.r_[shift, after.sum()][offsets[:-1]], np.diff(offsets))
    to = np.arange(len(raw)) + shift + base
    out[to] = raw
    out[to[after] + 1] = ord("\\")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row."""
    return np.diff(np.r_[0, np.cumsum(values)][offsets])


def _put(out: np.ndarray, text: bytes, place: np.ndarray) -> None:
    if len(place):
        out[place[:, None] + np.arange(len(text))] = np.frombuffer(text, dtype=np.uint8)


def _one_line(role: str | None) -> str | None:
    return role.replace("\\", "\\b").replace("\n", "\\n") if role and ("\n" in role or "\\" in role) else role


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one byte buffer; where each turn starts and where its text starts and ends."""
    role, role_at = _buffer(pa.array([_one_line(r) for r in roles.to_pylist()], pa.string()))
    body, body_at = _buffer(texts)
    role_esc, body_esc = _escapes(role, role_at), _escapes(body, body_at)
    role_len = np.diff(role_at) + _sums(role_esc, role_at)
    body_len = np.diff(body_at) + _sums(body_esc, body_at)
    fixed = len(START) + 1 + len(END) + 1
    turn = np.r_[0, np.cumsum(role_len + body_len + fixed)]
    out = np.empty(turn[-1], dtype=np.uint8)
    start = turn[:-1] + len(START) + role_len + 1
    end = start + body_len
    _put(out, START, turn[:-1])
    _scatter(out, role, role_at, role_esc, turn[:-1] + len(START))
    _put(out, b"\n", start - 1)
    _scatter(out, body, body_at, body_esc, start)
    _put(out, END + b"\n", end)
    return out, turn, start, end


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, piece, at = object(), 0, 0  # the open conversation, its next piece, its code points so far
    for whole in batches:
        for low in range(0, whole.num_rows, ROWS):
            batch = whole.slice(low, ROWS)
            convs = batch.column("conv_id").to_pylist()
            first = [i for i in range(len(convs)) if not i or convs[i] != convs[i - 1]]
            out, turn, start, end = assemble(batch.column("role"), batch.column("text"))
            points = np.r_[0, np.cumsum((out & 0xC0) != 0x80)]
            trains = np.array([r == "assistant" for r in batch.column("role").to_pylist()])
            ids, numbers, loss, chars = [], [], [], []
            for i, j in zip(first, [*first[1:], len(convs)], strict=True):
                if convs[i] != last:
                    last, piece, at = convs[i], 0, 0
                base = at - points[turn[i]]
                loss.append([{"start": int(points[start[k]] + base), "end": int(points[end[k]] + base)}
                             for k in range(i, j) if trains[k]])
                ids.append(last)
                numbers.append(piece)
                chars.append(int(points[turn[j]] - points[turn[i]]))
                piece, at = piece + 1, at + chars[-1]
            border = pa.array(turn[[*first, len(convs)]], pa.int64())
            text = pa.Array.from_buffers(pa.large_string(), len(ids), [None, border.buffers()[1], pa.py_buffer(out)])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), text.cast(pa.string()), pa.array(loss, span),
                 pa.array(chars, pa.int64())], names=["conv_id", "piece", "text", "loss", "chars"])


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted text and loss mask of each conversation of ``turns`` (conv_id, turn, role, text).

    Result: conv_id, piece, text, loss, chars. A conversation's text is its
    pieces put together by number; most have one. ``loss`` holds the spans of
    assistant texts, as code points of the whole text, end exclusive.

    Turns with a null id form one conversation; equal turn numbers are ordered
    by role and text, null first, and repeated rows stay. Null roles and texts
    are empty. Any role is formatted; only ``assistant`` is trained on.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    return (
        rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(_pieces, FORMATTED)
    )


TURN = re.compile(re.escape(START.decode()) + r"([^\n]*)\n(.*?)" + re.escape(END.decode()) + r"\n", re.S)
ESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return ESCAPE.sub(r"\1", text) if "\\" in text else text


def _role(text: str) -> str:
    return ESCAPE.sub(lambda m: {"n": "\n", "b": "\\"}[m[1]], unescape(text))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read pieces back; pieces of a conversation come in order, one after the other."""
    held = None

    def row():
        return {"conv_id": held[0], "n_turns": held[1], "turns_sha256": held[2].hexdigest(), "loss_chars": held[3],
                "loss_sha256": held[4].hexdigest(), "formatted_chars": held[5]}

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        done = []
        columns = [batch.column(c) for c in ("conv_id", "piece", "text", "loss")]
        for conv, piece, text, loss in zip(*(c.to_pylist() for c in columns), strict=True):
            if piece == 0:
                if held:
                    done.append(row())
                held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for m in TURN.finditer(text):
                held[1] += 1
                held[2].update(f"{_role(m[1])}\n{unescape(m[2])}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] - held[5]:span["end"] - held[5]])
                held[3] += len(said)
                held[4].update(said.encode())
            held[5] += len(text)
        yield pa.RecordBatch.from_pylist(done, schema)
    if held:
        yield pa.RecordBatch.from_pylist([row()], schema)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted pieces hold, read back from them, one row per conversation."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.select("conv_id", "piece", "text", "loss").mapInArrow(_digest, DIGESTS)
