"""Chat formatting by columnar byte assembly.

A turn is written as ``<s>[role]\\ntext</s>\\n``. Inside roles and texts each of the
characters ``< [ ] \\`` is followed by a backslash, so no control string of the template, nor
any other of the kind (``[INST]``, ``</s>``), can stand in an escaped text, and removing
those backslashes restores it.

For a batch of turns, numpy computes the length of every segment, the cumulative offsets and
the place of every byte, and copies all of them into one buffer that becomes an Arrow string
column, one value for each conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = b"<s>[", b"]\n", b"</s>\n"
ESCAPED, MARK = b"<[]\\", ord("\\")
#: Bytes whose places are computed at a time, and bytes of roles and texts that are put together in one buffer, but for a longer conversation.
CHUNK, BUFFER = 1 << 20, 1 << 27
_TURN = re.compile(r"<s>\[(.*?)\]\n(.*?)</s>\n", re.DOTALL)
_UNESCAPE = re.compile(r"([<\[\]\\])\\")
_IS_ESCAPED = np.isin(np.arange(256), np.frombuffer(ESCAPED, dtype=np.uint8))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


class _Segments:
    """One string column: its bytes, where each value starts, and its escaped lengths."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
        self.starts = (offsets - offsets[0])[:-1]
        self.raw = np.diff(offsets)
        marks = np.flatnonzero(_IS_ESCAPED[self.data])
        self.marks_before = np.searchsorted(marks, self.starts)
        self.lengths = self.raw + np.searchsorted(marks, self.starts + self.raw) - self.marks_before

    def scatter(self, out: np.ndarray, places: np.ndarray) -> None:
        """Writes value i, escaped, from places[i] on."""
        shift, begun, seen = places - self.starts - self.marks_before, 0, 0
        for a in range(0, len(self.data), CHUNK):
            part = self.data[a : a + CHUNK]
            last = np.searchsorted(self.starts, a + len(part), side="left")
            first = max(np.searchsorted(self.starts, a, side="right") - 1, 0)
            # Rows first .. last - 1 overlap the chunk; each contributes its bytes in it.
            low = np.maximum(self.starts[first:last], a)
            high = np.minimum(self.starts[first:last] + self.raw[first:last], a + len(part))
            marked = _IS_ESCAPED[part]
            before = np.cumsum(marked) - marked + seen
            to = np.arange(a, a + len(part)) + before + np.repeat(shift[first:last], np.maximum(high - low, 0))
            out[to] = part
            out[to[marked] + 1] = MARK
            seen += int(marked.sum())


def _constant(out: np.ndarray, places: np.ndarray, value: bytes) -> None:
    out[places[:, None] + np.arange(len(value))] = np.frombuffer(value, dtype=np.uint8)


def assemble(conv: pa.Array, roles: pa.Array, texts: pa.Array, starts: np.ndarray, learn: str) -> pa.RecordBatch:
    """One row for each conversation; rows starts[i] .. starts[i + 1] - 1 are its turns, in order."""
    role, text = _Segments(roles), _Segments(texts)
    lengths = len(OPEN) + role.lengths + len(MIDDLE) + text.lengths + len(CLOSE)
    ends = np.cumsum(lengths)
    at = ends - lengths
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    _constant(out, at, OPEN)
    role_at = at + len(OPEN)
    role.scatter(out, role_at)
    _constant(out, role_at + role.lengths, MIDDLE)
    text_at = role_at + role.lengths + len(MIDDLE)
    text.scatter(out, text_at)
    _constant(out, text_at + text.lengths, CLOSE)
    # Offsets in code points: the bytes before that don't continue a character.
    heads = np.flatnonzero((out & 0xC0) == 0x80)
    points = lambda places: places - np.searchsorted(heads, places)
    bounds = np.append(starts, len(lengths))
    offsets = np.append(at[starts], len(out))
    owner = np.repeat(np.arange(len(starts)), np.diff(bounds))
    learned = np.flatnonzero(np.array([r == learn for r in roles.to_pylist()], dtype=bool))
    base = points(offsets[:-1])[owner[learned]]
    spans = np.searchsorted(owner[learned], np.arange(len(starts) + 1)).astype(np.int32)
    span = lambda places: pa.ListArray.from_arrays(pa.array(spans), pa.array((points(places) - base).astype(np.int32)))
    formatted = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(starts)), pa.array(np.diff(bounds)), formatted.cast(pa.string()), span(text_at[learned]), span(text_at[learned] + text.lengths[learned])],
        ["conv_id", "n_turns", "formatted", "loss_start", "loss_end"],
    )


def format_chats(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_start, loss_end), one row for each conversation.

    loss_start and loss_end are code point offsets in formatted of every text whose role is
    `learn`. Turns go by turn number, nulls first; ties by role, then text, so that the
    result doesn't depend on the order of rows. A null role or text is empty; null ids are one
    conversation; repeated rows are turns of their own. An empty table gives an empty
    result; other columns are not read. A conversation is one value of the result, so its turns
    meet in one task; a task holds no more than one unfinished conversation and a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def close(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0), dtype=np.int64) for i in (1, 2))
            buffer = np.cumsum(np.add.reduceat(sizes, starts)) // BUFFER
            bounds = np.append(starts, batch.num_rows)
            for own in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(buffer)) + 1):
                a, b = int(bounds[own[0]]), int(bounds[own[-1] + 1])
                part = batch.slice(a, b - a)
                yield assemble(part.column(0), part.column(1), part.column(2), starts[own] - a, learn)

        def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            valid = np.asarray(keys.is_valid())
            values = np.asarray(keys.fill_null(0))
            changed = np.flatnonzero((values[1:] != values[:-1]) | (valid[1:] != valid[:-1])) + 1
            if pending:
                before = pending[-1].column(0)[pending[-1].num_rows - 1].as_py()
                if before == keys[0].as_py():
                    cut = int(changed[0]) if len(changed) else batch.num_rows
                    pending.append(batch.slice(0, cut))
                    if cut == batch.num_rows:
                        continue
                    batch, changed = batch.slice(cut), changed[1:] - cut
                yield from close(one(pending), np.array([0]))
                pending = []
            if len(changed):
                last = int(changed[-1])
                yield from close(one([batch.slice(0, last)]), np.append(0, changed[:-1]))
                batch = batch.slice(last)
            pending = [batch]
        if pending:
            yield from close(one(pending), np.array([0]))

    own = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.col(turn_col).alias("turn"))
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.drop("turn").mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_start array<int>, loss_end array<int>")
