"""Chat formatting by columnar byte assembly.

A turn becomes ``[INST] role [/INST]text</s>``. Inside roles and texts a
backslash is doubled and one is put after the first character of each control
string, so no control string of a text survives and every text can be had back.

Turns of a batch are laid out together: numpy finds the bytes that need a
backslash, computes lengths and offsets of all segments and the place of each
byte, and copies headers and contents into one preallocated buffer. The offsets of conversations in
it make it an Arrow array of their texts, without another copy. The last part of a batch
waits, unformatted, for the next batch.

A conversation is a row for each part: a part ends with the first turn that brings it to ``part_bytes``, so a conversation of
any length streams through a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import bound_batches, released

BEGIN, MIDDLE, END = b"[INST] ", b" [/INST]", b"</s>"
#: Each begins with a character that is nowhere else in any of them, so none can arise where two segments meet.
CONTROLS = (b"<s>", b"</s>", b"[INST]", b"[/INST]")
BACKSLASH = 92
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)
PART_SCHEMA = "conv_id long, part long, n_turns long, formatted string, loss_begin array<long>, loss_length array<long>"


@dataclass
class Column:
    """Texts as one byte buffer and their offsets."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, array: pa.Array) -> Column:
        array = array.cast(pa.large_binary()).fill_null(b"")
        # A slice begins inside its buffers.
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)
        return cls(data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))


def escape(texts: Column) -> Column:
    """Texts with backslashes put in, by scattering."""
    data, offsets = texts.data, texts.offsets
    before = np.zeros(len(data) + 1, dtype=bool)  # a backslash goes before this byte
    before[:-1] |= data == BACKSLASH
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    for control in CONTROLS:
        at = np.flatnonzero(data == control[0])
        for k, byte in enumerate(control[1:], 1):
            at = at[at + k < row_end[at]] if len(at) else at
            at = at[data[at + k] == byte]
        before[at + 1] = True
    if not before.any():
        return texts
    added = np.cumsum(before)
    out = np.full(len(data) + added[-1], BACKSLASH, dtype=np.uint8)
    out[np.arange(len(data)) + added[:-1]] = data
    # What goes before a row's first byte belongs to that row.
    shift = np.concatenate([[0], added])[offsets]
    return Column(out, offsets + shift)


def assemble(segments: list[Column | bytes], n: int) -> tuple[Column, list[np.ndarray]]:
    """Rows of the segments one after the other, and where each segment begins in the result."""
    lengths = np.stack([np.diff(s.offsets) if isinstance(s, Column) else np.full(n, len(s)) for s in segments], axis=1).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(begins[-1], dtype=np.uint8)
    starts = begins[:-1].reshape(n, len(segments)) if n else np.zeros((0, len(segments)), np.int64)
    for k, s in enumerate(segments):
        if isinstance(s, Column):
            length = lengths[:, k]
            out[np.arange(len(s.data)) + np.repeat(starts[:, k] - s.offsets[:-1], length)] = s.data
        else:
            out[(starts[:, k][:, None] + np.arange(len(s))).ravel()] = np.tile(np.frombuffer(s, np.uint8), n)
    return Column(out, np.concatenate([starts[:, 0], begins[-1:]]) if n else np.zeros(1, np.int64)), [starts[:, k] for k in range(len(segments))]


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", data) if b"\\" in data else data


def parse_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a part, as they were."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn[len(BEGIN) :].partition(MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns


def format_conversations(turns: DataFrame, loss_role: str = "assistant", part_bytes: int = 4 << 20) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss_begin, loss_length) from rows (conv_id, turn, role, text).

    Parts of a conversation are numbered from 0 in one partition, in order.
    loss_begin and loss_length are in bytes of the part's UTF-8, one span for
    each text of ``loss_role``. Rows go by turn (null first), then role, then text.
    A null role or text counts as empty; a null conv_id is one conversation of
    its own; repeated rows are turns of their own; other columns are ignored; no rows give none.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    ordered = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    bound_batches(turns.sparkSession)

    @released
    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, 0  # rows of the last conversation, and the parts it has already
        for rows in batches:
            if rows.num_rows:
                waiting = rows if held is None else pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                out, held, number = format_rows(waiting, number, loss_role, part_bytes, last=False)
                if out is not None:
                    yield out
        if held is not None:
            yield format_rows(held, number, loss_role, part_bytes, last=True)[0]

    return ordered.select("conv_id", "turn", "role", "text").mapInArrow(formatted, PART_SCHEMA)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes between offsets as strings, on the same buffer."""
    if len(data) >= 1 << 31:
        raise ValueError("turns of two gigabytes at once")
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def format_rows(rows: pa.RecordBatch, number: int, loss_role: str, part_bytes: int, last: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None, int]:
    """Parts of the rows (conv_id, turn, role, text), which lie in order; rows that have to wait for others; and the number
    of their part. ``number``: that of the first row's part. Unless the rows are the ``last`` ones, those of the last part wait.
    """
    n = rows.num_rows
    # A null conv_id is a conversation, too.
    conv, null = rows.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.asarray(rows.column(0).is_null())
    new = np.concatenate(([True], (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])))
    contents = escape(Column.of(rows.column(3)))
    laid, starts = assemble([BEGIN, escape(Column.of(rows.column(2))), MIDDLE, contents, END], n)
    # First row and number of each part.
    edges, numbers = [], []
    bounds = np.append(np.flatnonzero(new), n)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        at, k = low, number if low == 0 else 0
        while at < high:
            edges.append(at)
            numbers.append(k)
            # The part's last row is the first to bring it to its size.
            full = int(np.searchsorted(laid.offsets[at + 1 : high + 1], laid.offsets[at] + part_bytes))
            at, k = at + full + 1, k + 1
    held = None
    if not last:  # what comes next may belong to the last part, or number its parts on from it
        held, number = rows.slice(edges[-1]), numbers[-1]
        n, edges, numbers = edges[-1], edges[:-1], numbers[:-1]
    if not edges:
        return None, held, number
    first = np.array([*edges, n])
    loss = np.flatnonzero(np.asarray(rows.column(2).slice(0, n).to_numpy(zero_copy_only=False) == loss_role))
    part = np.searchsorted(first, loss, "right") - 1
    spans = np.append(0, np.cumsum(np.bincount(part, minlength=len(edges)))).astype(np.int32)
    begin, length = starts[3][loss] - laid.offsets[first[part]], np.diff(contents.offsets)[loss]
    lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x.astype(np.int64))) for x in (begin, length)]
    columns = [rows.column(0).take(pa.array(edges)), pa.array(numbers, pa.int64()), pa.array(np.diff(first).astype(np.int64)), _strings(laid.data, laid.offsets[first]), *lists]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "n_turns", "formatted", "loss_begin", "loss_length"]), held, number
