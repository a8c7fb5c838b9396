"""Rows encoded a column at a time: for flat records, numpy places the bytes of whole columns at once.

A record takes this path if its fields are numbers, booleans, dates, timestamps, strings or bytes, or one of these
and null. Every column gives each row a number of bytes; sums over the columns give the rows' places, and
each column then writes its bytes there. Long texts are left to the row codec, which copies them faster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillrow.schema import Logical, Primitive, Record, Schema, Union, union_shape

#: Mean bytes of a string beyond which its column is left to the row codec.
LONG_TEXT = 48
_MILLIS = ("timestamp-millis", "local-timestamp-millis")
_MICROS = ("timestamp-micros", "local-timestamp-micros")

#: Writes into (buffer, places of the rows).
Put = Callable[[np.ndarray, np.ndarray], None]


def _plain(s: Schema) -> tuple[Schema, tuple[int, int] | None] | None:
    """A field's own schema, and the bytes that stand for null and for a value if it is one of these and null."""
    if isinstance(s, Union):
        if union_shape(s) != "one" or s.null_branch is None:
            return None
        return s.members[0][1], (2 * s.null_branch, 2 * s.members[0][0])
    return s, None


def _kind(s: Schema) -> str | None:
    if isinstance(s, Primitive):
        return s.kind if s.kind != "null" else None
    if isinstance(s, Logical) and s.logical in ("date", *_MICROS, *_MILLIS):
        return s.logical
    return None


def supported(record: Record) -> bool:
    return bool(record.fields) and all((p := _plain(f.type)) is not None and _kind(p[0]) is not None for f in record.fields)


def _varint_lengths(z: np.ndarray) -> np.ndarray:
    out = np.ones(len(z), np.int64)
    top = int(z.max(initial=0))
    for k in range(1, 10):
        if top >> (7 * k) == 0:
            break
        out += (z >> np.uint64(7 * k)) != 0
    return out


def _put_varints(buffer: np.ndarray, at: np.ndarray, z: np.ndarray, lengths: np.ndarray) -> None:
    for k in range(int(lengths.max(initial=0))):
        more = lengths > k
        if not more.all():
            at, z, lengths = at[more], z[more], lengths[more]
        buffer[at + k] = ((z >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((lengths > k + 1).astype(np.uint8) << 7)


def _zigzag(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64, copy=False)
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _numbers(kind: str, values: pa.Array) -> tuple[np.ndarray, Put]:
    """Bytes of each value, and what writes them."""
    if kind in ("float", "double"):
        width = 4 if kind == "float" else 8
        data = np.ascontiguousarray(values.to_numpy(zero_copy_only=False).astype(f"<f{width}")).view(np.uint8).reshape(len(values), width)

        def put(buffer: np.ndarray, at: np.ndarray) -> None:
            for k in range(width):
                buffer[at + k] = data[:, k]

        return np.full(len(values), width, np.int64), put
    if kind == "boolean":
        data = values.to_numpy(zero_copy_only=False).astype(np.uint8)
        return np.ones(len(values), np.int64), lambda buffer, at: buffer.__setitem__(at, data)
    if kind == "date":
        x = values.cast(pa.int32()).to_numpy(zero_copy_only=False)
    elif kind in _MICROS or kind in _MILLIS:
        x = values.cast(pa.timestamp("us", values.type.tz)).cast(pa.int64()).to_numpy(zero_copy_only=False)
        x = x // 1000 if kind in _MILLIS else x  # earlier than the epoch too: floor
    else:
        x = values.to_numpy(zero_copy_only=False)
    z = _zigzag(x)
    lengths = _varint_lengths(z)
    return lengths, lambda buffer, at: _put_varints(buffer, at, z, lengths)


def _texts(values: pa.Array) -> tuple[np.ndarray, Put]:
    values = values.cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    z = (2 * sizes).view(np.uint64)
    heads = _varint_lengths(z)

    def put(buffer: np.ndarray, at: np.ndarray) -> None:
        _put_varints(buffer, at, z, heads)
        buffer[np.repeat(at + heads - (ends[:-1] - ends[0]), sizes) + np.arange(len(data))] = data

    return heads + sizes, put


def _column(s: Schema, values: pa.Array) -> tuple[np.ndarray, Put] | None:
    """Bytes of each row, and what writes them. None: better left to the row codec."""
    plain, branches = _plain(s)
    kind = _kind(plain)
    there = pc.is_valid(values).to_numpy(zero_copy_only=False) if values.null_count else None
    if there is not None and branches is None:
        return None  # which raises
    if there is not None:
        values = values.drop_null()
    if kind in ("string", "bytes"):
        if values.nbytes > (LONG_TEXT + 8) * max(64, len(values)):
            return None
        lengths, put = _texts(values)
    else:
        lengths, put = _numbers(kind, values)
    if branches is None:
        return lengths, put
    null, value = branches
    if there is None:
        return lengths + 1, lambda buffer, at: (buffer.__setitem__(at, value), put(buffer, at + 1))[1]
    whole = np.ones(len(there), np.int64)
    whole[there] += lengths
    return whole, lambda buffer, at: (buffer.__setitem__(at, np.where(there, value, null)), put(buffer, at[there] + 1))[1]


def rows_of(record: Record, columns: list[pa.Array], rows: int) -> tuple[memoryview, np.ndarray] | None:
    """The rows' bytes behind one another and where each ends. None if the batch is better left to the row codec."""
    parts = []
    for f, column in zip(record.fields, columns, strict=True):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if (part := _column(f.type, column)) is None:
            return None
        parts.append(part)
    before = np.zeros(rows, np.int64)
    for lengths, _ in parts:
        before += lengths
    ends = np.cumsum(before)
    at = ends - before
    buffer = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    for lengths, put in parts:
        put(buffer, at)
        at = at + lengths
    return memoryview(buffer), ends
