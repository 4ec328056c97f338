"""Reading many binary values at once: numpy over the bytes of an Arrow column, one step for all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: What varints() tells of each row.
READ, INCOMPLETE, TOO_LARGE = 0, 1, 2


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A binary column's bytes, where each value begins and ends, and whether it is valid. Sixteen zeros follow the bytes, so that short reads stay inside."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    valid = np.asarray(column.is_valid()) if column.null_count else np.ones(len(column), bool)
    return np.concatenate([data, np.zeros(16, np.uint8)]), at[:-1], at[1:], valid


def varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The varint of each row from at on: its value, where it ends, and how reading went. Bits above 64 are lost."""
    value, place, status = np.zeros(len(at), np.uint64), at.copy(), np.zeros(len(at), np.int8)
    live = np.arange(len(at))
    for i in range(10):
        inside = place[live] < end[live]
        if not inside.all():
            status[live[~inside]] = INCOMPLETE
            live = live[inside]
        byte = data[place[live]]
        value[live] |= (byte & 127).astype(np.uint64) << np.uint64(7 * i)
        place[live] += 1
        live = live[byte > 127]
        if not len(live):
            return value, place, status
    status[live] = TOO_LARGE
    return value, place, status


def sizes(value: np.ndarray) -> np.ndarray:
    """Lengths that varints state, as signed numbers; those beyond any buffer stay beyond."""
    return np.minimum(value, np.uint64(1 << 48)).astype(np.int64)


def numbers(data: np.ndarray, at: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The little-endian number of each row at a place."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(kind.itemsize)]).view(kind).ravel()


def pieces(data: np.ndarray, at: np.ndarray, size: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A binary column of size bytes from at on for each row; null where not valid."""
    size = np.where(valid, size, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
    mask = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.large_binary(), len(at), [mask, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
