"""Vectorised work on Arrow list columns of 64-bit word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; a null list is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    values = column.flatten().to_numpy(zero_copy_only=False)  # flatten() leaves out what lies under nulls
    return values, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def runs(values: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each run of n consecutive values within a row, with the new offsets."""
    lengths = np.maximum(np.diff(offsets) - n + 1, 0)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(lengths, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], lengths)
    v = values.astype(np.int64).view(np.uint64)
    h = np.zeros(len(at), np.uint64)
    for i in range(n):
        h = (h * _ODD) ^ mix(v[at + i] + _A) if i else mix(v[at] + _A)
    return mix(h), out


def take_ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given rows, in the given order."""
    lengths = np.diff(offsets)[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return values[np.arange(out[-1]) + np.repeat(offsets[rows] - out[:-1], lengths)], out


def minima(hashes: np.ndarray, offsets: np.ndarray, slots: int, seed: int = 1) -> np.ndarray:
    """MinHash of each row: a matrix of rows by slots; rows without values hold the largest number."""
    n = len(offsets) - 1
    out = np.full((n, slots), np.iinfo(np.uint32).max, np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        rng = np.random.default_rng(seed)
        odd = rng.integers(1, 2**63, slots, dtype=np.uint64) | np.uint64(1)
        add = rng.integers(0, 2**63, slots, dtype=np.uint64)
        starts = offsets[some]
        for k in range(slots):
            out[some, k] = np.minimum.reduceat(((hashes * odd[k] + add[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def pack(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def unpack(column, kind, width: int) -> np.ndarray:
    """The matrix back from a column of binary values without nulls."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for c in chunks:
        if len(c):
            offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            out.append(np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width))
    return np.concatenate(out) if out else np.zeros((0, width), kind)
