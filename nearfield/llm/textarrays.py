"""Numpy kernels on the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel looks at together; its arrays take about 60 times as much.
SLICE = 1 << 19

_U = np.uint64
_ONE = _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_rng = np.random.default_rng(20_011)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _ONE
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_STEP), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_pow = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) < n:
        size = max(n, 2 * len(_pow[0]), SLICE + 1)
        up = np.full(size, _STEP, np.uint64)
        down = np.full(size, _BACK, np.uint64)
        up[0] = down[0] = 1
        _pow = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _pow


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit polynomial hash (mixed with the length) of each byte run data[start:end]."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Bytes of a term: ASCII letters and digits, and all of other scripts.
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space, or of the bytes ``within``), and the first word of each row."""
    solid = ~_SPACE[data] if within is None else within[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[inner] = solid[inner]
    end[inner[inner > 0] - 1] = solid[inner[inner > 0] - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def codepoints(data: np.ndarray) -> np.ndarray:
    """Code points of valid UTF-8 bytes, as unsigned 32-bit integers."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
