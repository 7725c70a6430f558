"""Shared pieces: scratch folders all executors see, and words cut out of Arrow text buffers by numpy."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import BROADCAST_ROWS, discarded, scratch, stored

__all__ = ["ASCII_SPACE", "BROADCAST_ROWS", "LOWER", "cut", "discarded", "forgotten", "hash_runs", "kept", "mix", "numbered", "released", "row_blocks", "scratch", "stored", "table", "text_buffers"]
_U64 = np.uint64


def numbered(df: DataFrame, added: list[str], named: str) -> tuple[DataFrame, list[str], int]:
    """df under the names c0, c1, ... without columns that clash with added ones; the names left, and the place of the column named."""
    taken = {x.lower() for x in added} - {named.lower()}
    keep = [k for k, c in enumerate(df.columns) if c.lower() not in taken]
    own = [df.columns[k] for k in keep]
    rows = df.toDF(*[f"x{k}" for k in range(len(df.columns))]).select(*[f"x{k}" for k in keep])
    return rows.toDF(*[f"c{k}" for k in range(len(keep))]), own, own.index(named)


def table(chars: bytes | str) -> np.ndarray:
    """256 booleans, true for the bytes given."""
    out = np.zeros(256, bool)
    out[list(chars if isinstance(chars, bytes) else chars.encode("latin-1"))] = True
    return out


ASCII_SPACE = table(b"\t\n\v\f\r ")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the int64 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, start = len(column), column.offset
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64, n + 1 + start)[start:] if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if n and bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries give memory back by themselves
    _TRIM = None


_KEPT: dict = {}


def kept(key: str, make):
    """What make() gave in this worker for the key; only one key's value is kept at a time, from task to task."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forgotten() -> None:
    """Drops what the worker has kept: workers are used again by other operators, which need the memory."""
    _KEPT.clear()
    released()


def released() -> None:
    """Gives memory that is not used any more back to the machine, for workers that wait or do something else next."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def row_blocks(offsets: np.ndarray, most: int):
    """Ranges of rows of at most `most` bytes together; a longer row stands alone. Unused memory goes back before and after."""
    released()
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end
    released()


def cut(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes b with inside[b], never across rows nor breaks[i] (between i and i + 1): starts, ends, and each row's first run."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    in_word = inside[data]
    first = in_word.copy()
    first[1:] &= ~in_word[:-1]
    last = in_word.copy()
    last[:-1] &= ~in_word[1:]
    if breaks is not None:
        first[1:] |= breaks
        last[:-1] |= breaks
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = in_word[edge]
    last[edge - 1] = in_word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], eight bytes at a step; equal bytes give equal hashes everywhere."""
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (len(data) + 1,), (1,))
    out = sizes.astype(np.uint64) * _U64(0x9E3779B97F4A7C15)
    live, at, left = np.arange(len(starts)), starts, sizes
    while len(live):
        part = view[at] & _MASKS[np.minimum(left, 8)]
        h = (out[live] ^ part) * _U64(0xD6E8FEB86659FD93)
        out[live] = h ^ (h >> _U64(32))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return mix(out)
