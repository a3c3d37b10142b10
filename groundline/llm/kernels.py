"""Byte-level numpy kernels that the text operators share.

Texts are handled as Arrow buffers: one uint8 array with offsets, in blocks of about ``BLOCK`` bytes (a longer text is a
block of its own), so a worker's memory follows the block and the longest text, never the partition.
A null text is an empty text throughout.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
#: The six white-space bytes of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64, on an array."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
#: For a second hash of the same bytes.
OTHER_TABLE = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        m = max(n, BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, U(base))
            steps[0] = U(1)
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """P with P[e] - P[s], times the inverse power s, the hash of data[s:e]."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans; equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array, without a copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str = "text", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of about ``size`` bytes of text: (slice, bytes, offsets)."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    give_back()


def give_back() -> None:
    """Return memory that a reused worker no longer needs to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc, "malloc_trim", None):
        trim(0)


_libc = ctypes.CDLL(None)
_worker: dict[str, Any] = {}


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept over a worker's tasks. One thing at a time: another operator's tables go first."""
    if name not in _worker:
        _worker.clear()
        _worker[name] = make()
    return _worker[name]


def forget() -> None:
    """Let go of what a worker has kept for an operator that ran before; for operators that keep nothing."""
    if _worker:
        _worker.clear()
        give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more entry at the end).

    Words never reach over the end of a text.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def code_point_starts(data: np.ndarray) -> np.ndarray:
    """True for each byte that begins a UTF-8 code point."""
    return (data & 0xC0) != 0x80


def counted(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as a signed 64-bit Arrow array."""
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))
