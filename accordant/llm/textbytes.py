"""Kernels on UTF-8 buffers: Arrow columns in, numpy arrays out, a bounded chunk at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel handles at once; a longer document is a chunk of its own.
CHUNK = 1 << 18
U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix((np.arange(1, 257, dtype=np.uint64) * U(_BASE))) | U(1)
_powers = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.binary())
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes together, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums from which ``span_hash`` gets the hash of any span."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[data] * _power(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _power(len(sums))[1][start] + (end - start).astype(U))


def word_table(is_word) -> np.ndarray:
    """For each byte: itself with A-Z lower-cased if it belongs to words, else 0."""
    out = np.zeros(256, np.uint8)
    for b in range(1, 256):
        low = b + 32 if 65 <= b <= 90 else b
        out[b] = low if is_word(low) else 0
    return out


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, zero_is_word: bool = False):
    """Hashes of all words of a chunk, in order; for each row the index of its first word (n + 1); word starts and ends."""
    low = table[data]
    on = low != 0
    if zero_is_word:
        on |= data == 0
    rows = offsets - offsets[0]
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, on
    after = np.empty(len(data) + 1, bool)
    after[-1], after[:-1] = False, on
    starts = np.flatnonzero(on & (~before[:-1] | cut[:-1]))
    ends = np.flatnonzero(on & (~after[1:] | cut[1:])) + 1
    hashes = span_hash(prefix_hash(low), starts, ends)
    return hashes, np.searchsorted(starts, rows), starts, ends


def tidy(run):
    """``run`` over Arrow batches; at a task's end the memory that it needed goes back, as workers live on."""

    def go(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return go


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for each range in turn."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = length > 0
    start, length = start[keep], length[keep]
    heads = np.cumsum(length) - length
    out[heads[0]] = start[0]
    out[heads[1:]] = start[1:] - start[:-1] - length[:-1] + 1
    return np.cumsum(out)
