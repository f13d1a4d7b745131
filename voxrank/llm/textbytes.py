"""Words, lines and their hashes straight from Arrow text buffers, with numpy.

Helpers for ``mapInArrow``: a batch is cut into chunks of bounded bytes, and the
tokens of a chunk are found and hashed without a Python object per token. Hashes
are 64-bit polynomial sums with a final mix; equal tokens always agree, different
ones collide with chance 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
_BLOCK = 1 << 20  # bytes hashed at once
U = np.uint64
#: Bytes that separate words: space and U+0009-000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their ``text``, offsets of the rows in them); a null text counts as empty."""
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of the hashes over all bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte letters U+00C0-00DE."""
    out = _LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    low = out[second]
    capital = (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
    out[second[capital]] += 0x20
    return out


def tokens(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, and for each row the number of its first token (and the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1], after[-1] = inside[:-1], inside[1:], False
    before[firsts] = False
    after[firsts[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _BLOCK)
        _powers[:] = [
            np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(base))]), dtype=U)
            for base in (_BASE, pow(_BASE, -1, 2**64))
        ]
    return _powers


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        low, high = starts[at], ends[to - 1]
        power, inverse = _power_tables(high - low)
        sums = np.zeros(high - low + 1, U)
        np.cumsum((data[low:high].astype(U) + U(1)) * power[: high - low], out=sums[1:])
        first, last = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(U) * U(0xD6E8FEB86659FD93))
        at = to
    return out


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of a sequence of hashes; equal sequences agree wherever they stand."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.concatenate([[U(0)], np.cumsum(mix(values + U(1)) * power[: len(values)], dtype=U)])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on that stay inside one row, and the rows' bounds among them.

    A row with fewer words, but some, has one window of all its words.
    """
    counts = np.diff(bounds)
    n = len(words)
    total = np.zeros(n, U)
    for k in range(size):
        shifted = np.zeros(n, U)
        if k < n:
            shifted[: n - k] = words[k:]
        total = mix(total * U(0x9FB21C651E98DF25) + shifted)
    per_row = np.where(counts >= size, counts - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    whole = (np.arange(n) - bounds[:-1][row]) < per_row[row]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for r in short:  # few words: the hash of all of them
        value = U(0x51ED270B) + U(int(counts[r]))
        for w in words[bounds[r] : bounds[r + 1]]:
            value = mix(np.array([value], U) * U(0x9FB21C651E98DF25) + w)[0]
        total[bounds[r]] = value
        whole[bounds[r]] = True
        per_row[r] = 1
    return total[whole], np.concatenate([[0], np.cumsum(per_row)])


def rows_matrix(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The bytes of equally long tokens as a matrix."""
    return data[starts[:, None] + np.arange(length)]
