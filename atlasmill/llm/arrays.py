"""Vectorised text kernels shared by the operators: word spans, hashes, sliding minima over numpy arrays."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Byte values that end a word: space and \\t \\n \\v \\f \\r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII upper case to lower case, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@functools.cache
def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd multipliers."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def byte_parts(column: pa.Array, limit: int = 1 << 21):
    """Yield (first row, buffer, row offsets) over runs of rows of about limit bytes; null is an empty text.

    A row is never split, so a very long text makes one run of its own.
    """
    texts = [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        yield at, np.frombuffer(b"".join(part), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in part], dtype=np.int64)))
        at = end


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word; a word is a run of non-space bytes that does not cross rows."""
    word = ~SPACE[buf]
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = word
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(word & (~before[:-1] | cut[:-1]))
    after = np.zeros(len(buf), dtype=bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


WORD_TABLE = 4096


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: sum of bytes times position multipliers, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    sizes = ends - starts
    at = np.arange(int(sizes.sum()), dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    inside = at - np.repeat(first, sizes)
    table = odd_numbers(WORD_TABLE, 11)
    value = (buf[at + np.repeat(starts - first, sizes)].astype(U64) + U64(1)) * table[inside & (WORD_TABLE - 1)]
    if sizes.max() > WORD_TABLE:
        value *= (inside >> 12).astype(U64) * U64(2) + U64(1)
    return mix64(np.add.reduceat(value, first) + sizes.astype(U64) * U64(0x9E3779B97F4A7C15))


def gram_hashes(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of k consecutive values (length n-k+1); runs over row borders are the caller's to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    by = odd_numbers(k, seed)
    out = hashes[:n] * by[0]
    for j in range(1, k):
        out += hashes[j : j + n] * by[j]
    return mix64(out)


def row_runs(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """First index of each row's run in a sorted row array, and the end: n_rows + 1 values."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by block prefix and suffix minima: linear in n for any w."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    if w == 1:
        return values
    pad = -len(values) % w
    block = np.concatenate((values, np.full(pad, np.iinfo(values.dtype).max, dtype=values.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


BLOCK = 1 << 22


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest of each window of w hashes.

    Ordering uses the top 40 bits; equal ones go to the leftmost, so the choice depends on window content only.
    """
    out = np.empty(max(0, len(hashes) - w + 1), dtype=np.int64)
    for at in range(0, len(out), BLOCK):
        part = hashes[at : at + BLOCK + w - 1]
        key = (part & ~U64(0xFFFFFF)) | np.arange(len(part), dtype=U64)
        out[at : at + BLOCK] = (sliding_min(key, w) & U64(0xFFFFFF)).astype(np.int64) + at
    return out


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of n places covered by any of the spans."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
