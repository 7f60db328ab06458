"""Vectorised tokens of Arrow text columns.

A text column in Arrow is one byte buffer with offsets, so words can be found, lower-cased and hashed with
numpy over the bytes, without a Python string for each. White space, ASCII letters and digits are single
bytes in UTF-8, hence classes of bytes are enough for the word patterns that the operators use.

A word's hash mixes its bytes eight at a time; of a very long one it is a polynomial over a random table of byte
values, modulo 2**64. Equal words have equal hashes; different words share one with a probability near 2**-64, so a
pair of hashes is taken as proof of equality where texts of a corpus are compared pair by pair.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Bytes of text that are worked on at once; one longer text is a piece by itself.
PIECE = 1 << 20

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~_space
_alnum = np.zeros(256, bool)
_alnum[0x30:0x3A] = _alnum[0x41:0x5B] = _alnum[0x61:0x7B] = _alnum[0x80:] = True
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, ASCII letters and all beyond ASCII
ALNUM = _alnum

_values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_values[0x41:0x5B] = _values[0x61:0x7B]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(range(256)).lower()
_masks = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
#: Bytes from which a word is hashed as a polynomial.
LONG_WORD = 256


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_power_cache: list[np.ndarray] = [_powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)]


def _power(n: int) -> list[np.ndarray]:
    if len(_power_cache[0]) < n:
        size = max(n, PIECE + 1)
        if size > 8 * PIECE:  # kept for no longer than the one very long text
            return [_powers(_BASE, size), _powers(_INVERSE, size)]
        _power_cache[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    return _power_cache


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of SplitMix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if not len(column):
        ends = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold ``most`` bytes together, or one row that alone has more."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def spans(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each row's words begin in these arrays."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = np.frombuffer(raw.tobytes().translate(word.tobytes()), bool)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    # where one row ends and the next begins in a word, one word ends and another begins
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    cut = np.unique(cut[inside[cut] & inside[cut + 1]])
    if len(cut):
        start, end = (np.insert(x, np.searchsorted(x, cut), cut) for x in (start, end))
    return start, end, np.searchsorted(start, offsets)


def _polynomial(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of long spans, whose cost doesn't hang on the longest: a polynomial over byte values."""
    low = int(start.min())
    raw, start, end = raw[low : int(end.max())], start - low, end - low
    power, inverse = _power(len(raw))
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_values[raw] * power[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U))


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of lower-cased bytes."""
    if not len(start):
        return np.zeros(0, _U)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    size = end - start
    out = mix((eight[start] & _masks[np.minimum(size, 8)]) ^ (size.astype(_U) * _U(_BASE)))
    at, left = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
    while len(left):
        part = eight[start[left] + at] & _masks[np.minimum(size[left] - at, 8)]
        out[left] = mix(out[left] * _U(0x2545F4914F6CDD1D) + part)
        at += 8
        left = left[size[left] > at]
    left = np.flatnonzero(size > LONG_WORD)
    if len(left):
        out[left] = _polynomial(raw, start[left], end[left])
    return out


def words(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where each row's words begin."""
    start, end, at = spans(raw, offsets, word)
    return hashes(raw, start, end), at


def shingles(token: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words within each row, and where each row's begin.

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    count = np.diff(at)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate(([0], np.cumsum(made)))
    total = int(out_at[-1])
    if not total:
        return np.zeros(0, _U), out_at
    row = np.repeat(np.arange(len(count)), made)
    first = np.arange(total) - out_at[row] + at[row]
    size = np.minimum(count[row], n)
    value = np.full(total, 0x51ED270B, _U) + size.astype(_U)
    for i in range(n):
        there = size > i
        nxt = token[np.where(there, first + i, 0)]
        value = np.where(there, mix(value * _U(0x2545F4914F6CDD1D) + nxt), value) if not there.all() else mix(value * _U(0x2545F4914F6CDD1D) + nxt)
    return value, out_at


def sorted_rows(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of each row in order."""
    out = values.copy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    return out


def firsts(ordered: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the values, in order within each row, differ from the one before in their row."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    new[at[:-1][at[:-1] < len(ordered)]] = True
    return new


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, and where each row's begin."""
    ordered = sorted_rows(values, at)
    new = firsts(ordered, at)
    return ordered[new], np.concatenate(([0], np.cumsum(new)))[at]


def release() -> None:
    """Give memory that nothing holds back to the system: a worker that waits for its next task keeps it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function of batches that gives memory back after each batch and at its end."""

    @functools.wraps(run)
    def tidied(batches):  # noqa: ANN001, ANN202
        def each():
            for batch in batches:
                yield batch
                del batch
                release()

        yield from run(each())
        release()

    return tidied
