"""Words and word shingles of Arrow batches as 64-bit hashes, computed on whole buffers.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D, after A-Z has
been lower-cased. Its hash is a polynomial of its bytes modulo 2**64, taken from
prefix sums and then mixed; texts are cut into pieces of about ``PIECE`` bytes at
word ends, so that temporary arrays stay small however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
MULTIPLIER = 0x9E3779B97F4A7C15  # any odd number
_U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer (that of splitmix64)."""
    x = x + _U(seed * MULTIPLIER & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    """Lookup tables of a worker; powers grow with the longest piece."""

    def __init__(self):
        bytes_ = np.arange(256, dtype=np.uint8)
        self.space = (bytes_ == 0x20) | ((bytes_ >= 0x09) & (bytes_ <= 0x0D))
        lower = bytes_.astype(np.uint64)
        lower[65:91] += _U(32)
        self.value = mix(lower, 1)
        self.grow(2 * PIECE)

    def grow(self, n: int) -> None:
        self.power = _powers(MULTIPLIER, n)
        self.inverse = _powers(pow(MULTIPLIER, -1, 1 << 64), n)


_tables: _Tables | None = None


def tables() -> _Tables:
    global _tables
    if _tables is None:
        _tables = _Tables()
    return _tables


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data and data.size else np.zeros(0, np.uint8)), at


def _pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut points in the buffer: at ends of texts, in a long text before white space."""
    space, start, end, k = tables().space, int(at[0]), int(at[-1]), 0
    while start < end:
        if end - start <= PIECE:
            yield start, end
            return
        k = int(np.searchsorted(at, start + PIECE, "right")) - 1
        stop = int(at[k])
        if stop <= start:  # a text longer than a piece
            stop = start + PIECE
            while stop < end:
                found = np.flatnonzero(space[data[stop : stop + PIECE]])
                limit = int(at[k + 1])
                if len(found) and stop + found[0] < limit:
                    stop += int(found[0])
                    break
                stop = min(stop + PIECE, limit)
                if stop == limit:
                    break
        yield start, stop
        start = stop


def word_marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a buffer; a word ends with its text."""
    word = ~tables().space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at[(at >= 0) & (at <= len(data))]] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, word[1:]
    return np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1


def count_words(column: pa.Array) -> np.ndarray:
    """The number of words of each text."""
    data, at = buffers(column)
    out = np.zeros(len(at) - 1, dtype=np.int64)
    for lo, hi in _pieces(data, at):
        starts, _ = word_marks(data[lo:hi], at - lo)
        inside = np.searchsorted(starts + lo, at)
        out += np.diff(inside)
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and where each text's words begin (one more entry)."""
    data, at = buffers(column)
    t, hashes, starts_all = tables(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in _pieces(data, at):
        if hi - lo > len(t.power):
            t.grow(2 * (hi - lo))
        part = data[lo:hi]
        starts, ends = word_marks(part, at - lo)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(t.value[part] * t.power[: len(part)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * t.inverse[starts] + (ends - starts).astype(np.uint64)))
        starts_all.append(starts + lo)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_all), at)


def shingle_sets(column: pa.Array, size: int, weigh=None) -> Iterator:
    """Per text the sorted distinct hashes of its word shingles.

    A text of fewer words has one shingle, its whole sequence; one without words
    has none. With ``weigh``, which gives an integer per word hash, the sums of the
    weights of each shingle's words come too, as pairs (hashes, weights).
    """
    words, first = word_hashes(column)
    steps = [_U(pow(MULTIPLIER, 2 * j + 1, 1 << 64)) for j in range(size)]
    n = max(len(words) - size + 1, 0)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        rolled += words[j : j + n] * steps[j]
    rolled = mix(rolled, size)
    if weigh:
        single = weigh(words)
        weights = sum((single[j : j + n] for j in range(size)), np.zeros(n, dtype=np.int64))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            part = slice(a, b - size + 1)
            if weigh:
                found, at = np.unique(rolled[part], return_index=True)
                yield found, weights[part][at]
            else:
                yield np.unique(rolled[part])
        else:
            found = np.zeros(0, dtype=np.uint64)
            if b > a:
                found = mix(np.sum(words[a:b] * np.array(steps[: b - a]), keepdims=True, dtype=np.uint64), b - a)
            yield (found, np.zeros(len(found), dtype=np.int64)) if weigh else found
