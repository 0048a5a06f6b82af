"""Vectorised word hashing over whole Arrow batches of UTF-8 text.

One pass of numpy over the bytes of a batch gives, for every word of every
text, a 64-bit hash and its byte span.  No Python object is made per word, so
the cost is a few nanoseconds a byte and texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Odd base of the polynomial word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that part words: space and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: One random 64-bit value for each byte value.
SYMBOL = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: The same with A-Z folded to a-z.
FOLDED = SYMBOL.copy()
FOLDED[65:91] = SYMBOL[97:123]

#: Spans of more units are hashed by their content as a whole: sums of powers
#: modulo 2**64 are equal for some long spans of two units only, whatever the base.
LONG_SPAN = 256

_POWERS = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _powers(n: int, sign: int) -> np.ndarray:
    have = _POWERS[sign]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have)), BASE if sign > 0 else INVERSE, np.uint64)
        step[0] = 1
        _POWERS[sign] = have = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def long_spans(out: np.ndarray, units: np.ndarray, start: np.ndarray, end: np.ndarray, folded: bool = False) -> np.ndarray:
    """Put a digest in place of the hash of each span of over ``LONG_SPAN`` units."""
    for i in np.flatnonzero(end - start > LONG_SPAN).tolist():
        held = units[start[i]: end[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(held.lower() if folded else held, digest_size=8).digest(), "little")
    return out


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = FOLDED) -> np.ndarray:
    """64-bit hash of each byte span ``raw[start:end]``; equal spans, equal hashes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * _powers(len(raw), 1), out=run[1:])
    out = mix((run[end] - run[start]) * _powers(len(raw) + 1, -1)[start] + (end - start).astype(np.uint64))
    return long_spans(out, raw, start, end, table is FOLDED)


def word_spans(raw: np.ndarray, at: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the row it is in; ``gaps`` flags the bytes between words."""
    inside = ~gaps[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    if len(edge):  # a word never crosses from one row to the next
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at[1:], start, side="right")


def shingles(column, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingle hashes of each row, sorted, and row bounds.

    Rows with fewer words give one shingle of the whole sequence; rows with
    no words (or a null text) give none.
    """
    raw, at = text_buffers(column)
    start, end, row = word_spans(raw, at)
    word = span_hashes(raw, start, end)
    n = len(at) - 1
    words = np.bincount(row, minlength=n).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(words)])
    size_u = np.uint64(size)
    if len(word) >= size:
        rolled = np.zeros(len(word) - size + 1, np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + word[k: len(word) - size + 1 + k]
        rolled = mix(rolled + size_u)
    else:
        rolled = np.zeros(0, np.uint64)
    parts, counts = [], np.zeros(n, np.int64)
    for i in range(n):
        a, b = begin[i], begin[i + 1]
        if b == a:
            continue
        if b - a < size:
            h = np.uint64(0)
            for k in range(a, b):
                h = np.uint64((int(h) * 0xD6E8FEB86659FD93 + int(word[k])) & (1 << 64) - 1)
            own = mix(np.array([(int(h) + int(b - a)) & (1 << 64) - 1], np.uint64))
        else:
            own = np.unique(rolled[a: b - size + 1])
        parts.append(own)
        counts[i] = len(own)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(counts)])


def run_hashes(word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of each run ``word[a:b]`` of word hashes; equal runs, equal hashes."""
    if not len(a):
        return np.zeros(0, np.uint64)
    run = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * _powers(len(word), 1), out=run[1:])
    out = mix((run[b] - run[a]) * _powers(len(word) + 1, -1)[a] + (b - a).astype(np.uint64))
    return long_spans(out, word, a, b)
