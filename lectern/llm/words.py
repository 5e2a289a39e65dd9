"""Vectorised word splitting and hashing over Arrow batches of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_LONG = 512
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=_U)


def byte_table(inside) -> np.ndarray:
    """A truth value for each byte."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words separated by blanks: ``[^\x20\x09-\x0D]+``.
BLANK_WORDS = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of letters and digits, and of everything beyond ASCII (after lower-casing A-Z).
ALNUM_WORDS = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Lower-cases A-Z only.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit over all 64; works in place on a fresh copy."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Words:
    """The words of some texts: ``start``/``end`` byte offsets in ``data``; those of text i are ``first[i]:first[i+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = False):
        n = len(data)
        self.data = np.zeros(n + 8, dtype=np.uint8)
        self.data[:n] = LOWER[data] if lower else data
        self.offsets = offsets
        m = np.zeros(n + 1, dtype=bool)
        m[:n] = inside[self.data[:n]]
        begins = m[:n].copy()
        begins[1:] &= ~m[: n - 1] if n else m[:0]
        ends = m[:n] & ~m[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        begins[inner] = m[inner]
        ends[inner - 1] = m[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end, seed)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; ``data`` has 8 bytes more than its text."""
    length = end - start
    h = np.full(len(length), (seed * 0x9E3779B97F4A7C15 + 1) % 2**64, dtype=_U)
    view = np.lib.stride_tricks.as_strided(data[:8].view(_U), (max(len(data) - 7, 1),), (1,))
    todo, at, k = None, start, 0
    while k < _LONG:
        if todo is None:
            h = mix((h ^ (view[at] & _MASK[np.minimum(length, 8)])) * _U(0x9E3779B97F4A7C15))
            todo = np.flatnonzero(length > 8)
        else:
            left = length[todo] - k
            h[todo] = mix((h[todo] ^ (view[at[todo] + k] & _MASK[np.minimum(left, 8)])) * _U(0x9E3779B97F4A7C15))
            todo = todo[left > 8]
        k += 8
        if not len(todo):
            break
    h = mix(h ^ length.astype(_U))
    for i in np.flatnonzero(length > _LONG):
        word = data[start[i] : end[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=bytes([seed])).digest(), "little")
    return h


def window_hashes(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of each k consecutive word hashes (also across texts: the caller masks those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    factor, out = (0xD6E8FEB86659FD93 + 2 * seed) % 2**64 | 1, np.zeros(n, dtype=_U)
    for j in range(k):
        out *= _U(factor)
        out += h[j : j + n]
    return mix(out)


def window_hashes_at(h: np.ndarray, at: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``window_hashes`` of the windows that begin at some places only."""
    factor, out = _U((0xD6E8FEB86659FD93 + 2 * seed) % 2**64 | 1), np.zeros(len(at), dtype=_U)
    for j in range(k):
        out *= factor
        out += h[at + j]
    return mix(out)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    if len(a) < width:
        return a[:0]
    span, m = 1, a
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n, at = len(column), column.offset
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64, count=at + n + 1)[at:] if n else np.zeros(1, dtype=np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, dtype=np.uint8, count=hi)[lo:] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return body, offsets - lo


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of text each; a longer text comes alone and whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            upto = min(upto, batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto
