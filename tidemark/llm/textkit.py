"""Vectorised work on batches of texts: word spans, hashes and window shingles over one UTF-8 buffer.

All functions take a whole Arrow batch of strings as one byte buffer with document offsets. Nothing is cut or
sampled; a null text has no bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64


#: What other modules keep in a worker between tasks; :func:`trim` drops it.
KEPT: list[Callable[[], None]] = []


def trim() -> None:
    """Give memory back to the system: Python workers live on from task to task and share an executor's limit."""
    for drop in KEPT:
        drop()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), in place on a copy."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


#: Random 64-bit value of a byte at a position in its word, positions modulo 64.
_SPOTS = 64
_TAB = mix(np.arange(1, _SPOTS * 256 + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Words of the alphanumeric kind: ASCII digits and letters, and everything outside ASCII.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Words of the white-space kind: anything but space and \t \n \v \f \r.
NONSPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets (one more than documents) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch in text order: byte spans, document of each, and each document's first word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # documents + 1


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    n_docs = len(offsets) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(n_docs + 1, np.int64))
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    first = np.searchsorted(s, offsets)
    return Words(s, e, np.repeat(np.arange(n_docs), np.diff(first)), first)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the spans are disjoint and in order. Blocks bound the memory."""
    out = np.empty(len(start), _U)
    size = 1 << 17
    for i in range(0, len(start), size):
        s, e = start[i : i + size], end[i : i + size]
        length = e - s
        base = np.cumsum(length) - length
        spot = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(base, length)
        chars = data[spot + np.repeat(s, length)].astype(np.int64)
        value = _TAB[((spot & (_SPOTS - 1)) << 8) | chars]
        far = spot >= _SPOTS
        if far.any():
            value[far] *= (spot[far] >> 6).astype(_U) * _U(2) + _U(1)
            value[far] = mix(value[far])
        out[i : i + size] = np.add.reduceat(value, base) if len(base) else value
        out[i : i + size] += length.astype(_U)
    return mix(out)


def windows(word_hash: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of ``k`` consecutive words inside one document."""
    n = len(word_hash)
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.zeros(n - k + 1, _U)
    for j in range(k):
        h = h * _U(0x9E3779B97F4A7C15) + word_hash[j : n - k + 1 + j]
    at = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
    return mix(h[at]), at


def shingles(word_hash: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each shingle, in document order: ``k``-word windows, or all words of a shorter document."""
    h, at = windows(word_hash, words, k)
    doc = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), _U)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] = extra[has] * _U(0x9E3779B97F4A7C15) + word_hash[words.first[short[has]] + j]
        h, doc = np.r_[h, mix(extra + count[short].astype(_U))], np.r_[doc, short]
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's slice ``first[i]:first[i+1]``."""
    total = np.r_[np.zeros(1, values.dtype), np.cumsum(values)]
    return total[first[1:]] - total[first[:-1]]


def pieces(column: pa.Array, max_bytes: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of a batch with about ``max_bytes`` of text each; a longer text stands alone, whole."""
    _, offsets = buffers(column)
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max_bytes, side="right")) - 1)
        out.append((a, b))
        a = b
    return out
