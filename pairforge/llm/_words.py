"""Words of many texts at once, as NumPy arrays over the UTF-8 bytes of an Arrow column.

``split`` finds every word of every row and a 64-bit hash of each (A-Z lowered).
A word's hash is a polynomial over its bytes, read off prefix sums, then mixed.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _lowered() -> np.ndarray:
    v = np.arange(256, dtype=np.uint64) + 1
    v[0x41:0x5B] += 0x20
    return v


_VALUE = _lowered()


def _class(separators) -> np.ndarray:
    t = np.ones(256, dtype=np.uint8)
    for a, b in separators:
        t[a:b + 1] = 0
    return t


#: words of ``[^\x20\x09-\x0D]+``
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
#: words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lowering A-Z
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


#: words and runs of punctuation: ``[A-Za-z0-9_\x80-\xFF]+|[^A-Za-z0-9_\s\x80-\xFF]+`` over bytes
WORDS_AND_MARKS = np.where(ALNUM, 1, np.where(SPACED, 2, 0)).astype(np.uint8)
WORDS_AND_MARKS[ord("_")] = 1


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown to the longest run of texts seen."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            globals()[name] = np.cumprod(p)
    return _powers[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the row offsets; a null row is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) \
        if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split(texts: pa.Array, kinds: np.ndarray):
    """Words are runs of bytes of one kind above 0.  (row of each word, hash of each word, start byte, end byte, words per row)."""
    data, offsets = raw(texts)
    rows = len(offsets) - 1
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none, np.zeros(rows, np.int64)
    kind = kinds[data]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:n] & (kind > 0))
    ends = np.flatnonzero(edge[1:] & (kind > 0)) + 1
    powers, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * powers[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    counts = np.diff(np.searchsorted(starts, offsets))
    return np.repeat(np.arange(rows), counts), hashes, starts, ends, counts


_STEP = np.uint64(0xD6E8FEB86659FD93)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbouring words (rows are not looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = words[:n].copy()
    for j in range(1, k):
        acc *= _STEP
        acc += words[j:n + j]
    return mix(acc + np.uint64(k))
