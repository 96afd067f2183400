"""Vectorised text primitives over whole Arrow batches.

A batch of strings becomes one array of code points plus an offset per text, so that word
splitting, hashing and window fingerprints are numpy passes over the batch instead of loops
over texts.  Positions are code points, from 0.  Null texts behave as empty texts.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Code points covered by the precomputed tables; rarer planes are looked up one by one.
TABLE = 0x20000
LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(TABLE, np.uint8)
    lower = np.arange(TABLE, dtype=np.uint32)
    for cp in range(TABLE):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat[0] == "L":
            kind[cp] = LETTER
            low = ch.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
        elif cat[0] == "N":
            kind[cp] = DIGIT
        elif ch.isspace():
            kind[cp] = SPACE
    return kind, lower


def kinds(codes: np.ndarray) -> np.ndarray:
    """LETTER, DIGIT, SPACE or OTHER of each code point."""
    kind, _ = _tables()
    out = kind[np.minimum(codes, TABLE - 1)]
    rare = np.flatnonzero(codes >= TABLE)
    for cp in np.unique(codes[rare]):
        cat = unicodedata.category(chr(cp))[0]
        out[rare[codes[rare] == cp]] = {"L": LETTER, "N": DIGIT}.get(cat, OTHER)
    return out


def lowered(codes: np.ndarray) -> np.ndarray:
    """Each code point in lower case, where that is a single code point below the table's end."""
    _, lower = _tables()
    return np.where(codes < TABLE, lower[np.minimum(codes, TABLE - 1)], codes)


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array, and the position at which each text begins (n + 1)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if len(texts) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    texts = texts.fill_null("").cast(pa.large_string())
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    return codes, heads[ends - ends[0]]


def texts_of(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The strings codes[start : start + length]."""
    ends = np.cumsum(length)
    some = codes[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
    size = 1 + (some >= 0x80) + (some >= 0x800) + (some >= 0x10000)
    after = np.r_[0, np.cumsum(size)][np.r_[0, ends]].astype(np.int64)
    raw = some.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(after), pa.py_buffer(raw)]).cast(pa.string())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: flips about half of the output bits for each input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=2)
def _mixed(lower: bool) -> np.ndarray:
    return mix((_tables()[1] if lower else np.arange(TABLE)).astype(np.uint64) + np.uint64(1))


def mixed_chars(codes: np.ndarray, lower: bool = False) -> np.ndarray:
    """mix(code + 1) of each code point, in lower case if asked."""
    table = _mixed(lower)
    out = table[np.minimum(codes, TABLE - 1)]
    if len(codes) and codes.max() >= TABLE:
        rare = np.flatnonzero(codes >= TABLE)
        out[rare] = mix(codes[rare].astype(np.uint64) + np.uint64(1))
    return out


_BASE = np.uint64(0x5851F42D4C957F2D)
#: Second modulus of span_hash, a Mersenne prime, and its base.
_M31, _BASE31 = np.uint64((1 << 31) - 1), 0x2F0B4A37
_31 = np.uint64(31)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _folded(x: np.ndarray) -> np.ndarray:
    """x below 2^63 modulo 2^31 - 1."""
    for _ in range(2):
        high = x >> _31
        x = x & _M31
        x += high
    x -= (x >= _M31) * _M31
    return x


@lru_cache(maxsize=4)
def _powers31(n: int) -> tuple[np.ndarray, np.ndarray]:
    m = int(_M31)
    out = []
    for base in (_BASE31, pow(_BASE31, -1, m)):
        p = np.ones(n, np.uint64)
        k = 1
        while k < n:
            p[k : 2 * k] = _folded(p[: min(k, n - k)] * np.uint64(pow(base, k, m)))
            k *= 2
        out.append(p)
    return out[0], out[1]


def prefix_hash(codes: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for span_hash over code points (n + 1), modulo 2^64 and for modulo 2^31 - 1."""
    n = len(codes)
    size = 1 << max(10, (n + 1).bit_length())
    mixed = mixed_chars(codes, lower)
    out, low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(mixed * _powers(size)[0][:n], out=out[1:])
    x = (mixed >> np.uint64(33)) * _powers31(size)[0][:n]
    np.cumsum((x & _M31) + (x >> _31), out=low[1:])
    return out, low


def span_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] that doesn't depend on where the span stands.

    Made of two polynomials: modulo 2^64 alone, built texts (Thue and Morse's) would collide.
    """
    p, low = prefix
    size = 1 << max(10, len(p).bit_length())
    small = _folded(_folded(low[end] - low[start]) * _powers31(size)[1][start])
    return mix((p[end] - p[start]) * _powers(size)[1][start] ^ mix(small))


def gram_hash(prefix: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """A hash of each values[i : i + size], modulo 2^64 alone: to choose among grams, not to tell
    them apart."""
    p = prefix[0]
    n = len(p) - size
    return mix((p[size:] - p[:n]) * _powers(1 << max(10, len(p).bit_length()))[1][:n])


def words_of(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of letters or digits, case ignored) of all texts.

    Returns the hash of each word, its start position in ``codes`` and for each text the index
    of its first word (n + 1).
    """
    kind = kinds(codes)
    inside = (kind == LETTER) | (kind == DIGIT)
    edge = np.zeros(len(codes) + 1, bool)
    edge[begins] = True
    before = np.zeros(len(codes) + 1, bool)
    before[1:] = inside
    start = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.zeros(len(codes) + 1, bool)
    after[:-1] = inside
    end = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    prefix = prefix_hash(codes, lower=True)
    return span_hash(prefix, start, end), start, np.searchsorted(start, begins)


def chunks(begins: np.ndarray, size: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about ``size`` code points, so that work arrays stay in the cache."""
    out, at, n = [], 0, len(begins) - 1
    while at < n:
        end = int(np.searchsorted(begins, begins[at] + size, "right")) - 1
        end = min(n, max(at + 1, end))
        out.append((at, end))
        at = end
    return out
