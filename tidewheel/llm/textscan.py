"""Vectorised scanning of UTF-8 text: words, 64-bit word hashes and hashes of word sequences.

A word hash is a polynomial in the word's bytes modulo 2**64, read from prefix sums, and then
mixed; equal words have equal hashes wherever they stand, in any task.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next batch while small."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = np.cumprod(steps, dtype=np.uint64)
        if n <= 8 << 20:
            _POWERS[int(base)] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MULTIPLIERS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MULTIPLIERS[1])
    return x ^ (x >> np.uint64(31))


def word_table(separators: str) -> np.ndarray:
    """True for the bytes of words, given the separating ASCII characters; other bytes are words."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators.encode("ascii"), np.uint8)] = False
    return table


#: Words `[^\x20\x09-\x0D]+`.
BLANK = word_table("\x20\x09\x0a\x0b\x0c\x0d")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: lower-case letters, digits and all beyond ASCII.
ALNUM = word_table("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, which never cross a text, and each text's first word index."""
    n = len(raw)
    inside = table[raw]
    joined = np.zeros(n + 1, bool)
    joined[1:n] = inside[1:] & inside[:-1] if n else False
    joined[offsets[(offsets > 0) & (offsets < n)]] = False
    starts = np.flatnonzero(inside & ~joined[:n])
    ends = np.flatnonzero(inside & ~joined[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of raw[starts:ends]."""
    inverse = _powers(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(raw), starts, ends)


def sequence_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` consecutive words; the last size - 1 places have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out + hashes[k : k + n]) * _BASE
    return mix(out)
