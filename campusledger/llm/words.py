"""Word and shingle hashes of whole texts, in vectorised numpy.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D`` of the UTF-8 text
(the same runs as ``[^\\x20\\x09-\\x0D]+`` over code points). Words are hashed to
64 bits by a polynomial over random byte values, mixed by splitmix64; a shingle
combines the hashes of its words in order. Texts are worked through in blocks
cut at white space, so memory stays bounded by the block, not by the text.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BLOCK = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U) + U(salt) * U(0x1000003)) * U(0x9E3779B97F4A7C15)) | U(1)


_BYTE = mix64(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    if not _tables or len(_tables[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        made = []
        for b in (_BASE, inverse):
            p = np.full(size, b, U)
            p[0] = U(1)
            made.append(np.cumprod(p, dtype=U))
        _tables[:] = made
    return _tables[0], _tables[1]


def _word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = np.empty(len(a) + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~_SPACE[a]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _blocks(data: bytes):
    """Cut at white space into blocks of about ``_BLOCK`` bytes."""
    at, n = 0, len(data)
    while n - at > _BLOCK:
        end = at + _BLOCK
        while end < n and not _SPACE[data[end]]:
            end += 1
        yield at, data[at:end]
        at = end
    yield at, data[at:]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, in order."""
    out = []
    for _, part in _blocks(data):
        a = np.frombuffer(part, np.uint8)
        if not len(a):
            continue
        s, e = _word_bounds(a)
        if not len(s):
            continue
        power, inverse = _powers(len(a))
        sums = np.empty(len(a) + 1, U)
        sums[0] = 0
        np.cumsum(_BYTE[a] * power[:len(a)], out=sums[1:])
        out.append(mix64((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U)))
    return np.concatenate(out) if out else np.empty(0, U)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the words of a UTF-8 text."""
    starts, ends = [], []
    for at, part in _blocks(data):
        s, e = _word_bounds(np.frombuffer(part, np.uint8))
        starts.append(s + at)
        ends.append(e + at)
    return np.concatenate(starts), np.concatenate(ends)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """One hash per run of ``size`` words; fewer words make one shingle of all."""
    n = len(words)
    if not n:
        return np.empty(0, U)
    width = min(size, n)
    acc = np.full(n - width + 1, U(width), U)
    for j in range(width):
        acc = mix64(acc * U(0xD6E8FEB86659FD93) + words[j:n - width + 1 + j])
    return acc


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values
