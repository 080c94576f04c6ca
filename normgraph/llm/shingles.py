"""Words, word hashes and word shingles of whole texts, vectorised over bytes.

A word is a maximal run of characters other than space and U+0009 to U+000D. All separators are ASCII, so
words can be found in the UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of a polynomial hash modulo 2^64 and of the shingle combination.
_BASE = np.uint64(0x5851F42D4C957F2D)
_MIX = np.random.default_rng(20240601).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SEGMENT = 1 << 20
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications, a bijection."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xCF1BBCDCB7A56463)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> None:
    global _power, _inverse
    if len(_power) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        first = np.ones(1, np.uint64)
        _power = np.cumprod(np.concatenate([first, np.full(size - 1, _BASE)]))
        _inverse = np.cumprod(np.concatenate([first, np.full(size - 1, inverse)]))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the first and past the last byte of each word."""
    edge = np.empty(len(data) + 2, np.int8)
    edge[0] = edge[-1] = 0
    np.logical_not(SPACE[data], out=edge[1:-1], casting="unsafe")
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in ascending order."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        stop = max(at + 1, int(np.searchsorted(end, low + _SEGMENT, "right")))  # spans of one segment
        part = data[low : int(end[stop - 1])]
        _powers(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power[: len(part)], out=total[1:])
        s, e = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = mix((total[e] - total[s]) * _inverse[s] + (e - s).astype(np.uint64) * _MIX[0])
        at = stop
    return out


def word_hashes(data: np.ndarray) -> np.ndarray:
    return span_hashes(data, *word_spans(data))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of so many words; none if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * _MIX[1]
    for k in range(1, width):
        total += words[k : k + n] * _MIX[k + 1]
    return mix(total)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word windows; a text of fewer words has one shingle of all its words, an empty one none."""
    if not text:
        return np.empty(0, np.uint64)
    words = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))
