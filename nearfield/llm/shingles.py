"""Sets of word shingles as sorted 64-bit hashes, made by numpy for many texts at once.

Words are runs of bytes other than 32 and 9 to 13, with A-Z in lower case. A text with fewer words than a
shingle has its whole sequence as the one shingle; a text without words has the empty set.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    start = seed * 0xD1B54A32D192ED03 & _MASK
    return mix(np.uint64(start) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN))


_BYTE = stream(1, 256)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = stream(2, 64) | np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, 0xD6E8FEB86659FD95 | 5, np.uint64))])
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the place of each text's first word (one more at the end)."""
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = _IS_WORD[buf]
    if not inside.any():
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    sizes = ends - begins
    first = np.cumsum(sizes) - sizes
    letters = buf[inside]
    offset = np.arange(len(letters)) - np.repeat(first, sizes)
    hashes = mix(np.add.reduceat(_BYTE[letters] * _powers(int(sizes.max()) + 1)[offset], first))
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(begins, borders)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    words, at = word_hashes(texts)
    n = len(words)
    if n >= width:
        rolled = words[: n - width + 1] * _PLACE[0]
        for j in range(1, width):
            rolled += words[j : n - width + 1 + j] * _PLACE[j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s if len(s) < 2 else s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
