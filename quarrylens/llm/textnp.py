"""Words and hashes of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    up = np.cumprod(np.concatenate([one, np.full(n, BASE)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([one, np.full(n, inverse)]), dtype=np.uint64)
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i up to n at least."""
    return _powers(1 << max(18, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum over i <= k < j of (data[k] + 1) * BASE**k."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, the same wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * M2)


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer with a line end after each, and where each text starts (one more: the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per text the number of its first word (one more: the end)."""
    inside = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    w_start, w_end = edge[::2], edge[1::2]
    return w_start, w_end, np.searchsorted(w_start, starts)


def word_hashes(data: np.ndarray, w_start: np.ndarray, w_end: np.ndarray, piece: int = 1 << 17) -> np.ndarray:
    """Hash of every word; worked through in pieces of the buffer, cut between words."""
    out, i, n = np.empty(len(w_start), np.uint64), 0, len(w_start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(w_end, w_start[i] + piece, "right")))
        base = w_start[i]
        out[i:j] = span_hash(prefix_hash(data[base : w_end[j - 1]]), w_start[i:j] - base, w_end[i:j] - base)
        i = j
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n successive words; the order counts."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    key = np.full(m, n, np.uint64)
    for i in range(n):
        key = (key ^ h[i : i + m]) * BASE
        key ^= key >> np.uint64(32)
    return mix(key)


def inside_texts(first_word: np.ndarray, n: int) -> np.ndarray:
    """Whether n words from each word on stand in one text: a mask over the grams of gram_hashes."""
    total = int(first_word[-1])
    mask = np.ones(max(0, total - n + 1), bool)
    for back in range(1, n):
        at = first_word[1:-1] - back
        mask[at[(at >= 0) & (at < len(mask))]] = False
    return mask
