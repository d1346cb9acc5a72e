"""Word and n-gram hashes of whole texts, computed a text at a time.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and carriage
return, taken unchanged.  ``bytes.split()`` cuts at exactly these.  A word's hash is XXH3 of its UTF-8 bytes; the hash
of a run of words comes from those of two shorter runs, with a mix after each step, so that neither long words nor
repetitive runs collide more often than others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

_LEFT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of each word's start and end."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    if not space[-1]:
        edges = np.concatenate([edges, [len(data)]])
    return edges[0::2], edges[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a UTF-8 text."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_digests(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes for each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * _LEFT + b)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, span, runs = None, 0, 1, words
    while True:  # ``runs`` has the hashes of runs of ``span`` words; k is a sum of such spans
        if k & span:
            out = runs[done : done + n] if out is None else _joined(out, runs[done : done + n])
            done += span
        if 2 * span > k:
            return mix(out) if k == 1 else out
        runs, span = _joined(runs[:-span], runs[span:]), 2 * span


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; a text of 1 to k-1 words has one shingle, all of its words."""
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else np.zeros(0, np.uint64)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The index of the least value in each window of ``width``; the first among equal values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(values)), 1
    while span < width:  # windows of 1, 2, 4, ... values; the last step overlaps
        step = min(span, width - span)
        a, b = best[:-step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        span += step
    return best
