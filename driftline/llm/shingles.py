"""Sets of word shingles as sorted 64-bit hashes, for many texts at once in numpy.

Words are runs of bytes other than [\\x20\\x09-\\x0D], A-Z lower-cased. A text with fewer words than a shingle has one
shingle, its whole sequence; a text without words has none. Long texts are hashed in blocks that end between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random odd-based polynomial over random byte values; upper-case letters have their lower-case letters' values.
VALUES = np.random.default_rng(11).integers(1, 2**64, 256, U)
VALUES[65:91] = VALUES[97:123]
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


_powers: list[np.ndarray] = []


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word; texts are adjacent and begin at starts, and none reaches into another."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [powers(BASE, max(n, 2 * BLOCK)), powers(INVERSE, max(n, 2 * BLOCK))]
    word = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[starts[starts < n]] = True
    begin = np.flatnonzero(word & (first[:-1] | ~np.append(False, word[:-1])))
    end = np.flatnonzero(word & (np.append(first[1:-1], True) | ~np.append(word[1:], False)))
    total = np.cumsum(VALUES[data] * _powers[0][:n], dtype=U)
    before = np.where(begin > 0, total[begin - 1], U(0))
    return mix((total[end] - before) * _powers[1][begin]), np.searchsorted(starts, begin, "right") - 1


def long_text_hashes(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text, block by block."""
    out, at = [], 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        while to < len(data) and not len(gap := np.flatnonzero(SPACE[data[at:to]])):
            to = min(to + BLOCK, len(data))
        if to < len(data):
            to = at + int(gap[-1]) + 1
        out.append(word_hashes(data[at:to], np.zeros(1, np.int64))[0])
        at = to
    return np.concatenate(out) if out else np.zeros(0, U)


def fold(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words."""
    n = len(words) - k + 1
    h = np.full(n, U(k))
    for j in range(k):
        h = mix(h * U(0xD6E8FEB86659FD93) + words[j : j + n])
    return h


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets, valid, sets = offsets - offsets[0], np.asarray(texts.is_valid()), []
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        if to == at + 1:
            words = [long_text_hashes(part)]
        else:
            hashes, text = word_hashes(part, offsets[at:to] - offsets[at])
            words = np.split(hashes, np.searchsorted(text, np.arange(1, to - at)))
        for i, own in enumerate(words):
            if not len(own) or not valid[at + i]:
                sets.append(np.zeros(0, U))
            else:
                sets.append(np.unique(fold(own, min(k, len(own)))))
        at = to
    return sets
