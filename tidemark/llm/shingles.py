"""Sets of word n-grams as sorted 64-bit hashes.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, with A-Z lowered.
A word's hash comes from running sums of a polynomial over the text, so that all words of a text are hashed at once; texts
are read in stretches, so working memory does not follow the length of a text.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each number spread over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < size:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(max(size, 1 << 16), np.uint64(base))
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word of a UTF-8 text, in order."""
    out, at = [], 0
    while at < len(data):
        end = min(at + STRETCH, len(data))
        while end < len(data):  # end a stretch after a blank, not within a word
            blanks = np.flatnonzero(_BLANK[np.frombuffer(data, np.uint8, end - at, at)])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
                break
            end = min(end + STRETCH, len(data))
        out.append(_hashes_of(_LOWER[np.frombuffer(data, np.uint8, end - at, at)]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hashes_of(text: np.ndarray) -> np.ndarray:
    edges = np.diff(np.concatenate(([False], ~_BLANK[text], [False])).view(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _power_table(len(text))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted hashes (int64) of the distinct n-grams of ``words`` words; a shorter text is one n-gram, one without words none."""
    each = word_hashes(text.encode())
    size = min(words, len(each))
    if not size:
        return np.zeros(0, np.int64)
    grams = np.full(len(each) - size + 1, np.uint64(size))
    for i in range(size):
        grams = _mixed(grams * np.uint64(_BASE) + each[i : i + len(grams)])
    return np.unique(grams.view(np.int64))


def set_signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that are the same for equal sets."""
    digest = blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
