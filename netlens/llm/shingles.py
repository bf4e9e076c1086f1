"""Words and word n-grams of a text as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import numpy as np

from netlens.llm.common import mixed

#: Bytes of a word that have a row of their own in the table of random numbers.
PLACES = 64
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
_tables: list[np.ndarray] = []


def _table() -> np.ndarray:
    """A random number for every (place in the word, byte); made once per worker."""
    if not _tables:
        _tables.append(mixed(np.arange(PLACES * 256, dtype=np.uint64), 17))
    return _tables[0]


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words between ASCII blanks, in order."""
    data = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
    if len(data) <= PIECE:
        return _word_hashes(data)
    cuts = [0]
    while len(data) - cuts[-1] > PIECE:  # long texts go in pieces that end at a blank
        ahead = data[cuts[-1] + PIECE:]
        at = np.flatnonzero((ahead[:PIECE] == 32) | (ahead[:PIECE] == 10))
        if not len(at):
            at = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
        if not len(at):
            break
        cuts.append(cuts[-1] + PIECE + int(at[0]))
    return np.concatenate([_word_hashes(data[a:b]) for a, b in zip(cuts, [*cuts[1:], len(data)])])


def _word_hashes(data: np.ndarray) -> np.ndarray:
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.concatenate([[False], ~blank, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    letters = data[~blank].astype(np.int64)
    if int(sizes.max()) <= PLACES:
        parts = _table()[place * 256 + letters]
    else:
        parts = mixed((place * 256 + letters).astype(np.uint64), 17)
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat(parts, first) + sizes.astype(np.uint64), 3)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row; a running hash of word hashes.  Fewer than k words: none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[j:j + n]
    return mixed(total, 5)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; a text of 1 to k - 1 words has one of them all, a text without words none."""
    words = word_hashes(text)
    if 0 < len(words) < k:
        return gram_hashes(words, len(words))
    return np.unique(gram_hashes(words, k))
