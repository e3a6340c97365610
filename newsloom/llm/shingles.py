"""Hashed five-word shingles of whole texts, in numpy over Arrow buffers."""

from __future__ import annotations

import numpy as np
import xxhash

from newsloom.llm.common import RollingHash, mix64, random_words

WIDTH = 5
#: Longer words are hashed byte by byte: a polynomial modulo a power of two confuses some regular strings of a thousand letters.
PLAIN_WORD = 256


def _kind_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return lower, space


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased), and the number of words of each text."""
    lower, space = _kind_tables()
    text = lower[raw]
    gap = np.ones(len(raw) + 1, bool)
    gap[:-1] = space[text]
    # A text boundary ends a word like white space does.
    begins = ~gap[:-1]
    begins[1:] &= gap[:-2]
    fresh = at[:-1][at[:-1] < at[1:]]
    begins[fresh] = ~gap[fresh]
    ends = ~gap[:-1] & gap[1:]
    ends[at[1:][at[:-1] < at[1:]] - 1] |= ~gap[at[1:][at[:-1] < at[1:]] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = RollingHash(text).ranges(start, end)
    for i in np.flatnonzero(end - start > PLAIN_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]].tobytes())
    counts = np.diff(np.searchsorted(start, at))
    return mix64(hashes + (end - start).astype(np.uint64)), counts


def shingles(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts one after another, their offsets by text, and a hash of each word sequence.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    The sequence hash is two 64-bit numbers a text, shape (texts, 2).
    """
    words, counts = word_hashes(raw, at)
    n = len(counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    factors = random_words(width, 77) | np.uint64(1)
    made = np.maximum(counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(n), made)
    begin = first[owner] + np.arange(offsets[-1]) - offsets[owner]
    length = np.minimum(counts[owner], width)
    out = random_words(width + 1, 5)[length]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        out += np.where(k < length, padded[begin + k] * factors[k], np.uint64(0))
    sequence = np.zeros((n, 2), np.uint64)
    for k, seed in enumerate((101, 202)):
        place = np.arange(len(words)) - np.repeat(first[:-1], counts)
        mixed = mix64(words + mix64(place.astype(np.uint64) + random_words(1, seed)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        sequence[:, k] = mix64(sums[first[1:]] - sums[first[:-1]] + counts.astype(np.uint64))
    return mix64(out), offsets, sequence


def distinct_counts(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of different shingles of each text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(out)):
        one = np.sort(values[offsets[i] : offsets[i + 1]])
        out[i] = len(one) and 1 + np.count_nonzero(one[1:] != one[:-1])
    return out
