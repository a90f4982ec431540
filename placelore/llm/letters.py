"""Letters of many texts as one array of code points, and the hashed character n-grams of their words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Letters:
    """Lower-cased letters of ``texts``; everything else is a boundary between words.

    codes: code points, 0 at boundaries; letter: where letters stand; begins, ends: word limits (end exclusive);
    doc: the text of each word.
    """

    def __init__(self, texts: list[str | None]):
        joined = "\0".join([(t or "").replace("\0", " ") for t in texts]).lower() + "\0"
        raw = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        letter = alphabet()[raw]
        self.codes = np.concatenate([[0], np.where(letter, raw, 0), [0]]).astype(np.uint64)
        self.letter = np.concatenate([[False], letter, [False]])
        edge = np.diff(self.letter.astype(np.int8))
        self.begins, self.ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        text_of = np.concatenate([[0], np.cumsum(raw == 0), [len(texts)]])
        self.doc = text_of[self.begins]
        self.texts = len(texts)


def mixed(x: np.ndarray, bits: int) -> np.ndarray:
    """A hash of ``bits`` bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * MULT
        x = (x ^ (x >> np.uint64(32))) * MULT
        return (x >> np.uint64(64 - bits)).astype(np.int64)


def trigrams(letters: Letters, bits: int) -> np.ndarray:
    """The hash of the three characters around each letter, boundaries included, in order of the letters."""
    at = np.flatnonzero(letters.letter)
    c = letters.codes
    return mixed((c[at - 1] << np.uint64(42)) | (c[at] << np.uint64(21)) | c[at + 1], bits)


def subwords(letters: Letters, low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word itself and of its n-grams of ``low`` to ``high`` characters with both boundaries, and where
    each word's hashes begin (one more entry at the end)."""
    c, begins, ends = letters.codes, letters.begins, letters.ends
    length = ends - begins
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    counts = [np.ones(len(begins), np.int64)] + [np.maximum(length + 2 - n + 1, 0) for n in range(low, high + 1)]
    first = np.concatenate([[0], np.cumsum(np.sum(counts, axis=0))])
    out = np.empty(first[-1], np.int64)
    with np.errstate(over="ignore"):
        # a word's own hash: its letters' values in order, by a running polynomial within the word
        value = np.zeros(len(begins), np.uint64)
        alive, k = np.arange(len(begins)), 0
        while len(alive):
            value[alive] = value[alive] * MULT + c[begins[alive] + k] + np.uint64(1)
            k += 1
            alive = alive[length[alive] > k]
        out[first[:-1]] = mixed(value ^ np.uint64(0x5555), bits)
        offset = first[:-1] + 1
        for n, count in zip(range(low, high + 1), counts[1:]):
            at = np.repeat(begins - 1, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            gram = np.full(len(at), n, np.uint64)
            for k in range(n):
                gram = gram * MULT + c[at + k] + np.uint64(1)
            out[np.repeat(offset, count) + (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count))] = mixed(gram, bits)
            offset = offset + count
    return out, first
