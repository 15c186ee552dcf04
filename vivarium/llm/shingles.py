"""Word shingles as 64-bit hashes, computed for many texts at once in numpy.

A word is a maximal run of letters or digits of the lower-cased text. A text of five words or more has one shingle for
each five words in a row; a text of one to four words has one shingle, all of its words; a text without words has none.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

WIDTH = 5
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter or digit, and its random value."""
    alnum = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return alnum, mix(np.arange(1, 0x110001, dtype=U) * U(_BASE))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64, for i up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, U)
            out[1:] = U(base)
            _powers[key] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


@dataclass
class Shingled:
    """Shingles of texts one after the other; text i has shingles first[i]:first[i + 1]."""

    shingles: np.ndarray
    first: np.ndarray
    words: np.ndarray
    word_first: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingle(texts: list[str | None], width: int = WIDTH) -> Shingled:
    lower = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lower])
    codes = np.frombuffer("".join(t + "\n" for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    alnum, value = _letters()
    inside = alnum[codes]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(codes))
    total = np.zeros(len(codes) + 1, U)
    np.cumsum(np.where(inside, value[codes] * up[: len(codes)], U(0)), out=total[1:])
    words = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U))
    word_first = np.concatenate(([0], np.searchsorted(begin, ends)))
    n = np.diff(word_first)

    kept = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(kept)))
    if len(words) == 0:
        return Shingled(np.zeros(0, U), first, words, word_first)
    padded = np.concatenate((words, np.zeros(width, U)))
    every = np.zeros(len(words), U)
    for k in range(width):
        every += padded[k : k + len(words)] * U(pow(_BASE, 2 * k + 1, 1 << 64))
    at = np.arange(first[-1]) - np.repeat(first[:-1], kept) + np.repeat(word_first[:-1], kept)
    out = mix(every[at])
    for i in np.flatnonzero((n > 0) & (n < width)):  # short texts: all of their words, and no word of the next text
        out[first[i]] = word_runs(words[word_first[i] : word_first[i + 1]], int(n[i]))[0]
    return Shingled(out, first, words, word_first)


def word_runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` words in a row, that of a whole text of so many words if they are under WIDTH."""
    total = np.full(max(len(words) - size + 1, 0), size, U)
    for k in range(size):
        total += words[k : k + len(total)] * U(pow(_BASE, 2 * k + 2, 1 << 64))
    return mix(total)


def content_keys(s: Shingled) -> list[str]:
    """128 bits of each text's words in order, as hexadecimal; '' for a text without words."""
    n = np.diff(s.word_first)
    place = (np.arange(len(s.words)) - np.repeat(s.word_first[:-1], n)).astype(U)
    parts = []
    for salt in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7):
        summed = np.concatenate((np.zeros(1, U), np.cumsum(mix(s.words ^ mix(place * U(salt) + U(salt))))))
        parts.append(summed[s.word_first[1:]] - summed[s.word_first[:-1]])
    return [f"{a:016x}{b:016x}" if k else "" for a, b, k in zip(parts[0].tolist(), parts[1].tolist(), n.tolist())]


def multiset(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct shingles in order and how often each occurs."""
    return np.unique(shingle([text]).shingles, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser counts over the sum of the greater ones; 0 if either has no shingle."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - shared
    return float(shared / union) if union else 0.0
