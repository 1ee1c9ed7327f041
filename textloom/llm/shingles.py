"""Word hashes, word-shingle sets and one-permutation signatures in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

STORE = 400_000
# Odd multipliers for the words of a shingle, and the two of the finishing mix: powers of the golden ratio's bits.
GOLDEN = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def factors(n: int) -> np.ndarray:
    """n odd 64-bit multipliers: powers of one odd number."""
    return np.array([pow(GOLDEN, k + 1, 1 << 64) for k in range(n)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hash of each word, kept for the words met lately: at most STORE."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= STORE:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of size word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, f in enumerate(factors(size)):
        total += hashes[k : k + n] * f
    return mix(total)


def shingle_set(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted set of size-word shingles' hashes; a shorter text is one shingle, none without words."""
    if 0 < len(hashes) < size:
        return mix(windows(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(windows(hashes, size))


class OnePermutation:
    """One-permutation MinHash: a set's hashes fall into bins by their top bits, each bin keeps its least.

    Empty bins are filled by optimal densification: bin j takes the value of
    the first non-empty bin in j's own random order of bins, so equal fillings
    are as likely as the sets are alike, independently for each bin.
    """

    def __init__(self, bins: int = 128, bands: int = 32):
        if bins & (bins - 1) or bins % bands:
            raise ValueError("bins must be a power of 2 and a multiple of bands")
        self.bins, self.bands, self.rows = bins, bands, bins // bands
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self.edges = np.arange(bins, dtype=np.uint64) << self.shift
        self.factor = factors(self.rows)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(GOLDEN))

    def _donors(self, empty: np.ndarray, attempt: int) -> np.ndarray:
        return (mix(empty.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64((attempt + 1) * int(_MIX2) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(self.bins)).astype(np.int64)

    def signature(self, ordered: np.ndarray) -> np.ndarray:
        """The signature of a non-empty sorted set of hashes."""
        at = np.minimum(np.searchsorted(ordered, self.edges), len(ordered) - 1)
        sig = ordered[at]
        full = (sig >> self.shift) == np.arange(self.bins, dtype=np.uint64)
        empty, attempt = np.flatnonzero(~full), 0
        while len(empty):
            donors = self._donors(empty, attempt)
            hit = full[donors]
            sig[empty[hit]] = sig[donors[hit]]
            empty, attempt = empty[~hit], attempt + 1
        return sig

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """A 64-bit key of each band of the signature."""
        with np.errstate(over="ignore"):
            return mix((sig.reshape(self.bands, self.rows) * self.factor).sum(axis=1, dtype=np.uint64) ^ self.salt).view(np.int64)
