"""Word shingles of whole texts as sorted 64-bit hashes, and their min-hash signatures."""

from __future__ import annotations

import math

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
LIMIT = 100_000


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < LIMIT and len(word) < 64:
            self[word] = h
        return h


HASHES = WordHashes()


def _odd(n: int, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


PLACES = _odd(64, 11)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words (A-Z lower-cased, split at ASCII white space).

    A text of fewer words is one shingle; null or without words: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    w = min(width, len(h))
    n = len(h) - w + 1
    with np.errstate(over="ignore"):
        s = np.full(n, w, np.uint64)
        for k in range(w):
            s += h[k : k + n] * PLACES[k % 64] if k < 64 else h[k : k + n] * (PLACES[k % 64] + np.uint64(2 * k))
        s ^= s >> np.uint64(32)
        s *= MIX
        s ^= s >> np.uint64(29)
    return np.unique(s)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = b.searchsorted(a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """True where 100 times the intersection is at least ``percent`` times the union; empty sets link with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class Signatures:
    """b-bit min-hash signatures cut into chunks, for a similarity threshold.

    There are ``chunks`` chunks of ``width`` symbols of 16 bits.  A chunk may hold one error, which is enumerated: for each symbol of
    the chunk a key is made of the others.  By the pigeonhole principle any two signatures that differ in at most
    ``2 * chunks - 1`` symbols then share a key.  ``chunks`` is the least number for which two sets just at the threshold
    share no key with a probability of at most ``miss``.  Two bits of each symbol make a sketch of two 64-bit integers; ``far`` is
    the sketch distance that sets at the threshold exceed with a probability of at most 1e-8.
    """

    def __init__(self, percent: int, width: int = 5, miss: float = 2e-7, seed: int = 7):
        j = percent / 100
        bad = 1 - j**width - width * (1 - j) * j ** (width - 1)
        self.width = width
        self.chunks = max(2, min(24, math.ceil(math.log(miss) / math.log(bad)))) if bad > 0 else 2
        self.k = self.width * self.chunks
        self.mult, self.add = _odd(self.k, seed), _odd(self.k, seed + 1)
        self.salt, self.weights = _odd(self.k, seed + 2).reshape(self.chunks, width), _odd(self.k, seed + 3).reshape(self.chunks, width)
        m, p = min(64, self.k), 0.75 * (1 - j)
        tail, self.far = 1.0, -1
        while tail > 1e-8:
            self.far += 1
            tail -= math.comb(m, self.far) * p**self.far * (1 - p) ** (m - self.far)

    def of(self, s: np.ndarray) -> tuple[list[int], int, int]:
        """(keys, sketch words 1 and 2) of a set that isn't empty, as signed 64-bit integers."""
        with np.errstate(over="ignore"):
            low = np.full(self.k, np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(s), 2048):
                m = s[i : i + 2048, None] * self.mult
                m += self.add
                np.minimum(low, m.min(axis=0), out=low)
            sym = (low * MIX) >> np.uint64(48)
            terms = (sym.reshape(self.chunks, self.width) + np.uint64(1)) * self.weights
            keys = terms.sum(axis=1, keepdims=True, dtype=np.uint64) - terms + self.salt
            keys ^= keys >> np.uint64(31)
            keys *= MIX
            keys ^= keys >> np.uint64(32)
        two = (sym & np.uint64(3))[:64]
        shift = (np.arange(len(two), dtype=np.uint64) % np.uint64(32)) * np.uint64(2)
        packed = two << shift
        s1, s2 = int(np.bitwise_or.reduce(packed[:32])), int(np.bitwise_or.reduce(packed[32:])) if len(packed) > 32 else 0
        sign = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        return keys.ravel().view(np.int64).tolist(), sign(s1), sign(s2)


def distances(s1: np.ndarray, s2: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """Sketch distances of all rows of (s1, s2) to all of (t1, t2)."""
    even = np.uint64(0x5555555555555555)
    one = np.uint64(1)
    x = s1[:, None] ^ t1[None, :]
    x |= x >> one
    x &= even
    y = s2[:, None] ^ t2[None, :]
    y |= y >> one
    y &= even
    return np.bitwise_count(x) + np.bitwise_count(y)


BITMAP = 512  # bits of a parity bitmap


def parity(s: np.ndarray) -> list[int]:
    """Parity bitmap of a set: a bit is set where an odd number of elements fall on it; eight signed 64-bit integers.

    Two bitmaps differ in at most as many bits as the sets differ in elements, so their distance rules pairs out without error.
    """
    odd = np.bincount((s >> np.uint64(7)) & np.uint64(BITMAP - 1), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()
