"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII lower-casing of bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Most words whose hash a worker remembers before it starts over.
CACHE_ITEMS = 250_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sets of k-word shingles. With fewer than k words the whole sequence is one shingle; without words the set is empty."""

    def __init__(self, k: int):
        self.k, self.hashes = k, _WordHashes()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.hashes) > CACHE_ITEMS:
            self.hashes.clear()
        known = self.hashes.__getitem__
        out = []
        for text in texts:
            # bytes.split() parts words at exactly space, tab, LF, VT, FF and CR.
            words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
            h = np.array(list(map(known, words)), np.uint64)
            n = len(h)
            if not n:
                out.append(h)
                continue
            width = min(self.k, n)
            x = mixed(h[: n - width + 1] + np.uint64(width))
            for j in range(1, width):
                x = mixed(x + h[j : n - width + 1 + j])
            out.append(np.unique(x))
        return out
