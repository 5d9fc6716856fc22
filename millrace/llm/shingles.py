"""Five-word shingles of whole texts as 64-bit hashes.

Words are runs of non-blank characters (blanks: 09-0D and 20) with A-Z
lower-cased.  A hash stands for its shingle: two different shingles of a pair
of documents collide with a probability of about n**2 / 2**64.
"""

from __future__ import annotations

import numpy as np
import xxhash

CACHE, K = 250_000, 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], cache: Words, k: int = K) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text of fewer words than k is one shingle, one without words none."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    ends = np.cumsum([0, *map(len, words)]).tolist()
    w = np.fromiter((h for ws in words for h in map(cache.__getitem__, ws)), np.uint64, ends[-1])
    h = np.zeros(max(len(w) - k + 1, 0), np.uint64)
    for i in range(k if len(h) else 0):
        h *= _STEP
        h += w[i : len(h) + i]
    h = mix(h)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= k:
            s = np.sort(h[a : b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
        elif b > a:
            s = b - a
            for x in w[a:b].tolist():
                s = (s * int(_STEP) + x) % (1 << 64)
            out.append(mix(np.array([s ^ 0x5851F42D4C957F2D], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
