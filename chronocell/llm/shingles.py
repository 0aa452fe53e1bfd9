"""Word shingles of texts as 64-bit numbers, a batch of texts at a time.

Words are maximal runs of bytes other than ASCII white space after ASCII
lower-casing; ``bytes.lower`` and ``bytes.split`` do exactly that to UTF-8.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd 64-bit multipliers, one a position in the shingle (fixed values of this format).
POSITION = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)
#: Words that one worker remembers the hashes of before it starts afresh.
REMEMBERED = 400_000

_seen: dict[bytes, int] = {}


def _hash_word(word: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(word)
    if len(_seen) >= REMEMBERED:
        _seen.clear()
    _seen[word] = value
    return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    get = _seen.get
    return np.array([get(w) or _hash_word(w) for w in words], dtype=np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingles of ``size`` words; all words as one when there are fewer; none for no words."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(31) + words[k : n - width + 1 + k] * POSITION[k % len(POSITION)]
    return np.unique(mix64(total))
