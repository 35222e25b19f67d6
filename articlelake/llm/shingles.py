"""Word shingles of whole texts as sorted 64-bit hashes, computed with array operations."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class _Powers:
    """Powers of the multiplier and of its inverse, extended on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > len(self.up):
            room = max(2 * size, 1 << 14)
            self.up = np.multiply.accumulate(np.full(room, _MULTIPLIER, dtype=np.uint64))
            self.down = np.multiply.accumulate(np.full(room, _INVERSE, dtype=np.uint64))
        return self.up[:size], self.down[:size]


powers = _Powers()


def word_hashes(text: str | None) -> np.ndarray:
    """One hash for each word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, in text order."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = powers.upto(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up)])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a text, sorted; one shingle of all words if there are fewer."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    rolled = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(rolled)]
    return np.unique(mix(rolled + np.uint64(width)))
