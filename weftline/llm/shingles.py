"""Word shingles as sorted arrays of 64-bit hashes, computed by array operations over many texts."""

from __future__ import annotations

import numpy as np

#: Words in a shingle.
WORDS = 5
#: Bytes hashed at a time, unless one text is longer.
BLOCK = 1 << 21

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Seed of the keys that words are hashed with.
SEED = 77
_PLUS = np.arange(1, 257, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Keys:
    """Random 64-bit keys by place in a word, as many as needed. A word's hash is the sum of its letters
    times the keys of their places: for any two different words, about one choice of keys in 2^56 makes
    them equal, whatever their length."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.keys):
            self.keys = np.random.PCG64(SEED).random_raw(max(n, 2 * len(self.keys), 1024))
        return self.keys


_KEYS = _Keys()


def _block(texts: list[bytes]) -> list[np.ndarray]:
    flat = _LOWER[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)]
    blank = _BLANK[flat]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    words = np.zeros(0, dtype=np.uint64)
    if len(starts):
        longest = int((ends - starts).max())
        gaps = np.diff(starts, append=len(flat))
        place = np.zeros(len(flat), dtype=np.int32)
        place[starts[0] :] = np.arange(len(flat) - starts[0], dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), gaps)
        keyed = _KEYS.upto(longest + 1).take(place, mode="clip")
        keyed *= _PLUS.take(flat)
        sums = np.cumsum(keyed, out=keyed)
        words = mix(sums[ends - 1] - sums[starts - 1])
    n = len(words)
    rolled = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
    for i in range(WORDS):
        rolled = rolled * np.uint64(_BASE) + words[i : i + len(rolled)]
    rolled = mix(rolled + np.uint64(WORDS))
    edges = np.searchsorted(starts, np.cumsum([1 + len(t) for t in texts])).tolist()
    found = []
    for a, b in zip([0, *edges], edges, strict=False):
        if b - a >= WORDS:
            s = np.sort(rolled[a : b - WORDS + 1])
            found.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:  # all the words as one
            h = np.zeros(1, dtype=np.uint64)
            for i in range(a, b):
                h = h * np.uint64(_BASE) + words[i]
            found.append(mix(h + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The set of each text: distinct shingles of A-Z-lower-cased words, sorted by hash."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    found: list[np.ndarray] = []
    block: list[bytes] = []
    size = 0
    for t in raw:
        if block and size + len(t) > BLOCK:
            found += _block(block)
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    return found + (_block(block) if block else [])


def word_shingles(text: str) -> set[tuple[bytes, ...]]:
    """The set of one text, of the words themselves."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))} if words else set()
