"""Sets of word shingles of whole texts, as sorted 64-bit hashes, in numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=np.bool_)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a megabyte, or one text."""
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) < most):
            total += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word with A-Z lower-cased, number of words before each text and in all)."""
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    x = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    space = _SPACE[x]
    begins = ~space
    begins[1:] &= space[:-1]
    at = np.flatnonzero(begins)
    before = np.searchsorted(at, np.r_[0, np.cumsum(size)])
    letter = np.flatnonzero(~space)
    edges = np.searchsorted(letter, at)
    word = np.repeat(np.arange(len(at)), np.diff(np.r_[edges, len(letter)]))
    spot = (letter - at[word]).astype(np.uint64)
    with np.errstate(over="ignore"):
        code = mix((spot << np.uint64(8) | _LOWER[x[letter]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
        total = np.r_[np.uint64(0), np.cumsum(code, dtype=np.uint64)]
        return mix(total[np.r_[edges[1:], len(letter)].astype(np.int64)] - total[edges] if len(at) else np.zeros(0, np.uint64)), before


def sets(texts: list[bytes], n: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's set of n-word shingles in ascending order of hash; all words as one shingle if there are fewer."""
    for lo, hi in pieces(texts):
        words, before = word_hashes(texts[lo:hi])
        with np.errstate(over="ignore"):
            h = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3F) + words[k : k + len(h)]
            h = mix(h + np.uint64(n))
            for a, z in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
                if z - a >= n:
                    yield np.unique(h[a : z - n + 1])
                elif z > a:
                    short = np.uint64(z - a)
                    for w in words[a:z]:
                        short = short * np.uint64(0x100000001B3F) + w
                    yield mix(np.array([short], dtype=np.uint64) + np.uint64(z - a))
                else:
                    yield np.zeros(0, dtype=np.uint64)


def digest(found: np.ndarray) -> bytes:
    """16 bytes that stand for a set: equal sets, equal bytes."""
    with np.errstate(over="ignore"):
        a = np.uint64(len(found)) + np.add.reduce(mix(found + np.uint64(0x1234567)), dtype=np.uint64)
        b = np.add.reduce(mix(found ^ np.uint64(0xA5A5A5A5DEADBEEF)) * np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)
    return np.array([a, b], dtype=np.uint64).tobytes()
