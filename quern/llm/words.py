"""Split texts into units whose tokenization doesn't depend on what surrounds them.

Byte-level tokenizers first cut a text by a pattern and merge bytes within each match only.
Where single spaces and single line feeds stand between words, the pattern's matches never
reach across " word" or a line feed. Such units repeat a lot, so that each is tokenized once.
A text with any other white space is cut by the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from string import punctuation

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)
#: White space other than spaces and line feeds, and NUL, which marks the cuts below.
_OTHER = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Units that one worker remembers: a bound on its memory (about 150 bytes each), without effect on results.
CACHE_UNITS = 300_000


def spaced(text: str) -> bool:
    """Whether a text that isn't empty has only single spaces and single line feeds, and these between words."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or _OTHER.search(text))


def cut(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct units, the texts' units as places in that list, how many units each text has) of texts that are null, empty or spaced.

    A unit is a string that a byte-level tokenizer may take by itself: a space opens a new one; a line feed is one
    of its own, and the next word follows without a space. Texts are cut as bytes, all at once.
    """
    column = pa.array(texts, pa.large_string())
    offsets, data = column.buffers()[1:]
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1)
    raw = np.frombuffer(data, np.uint8, int(bounds[-1])) if data is not None else np.zeros(0, np.uint8)
    if not len(raw):
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    feed = raw == 10
    opens = feed | (raw == 32)
    opens[1:] |= feed[:-1]
    opens[bounds[:-1][bounds[:-1] < len(raw)]] = True
    begin = np.flatnonzero(opens)
    every = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(raw))), data).dictionary_encode()
    return every.dictionary.to_numpy(zero_copy_only=False).tolist(), every.indices.to_numpy(), np.diff(np.searchsorted(begin, bounds))


def batches(sizes: list[int], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters, or one text: bounds what is held for a batch."""
    lo = 0
    while lo < len(sizes):
        hi, total = lo, 0
        while hi < len(sizes) and (hi == lo or total + sizes[hi] < most):
            total += sizes[hi]
            hi += 1
        yield lo, hi
        lo = hi


class UnitCache:
    """Token ids of texts, by way of the ids of their units.

    learn(units) gives the ids of each of some new units as bytes of `kind`. A dictionary has a number
    for each known unit, and arrays by that number where its ids begin and how many they are, so that
    the ids of many texts are gathered at once. From `most` units on, those that were met again stay,
    at most half as many, and the others go. Texts with one of `apart` (special tokens) are learned whole, each time.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], kind: np.dtype | str = "<u4", most: int = CACHE_UNITS, apart: tuple[str, ...] = ()):
        self.learn, self.kind, self.most, self.apart = learn, np.dtype(kind), most, apart
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.begin, self.size, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, self.kind)
        self.met = np.zeros(1 << 12, np.int32)
        self.used = 0

    def _shrink(self) -> None:
        """Keeps the units that were met most often, at most half of what the bound allows."""
        n = len(self.number)
        order = np.argsort(-self.met[:n], kind="stable")[: self.most // 2]
        kept = np.sort(order[self.met[order] > 1])
        names = list(self.number)  # in the order of their numbers
        ids, met, size = self._gather(kept)[0], self.met[kept] // 2, self.size[kept]
        names = [names[k] for k in kept.tolist()]
        self._clear()
        self._store(names, ids, size)
        self.met[: len(names)] = met

    def _store(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        have, need = len(self.number), len(self.number) + len(new)
        for name, least in (("begin", need), ("size", need), ("met", need), ("flat", self.used + len(ids))):
            old = getattr(self, name)
            if len(old) < least:
                setattr(self, name, np.concatenate([old, np.zeros(max(least, 2 * len(old)) - len(old), old.dtype)]))
        self.begin[have:need] = self.used + np.cumsum(sizes) - sizes
        self.size[have:need] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.number.update(zip(new, range(have, need), strict=True))

    def _add(self, new: list[str]) -> None:
        """Learns new units. The pattern always cuts between a letter and marks, and never within marks: a word that ends in marks is put together."""
        plain: dict[str, None] = {}
        ended: list[str] = []
        halves: list[str] = []
        for u in new:
            if u[-1] in punctuation and (word := u.rstrip(punctuation)) and word[-1].isalpha():
                ended.append(u)
                halves += (word, u[len(word) :])
            else:
                plain[u] = None
        plain.update(dict.fromkeys(halves))
        plain = [u for u in plain if u not in self.number]
        parts = self.learn(plain)
        self._store(plain, np.frombuffer(b"".join(parts), dtype=self.kind), np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize)
        if ended:
            at = np.fromiter(map(self.number.__getitem__, halves), np.int64, len(halves))
            self._store(ended, self._gather(at)[0], self.size[at].reshape(-1, 2).sum(1))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of units by number, one after the other; where each unit's end)."""
        size = self.size[at]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.begin[at] - (end - size), size) + np.arange(end[-1] if len(end) else 0)], end

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        odd = [k for k, t in enumerate(texts) if t and any(a in t for a in self.apart)] if self.apart else []
        if odd:
            whole = dict(zip(odd, self.learn([texts[k] for k in odd]), strict=True))
            out = self.ids([None if k in whole else t for k, t in enumerate(texts)])
            return [np.frombuffer(whole[k], dtype=self.kind) if k in whole else found for k, found in enumerate(out)]
        out: list[np.ndarray] = []
        for lo, hi in batches([len(t or "") for t in texts]):
            out += self._ids(texts[lo:hi])
        return out

    def _numbers(self, names: list[str]) -> np.ndarray:
        """Numbers of distinct units; new ones are learned."""
        at = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [names[k] for k in missing]
            self._add(new)
            at[missing] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        return at

    def _ids(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > self.most:
            self._shrink()
        odd = {k: PATTERN.findall(t) for k, t in enumerate(texts) if t and not spaced(t)}
        names, place, sizes = cut([None if k in odd else t for k, t in enumerate(texts)])
        out = self._joined(names, place, sizes)
        if odd:
            every = list(chain.from_iterable(odd.values()))
            spot = {u: k for k, u in enumerate(dict.fromkeys(every))}
            place = np.fromiter(map(spot.__getitem__, every), np.int64, len(every))
            found = self._joined(list(spot), place, np.fromiter(map(len, odd.values()), np.int64, len(odd)))
            for k, ids in zip(odd, found, strict=True):
                out[k] = ids
        return out

    def _joined(self, names: list[str], place: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Ids of texts whose units are places among distinct names."""
        number = self._numbers(names)
        self.met[number] += np.bincount(place, minlength=len(names)).astype(np.int32)
        flat, end = self._gather(number[place])
        return np.split(flat, np.r_[0, end][np.cumsum(sizes)][:-1]) if len(sizes) else []
