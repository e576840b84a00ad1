"""Encodings of distinct strings kept for reuse, and put together for many texts at once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np


def packed(strings: list[str], lists: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lists of ids as one array and their lengths."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return strings, np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum())), n


def pick(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` from ``begin``, ``n`` long, one after another."""
    upto = np.cumsum(n)
    return flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - (upto - n), n)]


class _Codes(dict):
    """Numbers strings as they are met; ``fresh`` are those without ids yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, string: str) -> int:
        n = self[string] = len(self)
        self.fresh.append(string)
        return n


class Memo:
    """From a string to its ids.

    ``encode`` takes new strings and returns them in an order of its own with all their ids
    and how many each has. Beyond ``most`` strings a new generation begins with the next
    texts, which takes over what is still used from the one before; memory stays bounded by
    ``most`` and the texts given at once, and results don't depend on it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], most: int = 250_000):
        self.encode, self.most = encode, most
        self._begin()
        self.old = ({}, self.flat, self.begin, self.n)

    def _begin(self):
        self.code = _Codes()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.begin, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        fresh, self.code.fresh = self.code.fresh, []
        if not fresh:
            return
        more = np.zeros(len(fresh), np.int64)
        self.begin, self.n = np.concatenate([self.begin, more]), np.concatenate([self.n, more])
        code, flat, begin, n = self.old
        found = list(map(code.get, fresh))
        kept = [s for s, i in zip(fresh, found, strict=True) if i is not None]
        if kept:
            at = np.fromiter((i for i in found if i is not None), np.int64, len(kept))
            self._add(kept, pick(flat, begin[at], n[at]), n[at])
            fresh = [s for s, i in zip(fresh, found, strict=True) if i is None]
        if fresh:
            self._add(*self.encode(fresh))

    def _add(self, strings: list[str], more: np.ndarray, n: np.ndarray) -> None:
        if self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(more), len(self.flat)), np.int32)])
        self.flat[self.used : self.used + len(more)] = more
        at = np.fromiter(map(self.code.__getitem__, strings), np.int64, len(strings))
        self.begin[at], self.n[at] = self.used + np.cumsum(n) - n, n
        self.used += len(more)

    def each(self, strings: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each of these distinct strings are: the array that holds them, their begin in it, and how many."""
        if len(self.code) > self.most:
            self.old = (self.code, self.flat, self.begin, self.n)
            self._begin()
        at, n = list(map(self.code.get, strings)), len(self.code)
        self.code.fresh = [s for s, i in zip(strings, at, strict=True) if i is None]
        self.code.update(zip(self.code.fresh, range(n, n + len(self.code.fresh)), strict=True))
        fresh = iter(range(n, n + len(self.code.fresh)))
        code = np.fromiter([next(fresh) if i is None else i for i in at], np.int64, len(at))
        self._learn()
        return self.flat, self.begin[code], self.n[code]

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as lists of strings, one after another; and how many each text has."""
        if len(self.code) > self.most:
            self.old = (self.code, self.flat, self.begin, self.n)
            self._begin()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.fromiter(map(self.code.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        self._learn()
        n = self.n[code]
        total = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(sizes)))]
        return pick(self.flat, self.begin[code], n), np.diff(total)
