"""Ids of words that were encoded before, so that a text is put together from them."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np


class IdCache(dict):
    """From a word to its number; the ids of all words lie end to end in one growing array."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit
        self.ids, self.used = np.empty(1 << 20, np.int32), 0
        self.at, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def add(self, word: bytes | str, found: list[int]) -> int:
        k = len(self)
        if k == len(self.at):
            self.at, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.size))
        while self.used + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.at[k], self.size[k] = self.used, len(found)
        self.ids[self.used : self.used + len(found)] = found
        self.used += len(found)
        self[word] = k
        return k

    def add_all(self, words: list, found: list[list[int]]) -> None:
        """Many new words at once."""
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.add_flat(words, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size)

    def add_flat(self, words: list, flat: np.ndarray, size: np.ndarray) -> None:
        """The same, with the ids of all words end to end and how many each has."""
        k = len(self)
        while k + len(words) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.size))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[k : k + len(words)] = self.used + np.cumsum(size) - size
        self.size[k : k + len(words)] = size
        self.used += len(flat)
        self.update(zip(words, range(k, k + len(words)), strict=True))

    def of(self, number: int) -> list[int]:
        return self.ids[self.at[number] : self.at[number] + self.size[number]].tolist()

    def trim(self) -> None:
        """Forget all words once there are too many."""
        if len(self) > self.limit:
            self.clear()
            self.used = 0

    def joined(self, words: Iterable, count: int) -> np.ndarray:
        """The ids of words in order."""
        return self.gathered(np.fromiter(map(self.__getitem__, words), np.int64, count))

    def gathered(self, which: np.ndarray) -> np.ndarray:
        size = self.size[which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.at[which] - ends + size, size) + np.arange(total)]
