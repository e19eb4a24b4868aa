"""Ids of words a worker has seen, in flat arrays, within a bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain, repeat

import numpy as np

#: Words remembered; about 200 bytes each, beside what ``HELD`` allows.
CAPACITY = 300_000
#: Ids remembered: words of any length share this room.
HELD = 1 << 23


def gathered(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after the other."""
    before = np.cumsum(length) - length
    return flat[np.repeat(begin - before, length) + np.arange(int(length.sum()))]


class WordMemory:
    """Remembers what ``learn`` says of a word: its ids and ``facts`` numbers.

    A full memory keeps the words used most and forgets the rest; a text of more different words than fit makes room
    for itself. What is remembered never changes a result.
    """

    def __init__(self, learn: Callable[[list[str]], Iterable[tuple]], facts: int = 0, capacity: int = CAPACITY) -> None:
        self.learn, self.n_facts, self.capacity = learn, facts, capacity
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self._room(capacity)

    def _room(self, size: int) -> None:
        self.begin, self.length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.uses, self.facts = np.zeros(size, np.int64), np.zeros((self.n_facts, size))

    def _forget(self, room: int) -> None:
        """Keep up to half the words, those used more than once and most often."""
        uses, n = self.uses[: len(self.known)], len(self.known)
        often = np.argsort(-uses, kind="stable")[: self.capacity // 2]
        often = often[np.cumsum(self.length[often]) <= HELD // 2]
        keep = np.sort(often[uses[often] > 1])
        begin, length, uses, facts = self.begin[keep], self.length[keep], self.uses[keep], self.facts[:, keep]
        words = list(self.known)
        self.known = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.flat = gathered(self.flat, begin, length)
        self.used = len(self.flat)
        self._room(max(self.capacity, len(keep) + room))
        m = len(keep)
        self.length[:m], self.uses[:m], self.facts[:, :m] = length, uses, facts
        self.begin[:m] = np.cumsum(length) - length

    def rest(self, words: int = 50_000) -> None:
        """Between tasks keep only the words used most: the worker may serve other stages meanwhile."""
        full, self.capacity = self.capacity, 2 * words
        if len(self.known) > words or self.used > HELD // 2:
            self._forget(0)
        self.capacity = full

    def _found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The words by number, -1 where unknown; the places of these, and each of them once."""
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(number < 0)
        return number, missing, list(dict.fromkeys([words[i] for i in missing.tolist()]))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words by number, good until the next call."""
        number, missing, new = self._found(words)
        if new and (len(self.known) + len(new) > len(self.begin) or self.used > HELD):
            self._forget(len(set(words)))
            number, missing, new = self._found(words)
        if new:
            known, learnt = self.known, list(self.learn(new))
            k = len(known)
            size = np.fromiter((len(ids) for ids, *_ in learnt), np.int64, len(new))
            end = self.used + np.cumsum(size)
            while end[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), 1 << 16), np.uint32)])
            self.flat[self.used : end[-1]] = np.fromiter(chain.from_iterable([ids for ids, *_ in learnt]), np.uint32, int(size.sum()))
            self.begin[k : k + len(new)], self.length[k : k + len(new)] = end - size, size
            if self.n_facts:
                self.facts[:, k : k + len(new)] = np.array([facts for _, *facts in learnt]).T
            known.update(zip(new, range(k, k + len(new))))
            self.used = int(end[-1])
            number[missing] = [known[words[i]] for i in missing.tolist()]
        np.add.at(self.uses, number, 1)
        return number

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words and how many each word has."""
        length = self.length[number]
        return gathered(self.flat, self.begin[number], length), length
