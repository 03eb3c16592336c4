"""What recurring words stand for, made once for each distinct word of a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

KNOWN_WORDS = 600_000  # words that a task keeps


def places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of rows whose sizes add up to about ``most``; a larger row ends its run."""
    first = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most or i == len(sizes) - 1:
            yield first, i + 1
            first, total = i + 1, 0


class Memo:
    """``make`` gives for some distinct words: values (ids), where each word's values begin in them, how many it
    has, and any further columns with one entry for each word.

    Keeps up to ``KNOWN_WORDS`` words and starts anew beyond, so memory is bounded."""

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, ...]]):
        self.make = make
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.kept: tuple[np.ndarray, ...] = ()

    def slots_of(self, words: pa.Array) -> np.ndarray:
        """The slot of each of an array of words."""
        words = words.dictionary_encode()
        names = words.dictionary.to_pylist()
        slot = np.fromiter(map(self.slots.get, names, repeat(-1)), "i8", len(names))
        new = np.flatnonzero(slot < 0)
        if len(self.slots) + len(new) > KNOWN_WORDS:
            self.forget()
            new = np.arange(len(names))
        if len(new) or not self.kept:
            fresh = [names[i] for i in new.tolist()]
            slot[new] = np.arange(len(self.slots), len(self.slots) + len(new))
            values, begin, *rest = self.make(fresh)
            if self.kept:
                begin = begin + len(self.kept[0])
                self.kept = tuple(np.concatenate([a, b]) for a, b in zip(self.kept, (values, begin, *rest)))
            else:
                self.kept = (values, begin, *rest)
            self.slots.update(zip(fresh, slot[new].tolist()))
        return slot[words.indices.to_numpy()]

    def look_up(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every word of some texts one after the other, and how many words each text has."""
        words = pa.array(list(chain.from_iterable(texts)), pa.large_string())
        return self.slots_of(words), np.array([len(found) for found in texts], "i8")

    def values(self, slot: np.ndarray) -> np.ndarray:
        """The values of the words one after the other."""
        values, begin, size = self.kept[:3]
        return values[places(begin[slot], size[slot])]

    def sums(self, column: np.ndarray, slot: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The sum of a column of whole numbers over the words of each text."""
        return np.diff(np.concatenate([[0], np.cumsum(column[slot])])[np.concatenate([[0], np.cumsum(words)])])
