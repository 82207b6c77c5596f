"""Texts as sequences of marked words that are each encoded once.

``Lexicon`` numbers the distinct words that a worker meets and keeps the token ids of each in one flat array; a document is
then an array of word numbers, and its ids are gathered by indexing. Words are cut where no token can cross: before a
single blank and before a line end. A worker forgets its lexicon when it holds ``MOST_WORDS`` words or ``MOST_CHARS``
characters; words met again are encoded again, so nothing is lost.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np

MOST_WORDS = 300_000
MOST_CHARS = 16_000_000
_PART = 120_000
_PART_CHARS = 4_000_000


class Lexicon(dict):
    """word -> number; ``encode`` gives the ids of a list of new words."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        super().__init__()
        self._encode = encode
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self._new: list[str] = []
        self._chars = 0
        self._ids, self._start, self._length = array("i"), array("q"), array("i")

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self._new.append(word)
        self._chars += len(word)
        return k

    def _learn(self) -> None:
        for ids in self._encode(self._new):
            self._start.append(len(self._ids))
            self._length.append(len(ids))
            self._ids.extend(ids)
        self._new = []

    def documents(self, texts: list[str | None], units: Callable[[str], list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first, ids, ends): the ids of texts[first : first + len(ends)] in a row, and where each text's end. Null: none."""
        first, numbers, counts, size, chars = 0, [], [], 0, 0
        look = self.__getitem__
        for i, text in enumerate(texts):
            words = units(text) if text else []
            numbers.append(np.fromiter(map(look, words), np.int32, len(words)))
            counts.append(len(words))
            size += len(words)
            chars += len(text or "")
            if size > _PART or chars > _PART_CHARS or i == len(texts) - 1:
                yield first, *self._gather(np.concatenate(numbers), np.array(counts))
                first, numbers, counts, size, chars = i + 1, [], [], 0, 0
                if len(self) > MOST_WORDS or self._chars > MOST_CHARS:
                    self._reset()

    def _gather(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._learn()
        length = np.frombuffer(self._length, np.int32)[numbers] if len(numbers) else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        if not len(self._ids):
            return np.zeros(0, np.int32), ends[np.cumsum(counts)]
        start = np.frombuffer(self._start, np.int64)[numbers]
        ids = np.frombuffer(self._ids, np.int32)[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
        return ids, ends[np.cumsum(counts)]


def plain_units(text: str) -> list[str] | None:
    """Words parted by single blanks and line ends: "x" stands for " x", "\\nx" for itself. None if the layout is richer."""
    words = text.replace("\n", " \n").split(" ")
    if len(words) != len(text.split()) or "\t" in text or "\r" in text or "\0" in text:
        return None
    return words


def literal(word: str) -> str:
    """What the key of a word stands for."""
    return word[1:] if word[0] == "\0" else word if word[0] == "\n" else " " + word
