"""Words to numbers, many texts at once: each distinct word is described once and then looked up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

#: Characters of text whose words are held at once.
STRIDE_CHARS = 2_000_000


def strides(sizes: list[int], most: int = STRIDE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together; a longer text is a range of its own."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class WordTable(dict):
    """ids() numbers words; table holds describe(words)'s rows for them. Beyond keep words it starts anew,
    between calls only, so ids hold until the next call."""

    def __init__(self, describe: Callable[[list], np.ndarray], keep: int = 400_000):
        super().__init__()
        self.describe, self.keep = describe, keep
        self._fresh: list = []
        self._rows: np.ndarray | None = None
        self._used = 0

    def __missing__(self, word: str | bytes) -> int:
        self[word] = k = len(self)
        self._fresh.append(word)
        return k

    def ids(self, words: list[list]) -> np.ndarray:
        if len(self) > self.keep:
            self.clear()
            self._used = 0
        n = sum(map(len, words))
        found = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=n)
        if self._fresh:
            rows = self.describe(self._fresh)
            need = self._used + len(rows)
            if self._rows is None or len(self._rows) < need:
                grown = np.empty((max(need, 2 * self._used), *rows.shape[1:]), dtype=rows.dtype)
                if self._used:
                    grown[: self._used] = self._rows[: self._used]
                self._rows = grown
            self._rows[self._used : need] = rows
            self._used = need
            self._fresh = []
        return found

    @property
    def table(self) -> np.ndarray:
        return self._rows[: self._used]
