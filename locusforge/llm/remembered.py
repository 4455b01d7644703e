"""Token ids of texts cut into pieces, each distinct piece encoded once per worker."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

# Pieces remembered in a worker before the memory is emptied.
MAX_REMEMBERED = 500_000


class Remembered:
    """Looks the ids of pieces up; ``encode`` is asked for the new ones.

    ``encode(pieces)`` returns how many ids each piece has and all ids in a
    row. Ids are kept in flat arrays, so a piece costs little more than its key.
    ``forget`` empties the memory, which happens by itself beyond ``most`` pieces.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int | None = None):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes = np.empty(0, dtype=np.int32)
        self.starts = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int32)

    def lookup(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the place where each text's ids end."""
        if len(self.number) > (self.most or MAX_REMEMBERED):
            self.forget()
        counts = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        words = list(chain.from_iterable(cut))
        pieces = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(pieces < 0).tolist()
        if missing:
            new = list(dict.fromkeys(words[i] for i in missing))
            sizes, ids = self.encode(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.sizes = np.concatenate((self.sizes, sizes.astype(np.int32)))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
            pieces[missing] = [self.number[words[i]] for i in missing]
        sizes = self.sizes[pieces].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.starts[pieces] - before, sizes) + np.arange(int(sizes.sum()))]
        return ids, np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
