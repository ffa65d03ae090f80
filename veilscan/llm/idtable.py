"""A worker's bounded table from strings to runs of token ids, held in numpy buffers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

#: What a table holds at most: entries, and bytes of strings and ids together.
ENTRIES, BYTES = 600_000, 96 << 20


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class IdTable:
    """Strings to runs of ids. ``make(strings)`` works out what is missing, as ``(ids, lengths)`` in their order.

    When it is full the younger two thirds make room: what came first holds the common strings. Strings of one call
    are always all in the table, so a call may exceed the bounds by its own strings only.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], entries: int = ENTRIES, size: int = BYTES):
        self.make, self.entries, self.size = make, entries, size
        self.codes: dict[str, int] = {}
        self.starts, self.lengths, self.ids = np.zeros(1 << 12, "i8"), np.zeros(1 << 12, "i4"), np.zeros(1 << 14, "i4")
        self.used = self.characters = 0

    def _trim(self) -> None:
        kept, self.characters = len(self.codes) // 3, 0
        for number, string in enumerate(list(self.codes)):
            if number < kept and self.characters + 4 * self.used < self.size:
                self.characters += len(string)
            else:
                del self.codes[string]
        kept = len(self.codes)
        self.used = int(self.starts[kept - 1] + self.lengths[kept - 1]) if kept else 0
        if not kept:
            self.characters = 0
        self.ids = self.ids[: max(1 << 14, self.used)].copy()

    @staticmethod
    def _room(buffer: np.ndarray, wanted: int) -> np.ndarray:
        if wanted <= len(buffer):
            return buffer
        larger = np.zeros(max(wanted, len(buffer) + len(buffer) // 2), buffer.dtype)
        larger[: len(buffer)] = buffer
        return larger

    def _learn(self, strings: list[str]) -> None:
        ids, lengths = self.make(strings)
        first, before = len(self.codes), self.used
        self.codes.update(zip(strings, range(first, first + len(strings))))
        self.starts, self.lengths = (self._room(b, len(self.codes)) for b in (self.starts, self.lengths))
        self.ids = self._room(self.ids, before + len(ids))
        self.starts[first:len(self.codes)] = before + np.cumsum(lengths) - lengths
        self.lengths[first:len(self.codes)] = lengths
        self.ids[before:before + len(ids)] = ids
        self.used = before + len(ids)
        self.characters += sum(map(len, strings))

    def look_up(self, strings: list[str]) -> np.ndarray:
        """The code of every string, each of which is then in the table."""
        codes = np.fromiter(map(self.codes.get, strings, repeat(-1)), dtype="i4", count=len(strings))
        missing = np.flatnonzero(codes < 0).tolist()
        if not missing:
            return codes
        new = list({strings[i] for i in missing})
        if self.codes and (len(self.codes) + len(new) > self.entries or self.characters + 4 * self.used > self.size):
            # What was found may go as well, so all strings are looked up again.
            self._trim()
            new, missing = list(set(strings).difference(self.codes)), range(len(strings))
        if new:
            self._learn(new)
        codes[missing] = np.fromiter((self.codes[strings[i]] for i in missing), dtype="i4", count=len(missing))
        return codes

    def join(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: the runs of each list's strings joined; offsets have one entry more than lists."""
        sizes = np.fromiter(map(len, lists), dtype="i8", count=len(lists))
        codes = self.look_up(list(chain.from_iterable(lists)))
        lengths = self.lengths[codes].astype("i8")
        ids = self.ids[runs(self.starts[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.concatenate([[0], np.cumsum(sizes)])]
