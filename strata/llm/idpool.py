"""Encoding of many byte spans with each distinct span encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class IdPool:
    """Ids of the distinct spans met so far, found by a 64-bit hash and checked by a second one.

    Spans that agree in the first hash only are encoded by themselves.  The pool is emptied when it has ``limit`` spans, so its memory is bounded;
    a span met again after that is encoded again, with the same ids.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)  # sorted
        self.checks = np.empty(0, dtype=np.uint64)  # second hash of each key
        self.slots = np.empty(0, dtype=np.int32)  # where each key's ids are
        self.offsets = np.zeros(1 << 12, dtype=np.int64)
        self.ids = np.zeros(1 << 14, dtype=np.int32)
        self.used = 0

    def _add(self, keys: np.ndarray, checks: np.ndarray, spans: list[bytes]) -> None:
        found = self.encode(spans)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        n, more = len(self.keys), int(sizes.sum())
        while len(self.offsets) < n + len(found) + 1:
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while len(self.ids) < self.used + more:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.offsets[n + 1 : n + 1 + len(found)] = self.used + np.cumsum(sizes)
        self.ids[self.used : self.used + more] = np.fromiter((i for x in found for i in x), dtype=np.int32, count=more)
        self.used += more
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.checks = np.insert(self.checks, place, checks)
        self.slots = np.insert(self.slots, place, np.arange(n, n + len(found), dtype=np.int32))

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """A flag for each of the sorted keys."""
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        return known

    def ids_of(self, hashes: np.ndarray, checks: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans in their order, number of ids of each span)."""
        if not len(hashes):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.limit:
            self._clear()
        new = np.flatnonzero(~self._known(distinct))
        raw = data.tobytes() if len(new) else b""
        if len(new):
            at = first[new]
            self._add(distinct[new], checks[at], [raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())])
        found = np.searchsorted(self.keys, distinct)[place]
        if (self.checks[found] != checks).any():
            raw = data.tobytes()
            lists = self.encode([raw[s:e] for s, e in zip(start.tolist(), end.tolist())])
            return np.fromiter((i for x in lists for i in x), dtype=np.int32), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        slot = self.slots[found]
        begin, count = self.offsets[slot], self.offsets[slot + 1] - self.offsets[slot]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.ids[np.repeat(begin, count) + step], count
