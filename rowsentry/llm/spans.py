"""Consecutive numbers for distinct spans of bytes, looked up for a whole chunk at once."""

from __future__ import annotations

from itertools import repeat

import numpy as np

from . import kernels as K


class SpanNumbers:
    """Numbers spans as they are first met, up to ``limit`` of them; then it begins anew.

    Spans are found by hash and compared byte by byte with what was numbered, so that spans that
    share a hash get numbers of their own.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.odd: dict[bytes, int] = {}
        self.count = self.end = 0
        self.flat = np.zeros(1 << 16, np.uint8)
        self.at = np.zeros(1 << 16, np.int64)
        self.view: np.ndarray | None = None

    def _add(self, spans: list[bytes]) -> None:
        size = sum(map(len, spans))
        while self.end + size > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(spans) + 1 > self.at.size:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.end : self.end + size] = np.frombuffer(b"".join(spans), np.uint8)
        self.at[self.count + 1 : self.count + len(spans) + 1] = self.end + np.cumsum(list(map(len, spans)), dtype=np.int64)
        self.count, self.end = self.count + len(spans), self.end + size
        self.view = None

    def numbers(self, chunk: K.Chunk, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int, list[bytes]]:
        """The number of each span of the chunk, the number from which they are new, and the new spans in order."""
        kind, where, back = np.unique(chunk.hashes(start, end), return_index=True, return_inverse=True)
        keys = kind.tolist()
        place = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if new.size and self.count + new.size > self.limit:
            self.clear()
            place[:], new = -1, np.arange(len(keys))
        raw, fresh = memoryview(chunk.raw), self.count
        added = [bytes(raw[start[where[k]] : end[where[k]]]) for k in new.tolist()]
        place[new] = fresh + np.arange(new.size)
        self.known.update(zip(kind[new].tolist(), place[new].tolist(), strict=True))
        if added:
            self._add(added)
        if self.view is None:
            self.view = K.lanes(self.flat[: self.end])
        out = place[back]
        same = K.equal_spans(chunk.lanes, start, end - start, self.view, self.at[out], self.at[out + 1] - self.at[out])
        for k in np.flatnonzero(~same).tolist():  # spans that share the hash of another one
            span = bytes(raw[start[k] : end[k]])
            if span not in self.odd:
                self.odd[span] = self.count
                self._add([span])
                added.append(span)
            out[k] = self.odd[span]
        return out, fresh, added
