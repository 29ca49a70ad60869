"""Vectorised text kernels over Arrow batches: words, lines, shingles and their 64-bit hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. In UTF-8 those bytes never occur
inside a longer character, so the work is done on bytes. A span's bytes go through a non-linear
mix eight at a time (longer spans through BLAKE2b), so no structure of a text makes two words
collide: different spans share a hash with a probability near 2**-64. Where a wrong answer would
follow, ``equal_spans`` compares the bytes themselves.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled at once; a longer single text is a chunk of its own.
CHUNK = 1 << 20
SHINGLE = 5
_SLOT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix_one(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=U))[0])


def release() -> None:
    """Give freed memory back to the system; a reused worker would keep it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function over batches that gives its memory back when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run):
    """A function over the rows of a group that gives its memory back."""

    def wrapped(key, table):
        try:
            return run(key, table)
        finally:
            release()

    return wrapped


#: Spans of more bytes are hashed and compared whole.
LONG = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the last byte."""
    padded = np.zeros(raw.size + 16, np.uint8)
    padded[: raw.size] = raw
    return np.ndarray((raw.size + 8,), "<u8", padded, strides=(1,))


def span_hashes(raw: np.ndarray, view: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``view`` is ``lanes(raw)``."""
    size = (end - start).astype(np.int64)
    h = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while live.size:
        rest = size[live] - at
        h[live] = mix(h[live] ^ (view[start[live] + at] & _MASK[np.minimum(rest, 8)]))
        live, at = live[rest > 8], at + 8
    whole = memoryview(raw)
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(whole[int(start[k]) : int(end[k])], digest_size=8).digest(), "little")
    return h


def equal_spans(view: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each span of one run of bytes equals its span of another, byte by byte."""
    same = size == length
    live, at = np.flatnonzero(same & (size > 0) & (size <= 4096)), 0
    while live.size:
        rest = size[live] - at
        mask = _MASK[np.minimum(rest, 8)]
        equal = (view[start[live] + at] & mask) == (other[begin[live] + at] & mask)
        same[live[~equal]] = False
        live, at = live[equal & (rest > 8)], at + 8
    for k in np.flatnonzero(same & (size > 4096)).tolist():
        n = int(size[k]) // 8
        a, b = view[int(start[k]) :: 8][:n], other[int(begin[k]) :: 8][:n]
        tail = int(size[k]) - 8
        same[k] = bool((a == b).all() and view[int(start[k]) + tail] == other[int(begin[k]) + tail])
    return same


@dataclass
class Chunk:
    """Some rows of a batch: ``raw`` holds their bytes, row i at ``row[i]:row[i + 1]``."""

    first: int
    raw: np.ndarray
    row: np.ndarray
    _lanes: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.row) - 1

    def lower(self) -> Chunk:
        raw = self.raw + np.where((self.raw >= 65) & (self.raw <= 90), 32, 0).astype(np.uint8)
        return Chunk(self.first, raw, self.row)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each span of bytes."""
        return span_hashes(self.raw, self.lanes, start, end)

    @property
    def lanes(self) -> np.ndarray:
        if self._lanes is None:
            self._lanes = lanes(self.raw)
        return self._lanes

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the index of the first word of each row (n + 1 entries)."""
        return self.spans(~_IS_SPACE[self.raw])

    def spans(self, black: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each run of marked bytes within a row, and the index of each row's first."""
        if not self.raw.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        before = np.empty_like(black)
        before[0], before[1:] = False, black[:-1]
        inner = self.row[:-1][self.row[:-1] < self.raw.size]
        before[inner] = False
        start = np.flatnonzero(black & ~before)
        after = np.empty_like(black)
        after[-1], after[:-1] = False, black[1:]
        last = self.row[1:] - 1
        after[last[last >= 0]] = False
        end = np.flatnonzero(black & ~after) + 1
        return start, end, np.searchsorted(start, self.row)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each \\n-separated line, and the index of the first line of each row."""
        cut = np.flatnonzero(self.raw == 10)
        owner = np.searchsorted(self.row, cut, side="right") - 1
        start = np.concatenate([self.row[:-1], cut + 1])
        end = np.concatenate([cut, self.row[1:]])
        order = np.lexsort((start, np.concatenate([np.arange(self.n), owner])))
        count = 1 + np.bincount(owner, minlength=self.n)[: self.n] if self.n else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        # a line ends at the next line's start - 1, or at the row's end
        start = start[order]
        stop = np.empty_like(start)
        if start.size:
            stop[:-1] = start[1:] - 1
            stop[first[1:] - 1] = self.row[1:]
        return start, stop, first

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value for each byte over each row."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.row[1:]] - total[self.row[:-1]]

    def text(self, i: int) -> str:
        return self.raw[self.row[i] : self.row[i + 1]].tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    """The rows of a string column in pieces of about ``size`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield Chunk(i, raw[at[i] : at[j]], (at[i : j + 1] - at[i]).astype(np.int64))
        i = j


def shingles(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of five words in each row, in order, and the index of each row's first.

    A row of one to four words has one shingle, its whole sequence; a row without words has none.
    """
    count = np.diff(first)
    windows = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(windows)])
    out = np.empty(begin[-1], dtype=U)
    if word.size >= SHINGLE:
        n = word.size - SHINGLE + 1
        total = word[:n] * _SLOT[0]
        for k in range(1, SHINGLE):
            total += word[k : k + n] * _SLOT[k]
        total = mix(total)
        long = np.flatnonzero(count >= SHINGLE)
        size = windows[long]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin[long], size) + within] = total[np.repeat(first[long], size) + within]
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        w = word[first[i] : first[i + 1]]
        out[begin[i]] = mix_one(int((w * _SLOT[: w.size]).sum(dtype=U)) + 0x1D8E4E27C47D124F * w.size)
    return out, begin


def shingle_sets(chunk: Chunk) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row: the sorted distinct shingles of its lower-cased words; and a 63-bit id of that set."""
    low = chunk.lower()
    start, end, first = low.words()
    all_of, begin = shingles(low.hashes(start, end), first)
    sets, ids = [], np.empty(chunk.n, dtype=np.int64)
    for i in range(chunk.n):
        s = np.unique(all_of[begin[i] : begin[i + 1]])
        sets.append(s)
        ids[i] = mix_one(int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)) + s.size * 0x2127599BF4325C37) >> 1
    return sets, ids
