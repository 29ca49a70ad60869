"""SentencePiece models of merge type: a score-ordered agenda of adjacent symbol pairs.

A text is its characters, each space written as the mark U+2581 and one mark before the first. Of
all adjacent pairs whose joint spelling is a piece, the one with the best score merges first, the
leftmost of equals, until none is left; what is no piece then is spelt in byte pieces.

No piece of such a vocabulary holds a mark behind another character, so no merge crosses the
beginning of a run of marks, and a text is cut there. Each distinct span is encoded once in a
worker: the agendas of all new spans of an Arrow batch are rows of one matrix, from which each
round pops the best pair of every row. What comes out is compared with the sentencepiece library in
the same batch; where they differed the library's ids would stand, and ``repaired`` counts them.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from . import kernels as K
from .bpe import CACHED, Spelling, mapped
from .spans import SpanNumbers

#: Fixed value: the character that stands for a space.
MARK = "▁"
_MARK = np.frombuffer(MARK.encode(), np.uint8)
#: Spans of more symbols have an agenda of their own, a heap.
WIDE = 64
#: Marks a symbol that was merged into the one before it.
GONE = np.int32(np.iinfo(np.int32).min)
#: Spans whose agendas are rows of one matrix.
ROWS = 1 << 14
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


class PieceBpe:
    """The codec of one model file.

    Only models that normalise nothing and mark the beginning are known, without pieces that the
    user defined or that are unused; others are refused.
    """

    def __init__(self, path: str, check: bool = True):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        n, t = spec.normalizer_spec, spec.trainer_spec
        if t.model_type != t.BPE or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or t.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: not a merge-type model without normalisation and with a mark before the text")
        kinds = [p.type for p in spec.pieces]
        if {USER_DEFINED, UNUSED} & {*kinds} or kinds.count(BYTE) != 256:
            raise ValueError(f"{path}: pieces of the user, unused pieces or no byte pieces")
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = np.array(kinds)
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError(f"{path}: a piece holds a mark behind another character")
        self.byte_ids = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)])
        # the place of each piece in the order of merging; equal scores share one
        score = np.array([p.score for p in spec.pieces], np.float32)
        self.place = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        self.none = np.int32(self.place.max() + 1)
        # symbols are ids of pieces; a character that is no piece is below zero
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[32] = self.symbol[ord(MARK)]
        pairs = sorted((self._symbol(p[:k]) << 32 | self._symbol(p[k:]), i) for p, i in self.id_of.items() for k in range(1, len(p)) if self._is_symbol(p[:k]) and self._is_symbol(p[k:]))
        self._key, self._piece = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self._joint = dict(pairs)
        spelt = {i: p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)}
        spelt |= {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)} | {i: b"" for i, k in enumerate(kinds) if k == CONTROL} | {i: t.unk_surface.encode() for i, k in enumerate(kinds) if k == UNKNOWN}
        self.spellings = Spelling(spelt)
        self.decimals = Spelling({i: b",%d" % i for i in range(len(kinds))})
        self.check, self.checked, self.repaired = check, 0, 0
        self.numbers = SpanNumbers(CACHED)
        self._forget()

    def _is_symbol(self, text: str) -> bool:
        return text in self.id_of or len(text) == 1

    def _symbol(self, text: str) -> int:
        return self.id_of[text] if text in self.id_of else int(self.symbol[ord(text)])

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols spells together, -1 where there is none."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self._key, key), self._key.size - 1)
        return np.where((self._key[at] == key) & (a >= 0) & (b >= 0), self._piece[at], -1).astype(np.int32)

    def _agendas(self, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Merge the rows of a matrix of symbols, each by its own agenda; merged away symbols become ``none``.

        ``due`` is the agenda: at each symbol the place of the piece that it makes with the next.
        """
        n, width = symbols.shape
        out = np.full_like(symbols, GONE)
        column = np.arange(width, dtype=np.int32)
        inside = column < length[:, None]
        out[inside] = symbols[inside]
        if width < 2:
            return out
        after = np.where(column + 1 < length[:, None], column + 1, width).astype(np.int32)
        before = np.broadcast_to(column - 1, (n, width)).copy()
        makes = np.full((n, width), -1, np.int32)
        pair = inside[:, 1:]
        makes[:, :-1][pair] = self._joined(symbols[:, :-1][pair], symbols[:, 1:][pair])
        due = np.where(makes >= 0, self.place[makes], self.none)
        row = np.arange(n)
        while row.size:
            at = due[row].argmin(1)
            go = due[row, at] < self.none
            row, at = row[go], at[go]
            piece, gone = makes[row, at], after[row, at]
            out[row, at] = piece
            out[row, gone] = GONE
            due[row, gone] = self.none
            beyond = after[row, gone]
            after[row, at] = beyond
            right = beyond < width
            due[row[~right], at[~right]] = self.none
            left = before[row, at] >= 0
            r, x, y = row[right], at[right], beyond[right]
            before[r, y] = x
            self._enter(out, makes, due, r, x, y)
            r, y = row[left], at[left]
            self._enter(out, makes, due, r, before[r, y], y)
        return out

    def _enter(self, symbols: np.ndarray, makes: np.ndarray, due: np.ndarray, row: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        found = self._joined(symbols[row, x], symbols[row, y])
        makes[row, x] = found
        due[row, x] = np.where(found >= 0, self.place[found], self.none)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one long span: the agenda is a heap, what has changed since is skipped."""
        token, n, joint, place = symbols, len(symbols), self._joint, self.place
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def enter(x: int, y: int) -> None:
            if token[x] >= 0 <= token[y] and (p := joint.get(token[x] << 32 | token[y])) is not None:
                heapq.heappush(heap, (int(place[p]), x, p, token[x], token[y]))

        for k in range(n - 1):
            enter(k, k + 1)
        dead = int(GONE)
        while heap:
            _, x, p, a, b = heapq.heappop(heap)
            y = after[x]
            if y < 0 or token[x] != a or token[y] != b:
                continue
            token[x], token[y] = p, dead
            after[x] = after[y]
            if after[x] >= 0:
                before[after[x]] = x
                enter(x, after[x])
            if before[x] >= 0:
                enter(before[x], x)
        return [t for t in token if t != dead]

    def encode_spans(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans, each with the space that begins it, one after the other; and how many each has."""
        size = np.fromiter(map(len, spans), np.int64, len(spans))
        symbols = self.symbol[np.frombuffer("".join(spans).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        ends = np.searchsorted(size[order], [4, 8, 12, 16, 24, 32, WIDE], side="right").tolist()
        count, parts = np.zeros(len(spans), np.int64), []
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            for k in range(lo, hi, ROWS):
                own = order[k : min(k + ROWS, hi)]
                column = np.arange(size[own[-1]])
                done = self._agendas(symbols[np.minimum(begin[own, None] + column, symbols.size - 1)], size[own])
                live = done != GONE
                count[own] = live.sum(1)
                parts.append((own, done[live]))
        for s in order[ends[-1] :].tolist():
            ids = np.array(self.merge_long(symbols[begin[s] : begin[s] + size[s]].tolist()), np.int32)
            count[s] = ids.size
            parts.append((np.array([s]), ids))
        at = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for own, ids in parts:
            flat[np.repeat(at[own] - (np.cumsum(count[own]) - count[own]), count[own]) + np.arange(ids.size)] = ids
        return self._spelt_in_bytes(flat, count)

    def _spelt_in_bytes(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(flat < 0)
        if not odd.size:
            return flat, count
        ids = [self.byte_ids[list(chr(-1 - c).encode("utf-8", "surrogatepass"))] for c in flat[odd].tolist()]
        times = np.ones(flat.size, np.int64)
        times[odd] = [len(x) for x in ids]
        owner = np.repeat(np.arange(count.size), count)
        out = np.repeat(flat, times)
        out[np.repeat(flat < 0, times)] = np.concatenate(ids)
        return out, np.bincount(np.repeat(owner, times), minlength=count.size)

    def checked_spans(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_spans``, compared with the library, which writes the first mark itself."""
        flat, count = self.encode_spans(spans)
        if not self.check or not spans:
            return flat, count
        # a line break before a space is no span's end, so each span is a text of its own
        said = self.library.encode([s[1:] for s in spans], num_threads=1)
        # alone, a mark is its own piece; the library has nothing for an empty text
        said = [x or [int(self.symbol[32])] if s == " " else x for s, x in zip(spans, said, strict=True)]
        want = np.fromiter(chain.from_iterable(said), np.int32)
        self.checked += len(spans)
        if not np.array_equal(want, flat):
            sizes = np.fromiter(map(len, said), np.int64, len(said))
            own = np.split(flat, np.cumsum(count)[:-1])
            self.repaired += sum(a.tolist() != b for a, b in zip(own, said, strict=True))
            return want, sizes
        return flat, count

    def _forget(self) -> None:
        self.flat, self.start = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.count = self.end = 0

    def _store(self, spans: list[bytes]) -> None:
        """Encode spans and keep their ids under the next numbers."""
        ids, count = self.checked_spans([s.decode("utf-8", "replace") for s in spans])
        while self.end + ids.size > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(spans) + 1 > self.start.size:
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.end : self.end + ids.size] = ids
        self.start[self.count : self.count + len(spans) + 1] = self.end + np.concatenate([[0], np.cumsum(count)])
        self.end += ids.size
        self.count += len(spans)

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column; null counts as empty."""
        for chunk in K.chunks(column):
            marked = _with_marks(chunk)
            space = marked.raw == 32
            # a span begins at a space that follows none; each text begins with one
            cut = space.copy()
            cut[1:] &= ~space[:-1]
            rows = marked.row[:-1]
            cut[rows[rows < marked.row[1:]]] = True
            begin = np.flatnonzero(cut)
            first = np.searchsorted(begin, marked.row)
            span, fresh, new = self.numbers.numbers(marked, begin, np.append(begin[1:], marked.raw.size)[: begin.size])
            if fresh < self.count:  # the numbers began anew
                self._forget()
            if new:
                self._store(new)
            at, size = self.start[span], self.start[span + 1] - self.start[span]
            total = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
            for k in range(chunk.n):
                yield ids[total[first[k]] : total[first[k + 1]]]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_column(pa.array([text], pa.string()))).tolist()

    def spelling(self, ids: np.ndarray) -> bytes:
        """What ids of an encoded text spell: the mark before the text is no space of it."""
        return self.spellings.join(ids)[1:]

    def decode(self, ids: list[int]) -> str:
        """What any ids spell. Only what comes first loses its mark; bytes that are no character are U+FFFD each."""
        out, run, first = [], b"", True
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += bytes([int(np.flatnonzero(self.byte_ids == i)[0])])
                continue
            if run:
                out.append(_characters(run))
                run, first = b"", False
            if i is None or self.kinds[i] == CONTROL:
                continue
            if self.kinds[i] == UNKNOWN:
                out.append(self.spellings.join(np.array([i])).decode())
            else:
                piece = self.pieces[i]
                out.append((piece[1:] if first and piece.startswith(MARK) else piece).replace(MARK, " "))
            first = False
        return "".join(out)


def _characters(run: bytes) -> str:
    out, k = [], 0
    while k < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[k : k + n].decode())
            except UnicodeDecodeError:
                continue
            k += n
            break
        else:
            out.append("�")
            k += 1
    return "".join(out)


def _with_marks(chunk: K.Chunk) -> K.Chunk:
    """The chunk with a space before each text that isn't empty; a mark in a text becomes a space."""
    raw, row = chunk.raw, chunk.row
    lead = np.flatnonzero(raw[:-2] == _MARK[0]) if raw.size > 2 else np.zeros(0, np.int64)
    lead = lead[(raw[lead + 1] == _MARK[1]) & (raw[lead + 2] == _MARK[2])]
    if lead.size:
        raw = raw.copy()
        raw[lead] = 32
        keep = np.ones(raw.size, bool)
        keep[lead + 1] = keep[lead + 2] = False
        row = np.concatenate([[0], np.cumsum(keep)])[row]
        raw = raw[keep]
    filled = np.flatnonzero(np.diff(row) > 0)
    before = np.zeros(row.size, np.int64)
    before[filled + 1] = 1
    return K.Chunk(chunk.first, np.insert(raw, row[filled], 32), row + np.cumsum(before))


@lru_cache(maxsize=2)
def loaded(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` for each row of ``docs``: the ids of its whole text, and the text that they decode to.

    A null text counts as empty and has no ids. Texts of any length are encoded whole. Repeated rows
    and null ids each get their row; an empty table gives no rows; other columns, of whatever names,
    are ignored.
    """

    def whole(codec, ids):
        return ids.tolist(), codec.spelling(ids).decode("utf-8", "replace")

    return mapped(docs, loaded, path, whole, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_documents``, with digests in place of the ids and the text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def digests(codec, ids):
        return ids.size, hashlib.sha256(codec.decimals.join(ids)[1:]).hexdigest(), hashlib.sha256(codec.spelling(ids)).hexdigest()

    return mapped(docs, loaded, path, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
