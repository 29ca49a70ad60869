"""Byte-level BPE by speculation: greedy longest match proposes, pair checks verify, merging repairs.

A token sequence is the BPE encoding of its bytes exactly if each adjacent pair of tokens is what
merging would make of that pair's bytes. So a word's greedy proposal is right if all its pairs are
compatible; the pairs of all new words of a batch are checked at once, and only words with a
failing pair are merged rank by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .spans import SpanNumbers
from .store import small_batches

#: The white space and the word pattern of byte-level pre-tokenisation.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_SPACES = regex.compile(rf"[{SPACE}][{SPACE}]")
#: Cached words and pieces of a worker; a full cache is emptied.
CACHED = 700_000
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: The white space beyond ASCII as its UTF-8 bytes, and the bytes that these begin with.
_WIDE = np.array([int.from_bytes(c.encode().ljust(3, b"\0")) for c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))])
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Texts encoded together.
STEP = 1024


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones as themselves, the rest from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class SpeculativeBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        as_bytes = lambda t: bytes(letters[c] for c in t)
        ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # tokens by rank: the single bytes, then the merges in order
        self.order = [bytes([b]) for b in range(256)]
        self.rank = {t: k for k, t in enumerate(self.order)}
        self.left, self.right = list(range(256)), list(range(256))
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            x, y = self.rank[as_bytes(a)], self.rank[as_bytes(b)]
            merged = self.order[x] + self.order[y]
            if merged not in self.rank:
                self.rank[merged] = len(self.order)
                self.order.append(merged)
                self.left.append(x)
                self.right.append(y)
            self.pairs.setdefault((x, y), self.rank[merged])
        self.id_of = np.array([ids[t] for t in self.order], np.int64)
        self.left, self.right = np.array(self.left), np.array(self.right)
        key = np.array([x << 32 | y for x, y in self.pairs], np.int64)
        by = np.argsort(key)
        self._key, self._merged = key[by], np.array(list(self.pairs.values()), np.int64)[by]
        self.longest = max(map(len, self.order))
        self.bytes_of = {int(i): t for i, t in zip(self.id_of, self.order, strict=True)} | {i: s.encode() for s, i in self.specials.items()}
        self.decimals = Spelling({i: b",%d" % i for i in self.bytes_of})
        self.spellings = Spelling(self.bytes_of)
        self.numbers = SpanNumbers(CACHED)
        self._forget()
        self._words: dict[str, tuple[int, ...]] = {}
        self._whole: dict[int, bool] = {}
        self.failed = self.proposed = 0

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a merge makes of each pair; a number above all others where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._key, key), self._key.size - 1)
        return np.where(self._key[at] == key, self._merged[at], len(self.order) + 1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens a and b gives just these two tokens, for all pairs at once.

        Walks back through the merges of both tokens along their common edge, latest first: no pair
        met there may merge earlier than the step that removes it.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(a.size, bool)
        limit = np.full(a.size, len(self.order) + 1)
        live = np.arange(a.size)
        while live.size:
            x, y, most = a[live], b[live], limit[live]
            bad = self._merge_of(x, y) < most
            ok[live[bad]] = False
            go = ~bad
            live, x, y = live[go], x[go], y[go]
            # undo the later of the two; a single byte can't be undone, then the other goes
            split_left = (x > y) & (x >= 256) | (y < 256) & (x >= 256)
            split_right = ~split_left & (y >= 256)
            limit[live[split_left]] = x[split_left]
            a[live[split_left]] = self.right[x[split_left]]
            limit[live[split_right]] = y[split_right] + 1
            b[live[split_right]] = self.left[y[split_right]]
            live = live[split_left | split_right]
        return ok

    def propose(self, word: bytes) -> list[int]:
        out, at, rank, n = [], 0, self.rank, len(word)
        while at < n:
            end = min(n, at + self.longest)
            while word[at:end] not in rank:
                end -= 1
            out.append(rank[word[at:end]])
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact encoding: merge the earliest-ranked adjacent pair, leftmost first, until none is left.

        Long words use a heap of pairs over a linked list, which takes n log n.
        """
        token = list(word)
        if len(token) <= 40:
            return self._merge_short(token)
        after = [*range(1, len(token)), -1]
        before = [-1, *range(len(token) - 1)]
        pairs, heap = self.pairs, []
        for k in range(len(token) - 1):
            if (m := pairs.get((token[k], token[k + 1]))) is not None:
                heap.append((m, k, token[k], token[k + 1]))
        heapq.heapify(heap)
        while heap:
            m, k, x, y = heapq.heappop(heap)
            n = after[k]
            if token[k] != x or n < 0 or token[n] != y:
                continue
            token[k], token[n] = m, -1
            after[k] = after[n]
            if after[k] >= 0:
                before[after[k]] = k
                if (z := pairs.get((m, token[after[k]]))) is not None:
                    heapq.heappush(heap, (z, k, m, token[after[k]]))
            if (p := before[k]) >= 0 and (z := pairs.get((token[p], m))) is not None:
                heapq.heappush(heap, (z, p, token[p], m))
        return [t for t in token if t >= 0]

    def _merge_short(self, token: list[int]) -> list[int]:
        get, none = self.pairs.get, len(self.order) + 1
        ranks = [get(p, none) for p in zip(token, token[1:], strict=False)]
        while ranks:
            m = min(ranks)
            if m == none:
                break
            k = ranks.index(m)
            token[k : k + 2] = [m]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get((m, token[k + 1]), none)
            if k:
                ranks[k - 1] = get((token[k - 1], m), none)
        return token

    def _is_whole(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        if token not in self._whole:
            self._whole[token] = self.merge(self.order[token]) == [token]
        return self._whole[token]

    def learn(self, words: set[str]) -> None:
        """Encode words that the cache lacks, the pairs of all of them checked together."""
        some = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in some]
        proposals = [self.propose(w) for w in raw]
        flat = np.fromiter(chain.from_iterable(proposals), np.int64)
        owner = np.repeat(np.arange(len(some)), [len(p) for p in proposals])
        wrong = np.zeros(len(some), bool)
        if flat.size:
            inner = owner[1:] == owner[:-1]
            key, back = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
            good = self.compatible(key >> 32, key & 0xFFFFFFFF)
            wrong[owner[1:][inner][~good[back]]] = True
            token, back = np.unique(flat, return_inverse=True)
            whole = np.array([self._is_whole(int(t)) for t in token])
            wrong[owner[~whole[back]]] = True
        self.proposed += len(some)
        self.failed += int(wrong.sum())
        for k, w in enumerate(some):
            found = self.merge(raw[k]) if wrong[k] else proposals[k]
            self._words[w] = tuple(self.id_of[found].tolist())

    def _cut(self, text: str) -> list[str]:
        """Pieces that can be encoded each on its own: a space between two other characters always begins a word."""
        if _SPACES.search(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; special tokens in a text are taken as such."""
        parts, pieces = [], set()
        for text in texts:
            own = []
            for segment in self._special.split(text) if self._special else [text]:
                own.append(self.specials[segment] if segment in self.specials else self._cut(segment))
            parts.append(own)
            for p in own:
                if isinstance(p, list):
                    pieces.update(p)
        cut = {p: WORD.findall(p) for p in pieces}
        if len(self._words) > CACHED:
            self._words.clear()
        self.learn({w for c in cut.values() for w in c} - self._words.keys())
        local = {p: tuple(chain.from_iterable(map(self._words.__getitem__, c))) for p, c in cut.items()}
        out = []
        for own in parts:
            ids: list[int] = []
            for p in own:
                if isinstance(p, list):
                    ids.extend(chain.from_iterable(map(local.__getitem__, p)))
                else:
                    ids.append(p)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _forget(self) -> None:
        self.flat, self.start = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.count = self.end = 0

    def _odd(self, chunk: K.Chunk) -> np.ndarray:
        """Rows that can't be cut at their spaces: with white space next to white space, or beyond ASCII, or a special token."""
        raw = chunk.raw
        blank = _IS_BLANK[raw]
        at = [np.flatnonzero(blank[1:] & blank[:-1])]
        lead = np.flatnonzero(_LEADS[raw])
        if lead.size:
            tail = [np.append(raw, np.zeros(2, np.uint8))[lead + k] for k in (1, 2)]
            code = raw[lead].astype(np.int32) << 16 | tail[0].astype(np.int32) << 8 | np.where(raw[lead] == 0xC2, 0, tail[1])
            at.append(lead[np.isin(code, _WIDE)])
        for special in self.specials:
            begin = special.encode()
            hit = np.zeros(0, np.int64)
            if raw.size >= len(begin):
                hit = np.flatnonzero(raw[: raw.size - len(begin) + 1] == begin[0])
                for k in range(1, len(begin)):
                    hit = hit[raw[hit + k] == begin[k]]
            at.append(hit)
        odd = np.zeros(chunk.n + 1, bool)
        odd[np.searchsorted(chunk.row, np.concatenate(at), side="right") - 1] = True
        return odd[:-1]

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column; null counts as empty.

        Texts are cut before each space; a distinct piece is encoded once and its ids are gathered
        for all its places at once.
        """
        for chunk in K.chunks(column):
            odd = self._odd(chunk)
            space = np.flatnonzero(chunk.raw == 32)
            mark = np.zeros(chunk.raw.size, bool)
            mark[space] = True
            rows = chunk.row[:-1]
            mark[rows[rows < chunk.row[1:]]] = True
            begin = np.flatnonzero(mark)
            first = np.searchsorted(begin, chunk.row)
            keep = np.repeat(~odd, np.diff(first))
            stop = np.append(begin[1:], chunk.raw.size)[keep]
            begin = begin[keep]
            first = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(first)))])
            piece, fresh, new = self.numbers.numbers(chunk, begin, stop)
            if fresh < self.count:  # the numbers began anew
                self._forget()
            if new:
                self._store([w.decode("utf-8", "replace") for w in new])
            at, size = self.start[piece], self.start[piece + 1] - self.start[piece]
            total = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
            slow = iter(self.encode_batch([chunk.text(k) for k in np.flatnonzero(odd)]))
            for k in range(chunk.n):
                yield np.array(next(slow), np.int32) if odd[k] else ids[total[first[k]] : total[first[k + 1]]]

    def _store(self, pieces: list[str]) -> None:
        """Encode pieces and keep their ids under the next numbers."""
        cut = [WORD.findall(p) for p in pieces]
        if len(self._words) > CACHED:
            self._words.clear()
        self.learn({w for c in cut for w in c} - self._words.keys())
        sizes, ids = [], []
        for c in cut:
            before = len(ids)
            for w in c:
                ids.extend(self._words[w])
            sizes.append(len(ids) - before)
        while self.end + len(ids) > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(pieces) + 1 > self.start.size:
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.end : self.end + len(ids)] = ids
        at = self.count
        self.start[at : at + len(pieces) + 1] = self.end + np.concatenate([[0], np.cumsum(sizes)])
        self.end += len(ids)
        self.count += len(pieces)


class Spelling:
    """What each id stands for, laid out flat: joins the spellings of many ids at once."""

    def __init__(self, spellings: dict[int, bytes]):
        self.size = np.zeros(max(spellings) + 1, np.int64)
        for i, s in spellings.items():
            self.size[i] = len(s)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spellings[i] for i in sorted(spellings)), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        total = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - (total - size), size) + np.arange(total[-1] if ids.size else 0)].tobytes()


@lru_cache(maxsize=2)
def loaded(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` for each row of ``docs``: the ids of its whole text, and the text that they decode to.

    A null text counts as empty. Special tokens written in a text are taken as such. Texts of any
    length are encoded whole. Repeated rows and null ids each get their row; an empty table gives no
    rows; other columns, of whatever names, are ignored.
    """

    def whole(codec, ids):
        return ids.tolist(), codec.spellings.join(ids).decode("utf-8", "replace")

    return mapped(docs, loaded, path, whole, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_documents``, with digests in place of the ids and the text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def digests(codec, ids):
        listed, decoded = codec.decimals.join(ids)[1:], codec.spellings.join(ids)
        try:
            decoded.decode()
        except UnicodeDecodeError:
            decoded = decoded.decode("utf-8", "replace").encode()
        return ids.size, hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return mapped(docs, loaded, path, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def mapped(docs: DataFrame, load, path: str, result, schema: str) -> DataFrame:
    """A row of ``schema`` for each of ``docs``: its id and what ``result`` makes of the ids of its text."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")][1:]

    small_batches(docs.sparkSession)

    def run(batches):
        codec = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                some = batch.slice(k, STEP)
                columns = zip(*(result(codec, ids) for ids in codec.encode_column(some.column(1))), strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.tidy(run), schema)
