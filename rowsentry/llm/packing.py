"""Best-fit packing by the configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence; the program covers the histogram
with as few as it can. It is solved by multiplicative weights: each round's weights are prices, a
knapsack dynamic program finds the best value at them, which gives a lower bound by duality, and
for every length the best configuration that holds it; those near the best value are used a
little, and the weights of what they cover fall. The fractional answer is rounded down to whole
sequences of its fullest configurations, what that leaves is solved and rounded again, a few
times, and best fit places the rest, in groups of equal sequences; best fit alone wins if it needs
fewer, so the answer is never worse. The plan depends on the
histogram alone (at most ``capacity`` rows), never on the number of documents, and says for each
length which ranks go where.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import kernels as K
from .spans import SpanNumbers
from .store import materialize, small_batches

CAPACITY = 2048
#: Rounds of the multiplicative weights in all passes, and the share of a sequence that a pass's configurations may leave free.
ROUNDS, FREE = 200, (0.0005, 0.0005, 0.0005, 0.0005, 0.0005, 0.001, 0.002, 0.004)
#: Cached words of a worker; a full cache is emptied.
CACHED = 800_000


@dataclass
class Plan:
    """Runs of equal placements: ranks from ``rank`` on, ``count`` of them, ``per`` to a sequence from ``bin`` on, the first at ``offset``."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)
    bins: int = 0
    #: No packing needs fewer sequences; and the share of the sequences that the program made.
    bound: int = 0
    share: float = 0.0

    def place(self, length: int, count: int, bin_: int, per: int, offset: int) -> None:
        at = self.used.get(length, 0)
        self.runs.append((length, at, count, bin_, per, offset))
        self.used[length] = at + count


def best_values(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of a multiset of lengths that fits each room up to ``capacity``, and the last length put in (-1: none, a unit stays free)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            worth = best[c - lengths[: upto[c]]] + values[: upto[c]]
            k = int(np.argmax(worth))
            if worth[k] > best[c]:
                best[c], pick[c] = worth[k], k
    return best, pick


def traced(lengths: np.ndarray, pick: np.ndarray, room: int) -> dict[int, int]:
    """The multiset that ``best_values`` found for a room, by index of length."""
    out: dict[int, int] = {}
    while room > 0:
        k = int(pick[room])
        if k < 0:
            room -= 1
        else:
            out[k] = out.get(k, 0) + 1
            room -= int(lengths[k])
    return out


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths (by index) of the largest value that fits, each any number of times."""
    return traced(lengths, best_values(lengths, values, capacity)[1], capacity)


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = 0.1, near: float = 0.005) -> tuple[list[tuple[dict[int, int], float]], float]:
    """A fractional cover of the histogram, configurations and how many sequences of each; and a lower bound of any cover."""
    n = counts.astype(np.float64)
    weight = n * lengths  # the first prices are by volume
    covered, found, bound = np.zeros(n.size), {}, 0.0
    for _ in range(rounds):
        price = weight / n
        best, pick = best_values(lengths, price, capacity)
        # prices over the best value are a dual solution
        bound = max(bound, float(weight.sum() / best[capacity]))
        value = price + best[capacity - lengths]
        gain = np.zeros(n.size)
        some = np.flatnonzero(value >= (1 - near) * best[capacity])
        for i in some[np.argsort(covered[some], kind="stable")].tolist():
            if gain[i] >= step:
                continue  # covered by the others of this round
            config = traced(lengths, pick, capacity - int(lengths[i]))
            config[i] = config.get(i, 0) + 1
            k, a = np.array(list(config)), np.array(list(config.values()))
            times = step * float(np.min(n[k] / a))
            gain[k] += a * times / n[k]
            key = tuple(sorted(config.items()))
            found[key] = found.get(key, 0.0) + times
        covered += gain
        weight *= np.exp(-gain)
        weight = np.maximum(weight, weight.max() * 1e-12)
    # of the volume that the cover holds, as much as there is
    volume = sum(x * sum(int(lengths[k]) * a for k, a in key) for key, x in found.items())
    scale = float((n * lengths).sum()) / volume if volume else 0.0
    return [(dict(key), x * scale) for key, x in found.items()], bound


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """The better one of best fit alone and of rounding the program in passes."""
    alone = _finish(Plan(capacity), {n: c for n, c in histogram.items() if c > 0}, _rooms(capacity))
    plan = _in_passes(histogram, capacity, rounds)
    alone.bound = plan.bound
    return min(plan, alone, key=lambda p: p.bins)


def _in_passes(histogram: dict[int, int], capacity: int, rounds: int) -> Plan:
    """Solve the program, take whole sequences of its fullest configurations, solve it anew for what is left; best fit places the rest.

    A pass takes configurations that leave no more than its share of a sequence free, so what one
    rounding leaves over is covered by the next and not by chance.
    """
    plan, left, room = Plan(capacity), {n: c for n, c in histogram.items() if c > 0}, _rooms(capacity)
    whole = left.pop(capacity, 0)
    if whole:
        plan.place(capacity, whole, 0, 1, 0)
        plan.bins += whole
    for k, free in enumerate(FREE):
        lengths = np.array(sorted(n for n, c in left.items() if c), np.int64)
        if not lengths.size:
            break
        cover, bound = configurations(lengths, np.array([left[n] for n in lengths.tolist()]), capacity, max(1, rounds // len(FREE)))
        if not k:
            plan.bound = math.ceil(bound - 1e-6) + whole
        before = plan.bins
        for config, x in sorted(cover, key=lambda c: -sum(lengths[k] * a for k, a in c[0].items())):
            size = sum(int(lengths[k]) * a for k, a in config.items())
            times = min(int(x + 1e-9), *(left[int(lengths[k])] // a for k, a in config.items()))
            if size >= capacity * (1 - free) and times:
                offset = 0
                for i, a in sorted(config.items(), reverse=True):
                    n = int(lengths[i])
                    plan.place(n, times * a, plan.bins, a, offset)
                    left[n] -= times * a
                    offset += n * a
                _spare(room, capacity - offset, plan.bins, times)
                plan.bins += times
        if plan.bins == before:
            break
    plan.share = plan.bins
    plan = _finish(plan, left, room)
    plan.share = plan.share / plan.bins if plan.bins else 0.0
    return plan


def _rooms(capacity: int) -> list[list[tuple[int, int]]]:
    """Groups of equal sequences, first and how many, by the room that they have left."""
    return [[] for _ in range(capacity + 1)]


def _spare(room: list[list[tuple[int, int]]], size: int, first: int, count: int) -> None:
    if size and count:
        room[size].append((first, count))


def _finish(plan: Plan, left: dict[int, int], room: list[list[tuple[int, int]]]) -> Plan:
    """Best fit for what is left: longest first, each into the group with the least room that holds it."""
    capacity = plan.capacity
    for n in sorted(left, reverse=True):
        while left[n]:
            size = next((s for s in range(n, capacity + 1) if room[s]), None)
            if size is None:
                per = capacity // n
                bins, rest = divmod(left[n], per)
                if bins:
                    plan.place(n, bins * per, plan.bins, per, 0)
                    _spare(room, capacity - per * n, plan.bins, bins)
                if rest:
                    plan.place(n, rest, plan.bins + bins, rest, 0)
                    _spare(room, capacity - rest * n, plan.bins + bins, 1)
                plan.bins += bins + (rest > 0)
                left[n] = 0
            else:
                first, count = room[size].pop()
                take = min(count, left[n])
                plan.place(n, take, first, 1, capacity - size)
                left[n] -= take
                _spare(room, size - n, first, take)
                _spare(room, size, first + take, count - take)
    return plan


class WordEncoder:
    """Ids of texts by a tokenizers file whose words never cross a space, each distinct word encoded once.

    It holds for vocabularies that drop white space. Words are cut at spaces and line feeds; the
    library itself encodes the new ones, many at a time with a marker word between them.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.numbers = SpanNumbers(CACHED)
        self.clear()

    def clear(self) -> None:
        self.flat, self.start = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64)
        self.count = self.end = 0

    def learn(self, words: list[str]) -> None:
        """Encode words and keep their ids under the next numbers."""
        plain = [k for k, w in enumerate(words) if self.MARK not in w] if self.mark is not None else []
        odd = sorted(set(range(len(words))) - set(plain))
        found: list[np.ndarray] = [np.zeros(0, "<u4")] * len(words)
        for k, e in zip(odd, self.tokenizer.encode_batch([words[k] for k in odd], add_special_tokens=False), strict=True):
            found[k] = np.array(e.ids, "<u4")
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        joined = [f" {self.MARK} ".join(words[k] for k in g) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(ids == self.mark)
            assert cut.size == len(g) - 1
            for k, x, y in zip(g, [0, *(cut + 1).tolist()], [*cut.tolist(), ids.size], strict=True):
                found[k] = ids[x:y]
        size = sum(x.size for x in found)
        while self.end + size > self.flat.size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(words) + 1 > self.start.size:
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        if size:
            self.flat[self.end : self.end + size] = np.concatenate(found)
        at = self.count
        self.start[at : at + len(words) + 1] = self.end + np.concatenate([[0], np.cumsum([x.size for x in found])])
        self.end += size
        self.count += len(words)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column; null counts as empty."""
        for chunk in K.chunks(column):
            start, end, first = chunk.spans((chunk.raw != 32) & (chunk.raw != 10))
            word, fresh, new = self.numbers.numbers(chunk, start, end)
            if fresh < self.count:  # the numbers began anew
                self.clear()
            if new:
                self.learn([w.decode("utf-8", "replace") for w in new])
            begin, size = self.start[word], self.start[word + 1] - self.start[word]
            total = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
            for i in range(chunk.n):
                yield ids[total[first[i]] : total[first[i + 1]]]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's ids, ``end_id`` last, cut into pieces of ``capacity``: ``doc_id, piece, start, length, ids_crc32`` and optionally ``ids``.

    ``task`` and ``local`` number the pieces of a length within a task, for ``pack``.
    """

    def run(batches):
        task, counter = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        codec = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024)
                out = []
                for doc, ids in zip(some.column(0).to_pylist(), codec.encode(some.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, ids.size, capacity)):
                        part = ids[start : start + capacity]
                        row = (doc, piece, start, part.size, zlib.crc32(part.tobytes()), task, int(counter[part.size]))
                        out.append((*row, part.tolist()) if with_ids else row)
                        counter[part.size] += 1
                schema = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("local", pa.int64())]
                schema += [("ids", pa.list_(pa.int64()))] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.tidy(run), PIECES + ", ids array<long>" * with_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Give each row of ``pieces`` its ``sequence_id`` and ``offset``; ``sequences`` and ``least_sequences`` tell how many there are, and how few any packing needs.

    ``pieces`` must be a written table: the ranks of a length are its tasks' counts, summed in the
    order of the tasks, plus the number within the task. So no length is gathered in one place.
    """
    counts = materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = materialize(counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")), "shifts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = make_plan(histogram, capacity, rounds)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    span = (max(histogram.values(), default=0) + 1) if histogram else 1
    key = runs[:, 0] * span + runs[:, 1]

    placed = ["sequence_id", "offset"]
    ranked = pieces.join(shifts, ["length", "task"], "left").withColumn("rank", F.col("local") + F.col("shift")).drop("task", "local", "shift")
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")

    def place(batches):
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            run = runs[np.searchsorted(key, length * span + rank, side="right") - 1] if len(runs) else runs
            within = rank - run[:, 1]
            own = [run[:, 3] + within // run[:, 4], run[:, 5] + within % run[:, 4] * length]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, own)], names=[*batch.schema.names, *placed])

    schema = T.StructType([*ranked.schema.fields, *(T.StructField(n, T.LongType()) for n in placed)])
    return ranked.mapInArrow(K.tidy(place), schema).drop("rank").withColumns({"sequences": F.lit(plan.bins).cast("long"), "least_sequences": F.lit(plan.bound).cast("long")})


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Tokenise and pack all rows of ``docs``: a row for each piece with its sequence and offset.

    A null or empty text is one piece, its end id alone. Repeated rows and null ids are packed as
    rows of their own; other columns are ignored, whatever their names; an empty table gives no
    rows. A text of any length is encoded whole and cut. A sequence holds its pieces without gaps
    from 0. Pieces of equal length may stand for each other.
    """
    small_batches(docs.sparkSession)
    return pack(materialize(tokenized_pieces(docs, path, capacity), "pieces"), capacity, rounds)
