"""Findings in long form: heads of a bounded size and a line for each of their rows.

A key that a large share of all rows has is one head with its first rows and their evidence, and as
many lines as it has rows; no row of a table grows with a group. Ids are those of the array form:
FNV-1a over all row numbers, put together from pieces of the sorted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.dataset import ROW, Dataset
from ..sources.shared import materialize
from .ranks import numbered

#: FNV-1a of 32 bits.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
_MASK = np.uint64(0xFFFFFFFF)
#: Pieces of a text that are hashed side by side.
LANES = 512


@dataclass
class Bounded:
    """Asks for groups with at most ``evidence`` rows each, and keeps the lines of all rows aside."""

    evidence: int = 50
    members: list[DataFrame] = field(default_factory=list)


def collect_bounded(members: DataFrame, by: Sequence[str], bounded: Bounded) -> DataFrame:
    """A row for each group: its first rows with their cells as ``m``, how many there are, and a number for the group."""
    keyed = materialize(members.withColumn("group", F.xxhash64(*by)), "members")
    bounded.members.append(keyed.select("group", F.col(ROW).alias("row")))
    counts = keyed.groupBy("group", *by).agg(F.count(F.lit(1)).alias("n_rows"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(ROW))
    # a task passes on no more rows of a group than are wanted
    first = keyed.select("group", ROW, "cells").withColumn("place", place).where(F.col("place") <= bounded.evidence)
    shown = first.groupBy("group").agg(F.array_sort(F.collect_list(F.struct(F.col(ROW).alias("row"), "cells"))).alias("m"))
    return counts.join(shown, "group").withColumn("rows", F.transform("m", lambda x: x["row"]))


class Piece:
    """What hashing a piece of text does to any state of FNV-1a.

    The low byte of a state decides what is added, the rest of it is only multiplied; so a piece is a
    factor and 256 results, and pieces follow each other associatively.
    """

    def __init__(self, factor: int = 1, result: np.ndarray | None = None):
        self.factor, self.result = factor, np.arange(256, dtype=np.uint64) if result is None else result

    def then(self, other: Piece) -> Piece:
        high, low = self.result >> np.uint64(8), (self.result & np.uint64(255)).astype(np.int64)
        result = ((high << np.uint64(8)) * np.uint64(other.factor) + other.result[low]) & _MASK
        return Piece(self.factor * other.factor & 0xFFFFFFFF, result)

    def after(self, state: int) -> int:
        return ((state >> 8 << 8) * self.factor + int(self.result[state & 255])) & 0xFFFFFFFF

    @classmethod
    def of(cls, text: bytes) -> Piece:
        raw, prime = np.frombuffer(text, np.uint8).astype(np.uint64), np.uint64(FNV_PRIME)
        rest = raw.size % LANES
        state = np.arange(256, dtype=np.uint64)
        for c in raw[:rest]:
            state = (state ^ c) * prime & _MASK
        whole = cls(pow(FNV_PRIME, rest, 1 << 32), state)
        if size := raw.size // LANES:
            grid, states = raw[rest:].reshape(LANES, size), np.tile(np.arange(256, dtype=np.uint64), (LANES, 1))
            for k in range(size):
                states = (states ^ grid[:, k : k + 1]) * prime & _MASK
            for lane in states:
                whole = whole.then(cls(pow(FNV_PRIME, size, 1 << 32), lane))
        return whole


def fnv(text: bytes, state: int = FNV_BASIS) -> int:
    for c in text:
        state = (state ^ c) * FNV_PRIME & 0xFFFFFFFF
    return state


def base36(n: int) -> str:
    out = ""
    while n or not out:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return out


def long_ids(rows: DataFrame) -> DataFrame:
    """``(group, id)`` from ``(group, head, row)``: ``head`` is the text before the row numbers.

    Rows are dealt to ranges of (group, row); each task makes a piece of its rows, and the pieces of a group, no more than
    there are tasks, are put together in order.
    """

    def pieces(batches):
        for batch in batches:
            group, head, row, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.lexsort((at, group))
            cut = np.flatnonzero((np.diff(group[order]) != 0) | (np.diff(at[order]) != 1)) + 1
            for part in np.split(order, cut):
                if part.size:
                    first = int(at[part[0]])
                    piece = Piece.of((("," if first else "") + ",".join(map(str, row[part].tolist()))).encode())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((int(group[part[0]]), pa.int64()), (head[part[0]], pa.string()), (first, pa.int64()), (piece.factor, pa.int64()), (piece.result.astype("<u4").tobytes(), pa.binary()))], names=["group", "head", "first", "factor", "result"])

    def joined(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["first"])
        state = fnv(rows[0]["head"].encode())
        for r in rows:
            state = Piece(r["factor"], np.frombuffer(r["result"], "<u4").astype(np.uint64)).after(state)
        return pa.table({"group": pa.array([key[0].as_py()], pa.int64()), "id": pa.array(["finding-" + base36(state)])})

    dealt = numbered(rows.select("group", "head", "row"), [F.col("row")], by=["group"]).select("group", "head", "row", "_at")
    return dealt.mapInArrow(pieces, "group long, head string, first long, factor long, result binary").groupBy("group").applyInArrow(joined, "group long, id string")


@dataclass
class LongFindings:
    """``heads``: findings with ``n_rows`` and, in ``rows`` and ``evidence``, no more than the first rows; ``members``: ``(id, row)``."""

    heads: DataFrame
    members: DataFrame

    def index(self) -> DataFrame:
        """The members with their places in their finding, from which pages are read."""
        return numbered(self.members, [F.col("row")], by=["id"], at="place", of="n_rows")


def long_findings(ds: Dataset, rule, execute: Callable, evidence: int = 50) -> LongFindings:
    """A grouping rule's findings in long form; ``execute``: its executor, called with ``(ds, rule, Bounded)``."""
    bounded = Bounded(evidence)
    found = materialize(execute(ds, rule, bounded), "heads")
    lines = bounded.members[0].join(found.select("group", "type", F.col("id").alias("short"), "n_rows", "id_key"), "group")
    many = lines.where(F.col("n_rows") > evidence).select("group", F.concat("type", F.lit(":"), "id_key", F.lit(":")).alias("head"), "row")
    ids = materialize(long_ids(many), "long-ids").withColumnRenamed("id", "whole")
    heads = found.join(ids, "group", "left").withColumn("id", F.coalesce("whole", "id")).drop("whole", "group", "id_key")
    members = lines.join(ids, "group", "left").select(F.coalesce("whole", "short").alias("id"), "row")
    return LongFindings(heads, members)


def page_of(ds: Dataset, index: DataFrame, finding: str, keys: Sequence[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a finding's rows by place: ``limit`` places are looked up and joined, whatever comes before them.

    A row that the dataset no longer has is an error.
    """
    places = index.where((F.col("id") == finding) & F.col("place").between(offset, offset + limit - 1)).select(F.col("row").alias("wanted"))
    places = places.limit(limit)
    out = ds.df.join(F.broadcast(places), F.col(ROW) == F.col("wanted")).select(ROW, *keys)  # no more than ``limit`` rows
    if out.count() != places.count():
        raise LookupError("Some source rows are no longer there. Load the source again and run the analysis anew.")
    return out.orderBy(ROW)
