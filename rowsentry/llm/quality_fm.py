"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

A document's features are its hashed words (weights of unit length) and one of ``BINS`` bins of
each statistic. Pairwise interactions have rank ``RANK`` and are scored in time linear in the
features: half of (sum of v x) squared minus the sum of (v x) squared.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docstats
from . import kernels as K
from .labelled import MAX_ROWS, fold, sample
from .store import small_batches

WORDS, BINS, RANK = 1 << 14, 16, 6
SIZE = WORDS + BINS * len(docstats.RATES)
BIN_WEIGHT = 0.6


def features(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of each non-zero feature; a feature of a row comes once."""
    low = chunk.lower()
    start, end, first = low.words()
    row = np.repeat(np.arange(chunk.n), np.diff(first))
    bucket = (low.hashes(start, end) >> K.U(40)).astype(np.int64) % WORDS
    key, times = np.unique(row * WORDS + bucket, return_counts=True)
    row, bucket, value = key // WORDS, key % WORDS, np.sqrt(times)
    norm = np.sqrt(np.bincount(row, value**2, minlength=chunk.n))
    value = value / np.maximum(norm, 1e-9)[row]
    x = docstats.rates(docstats.counts(chunk))
    column = np.arange(x.shape[1])
    bins = WORDS + column * BINS + np.minimum((x * BINS).astype(np.int64), BINS - 1)
    return (
        np.concatenate([row, np.repeat(np.arange(chunk.n), x.shape[1])]),
        np.concatenate([bucket, bins.ravel()]),
        np.concatenate([value, np.full(bins.size, BIN_WEIGHT)]),
    )


def pack(feature: np.ndarray, value: np.ndarray) -> bytes:
    """A row's ascending features and their float32 values in few bytes, without loss: steps, levels of values, and each one's level."""
    levels, level = np.unique(value.astype("<f4"), return_inverse=True)
    return zlib.compress(b"".join([len(levels).to_bytes(4, "little"), levels.tobytes(), np.diff(feature, prepend=0).astype("<u2").tobytes(), level.astype("<u2").tobytes()]), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``pack`` got."""
    raw = zlib.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    step, level = np.frombuffer(raw, "<u2", offset=4 + 4 * n).reshape(2, -1).astype(np.int64)
    return np.cumsum(step), np.frombuffer(raw, "<f4", n, 4)[level].astype(np.float64)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @classmethod
    def new(cls, size: int = SIZE, rank: int = RANK, seed: int = 3) -> FactorisationMachine:
        return cls(0.0, np.zeros(size), np.random.default_rng(seed).normal(0, 0.05, (size, rank)))

    def logits(self, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of n rows, and the sums of v x by factor that the gradient needs."""
        vx = self.factors[feature] * value[:, None]
        sums = np.stack([np.bincount(row, vx[:, f], minlength=n) for f in range(vx.shape[1])], axis=1)
        squares = np.bincount(row, (vx**2).sum(1), minlength=n)
        return self.bias + np.bincount(row, self.linear[feature] * value, minlength=n) + 0.5 * ((sums**2).sum(1) - squares), sums

    def fit(self, docs: list[bytes], y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 2e-5, seed: int = 5) -> None:
        """Adagrad on the log loss, both labels weighing the same in sum; only a batch of the packed ``docs`` is open at once."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        g_bias, g_linear, g_factors = 1e-6, np.full(len(self.linear), 1e-6), np.full(self.factors.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                opened = [unpack(docs[i]) for i in some]
                row = np.repeat(np.arange(len(some)), [f.size for f, _ in opened])
                feature, value = (np.concatenate([x[side] for x in opened]) for side in (0, 1))
                z, sums = self.logits(len(some), row, feature, value)
                d = weight[some] * (1 / (1 + np.exp(-z)) - y[some]) / len(some)
                g_bias += d.sum() ** 2
                self.bias -= rate * d.sum() / math.sqrt(g_bias)
                used, back = np.unique(feature, return_inverse=True)
                at = (d[row] * value)
                gl = np.bincount(back, at) + decay * self.linear[used]
                inner = sums[row] - self.factors[feature] * value[:, None]
                gv = np.stack([np.bincount(back, at * inner[:, f]) for f in range(inner.shape[1])], axis=1) + decay * self.factors[used]
                g_linear[used] += gl**2
                g_factors[used] += gv**2
                self.linear[used] -= rate * gl / np.sqrt(g_linear[used])
                self.factors[used] -= rate * gv / np.sqrt(g_factors[used])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """A machine fitted on at most ``max_rows`` labelled rows, none of them held out; the driver gets their features packed."""

    small_batches(docs.sparkSession)

    def gather(batches):
        for batch in batches:
            packed = []
            for chunk in K.chunks(batch.column(0)):
                row, feature, value = features(chunk)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(1, chunk.n))
                packed += [pack(f, v) for f, v in zip(np.split(feature[order], cut), np.split(value[order], cut), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1), batch.column(2)], names=["features", "label", "doc_id"])

    train = sample(docs, labels, "quality", where=fold("doc_id", 3) != 1, max_rows=max_rows)
    rows = train.select("text", "label", "doc_id").mapInArrow(K.tidy(gather), "features binary, label int, doc_id long").collect()
    rows.sort(key=lambda r: (r.doc_id, r.features))
    machine = FactorisationMachine.new()
    y = np.array([r.label for r in rows], np.float64)
    if len(rows) and 0 < y.mean() < 1:
        machine.fit([bytes(r.features) for r in rows], y)
    else:  # labels of one kind only, or none: every document gets the same score
        machine.factors[:] = 0
        machine.bias = 4.0 if not len(rows) or y.mean() == 1 else -4.0
    return machine


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Rows whose crc32 of the id modulo 3 is 1 are held out of the fit; a null id is never held out.
    Null and empty texts are scored as texts without words. Without labels all scores are the same
    and the documents count as good. Texts of any length are read whole; repeated rows each get their
    row, equal texts the same score; an empty table gives no rows; other columns are ignored.
    """
    machine = fit(docs, labels, max_rows)

    def judge(batches):
        for batch in batches:
            z = [machine.logits(chunk.n, *features(chunk))[0] for chunk in K.chunks(batch.column(2))]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate([*z, np.zeros(0)]), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(K.tidy(judge), "doc_id long, held_out boolean, score double, predicted int")


def keep_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, fit_on: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns; nothing is shuffled.

    The machine is fitted on the labelled rows of ``fit_on``, or of ``docs`` if there is none.
    """
    machine = fit(docs if fit_on is None else fit_on, labels, max_rows)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            z = [machine.logits(chunk.n, *features(chunk))[0] for chunk in K.chunks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate([*z, np.zeros(0)]) >= 0))

    return docs.mapInArrow(K.tidy(keep), docs.schema)
