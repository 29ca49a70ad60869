"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's bag holds its character n-grams, so a misspelling or an inflected form shares vectors with
the words seen in training. The bag's mean goes through a linear softmax; vectors and softmax are
fitted together. A document is as toxic as its most toxic word: in training, the words of a toxic
document that the model ranks highest stand for it, and all words of clean documents are clean.
(The mean over a whole document, measured on held-out rows, finds little more than half of what
this finds at the same false positives: one word in a hundred drowns in it.) Some labelled rows are
kept out of the fit to set the threshold.

For two classes the softmax is linear in the mean, so each n-gram has one number for scoring.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .labelled import MAX_ROWS, fold, sample
from .store import small_batches

BUCKETS, WIDTH, GRAMS = 1 << 17, 12, (3, 4, 5, 6)
#: Words of a toxic document that stand for it.
TOP = 2
#: One in so many labelled rows sets the threshold instead of being fitted.
KEPT_OUT = 5
_NOISE = re.compile(r"[\W\d_]+")


@dataclass
class Words:
    """The words of a chunk, letters only in lower case: distinct ones, and which rows have which."""

    words: list[str]
    row: np.ndarray
    word: np.ndarray


def words_of(chunk: K.Chunk) -> Words:
    """Cut at white space, that beyond ASCII too; what has no letter is no word."""
    start, end, first = chunk.words()
    _, where, back = np.unique(chunk.hashes(start, end), return_index=True, return_inverse=True)
    raw = memoryview(chunk.raw)
    known: dict[str, int] = {}
    parts: list[list[int]] = []
    for k in where.tolist():
        found = (_NOISE.sub("", x) for x in str(raw[start[k] : end[k]], "utf-8", "replace").lower().split())
        parts.append([known.setdefault(w, len(known)) for w in found if w])
    many = np.array([len(p) for p in parts], np.int64)
    flat = np.array([i for p in parts for i in p], np.int64)
    at = np.cumsum(many) - many
    row, times = np.repeat(np.arange(chunk.n), np.diff(first)), many[back]
    row = np.repeat(row, times)
    word = flat[np.repeat(at[back] - (np.cumsum(times) - times), times) + np.arange(times.sum())] if flat.size else flat
    key = np.unique(row * max(len(known), 1) + word)
    return Words(list(known), key // max(len(known), 1), key % max(len(known), 1))


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word index and bucket of each character n-gram of each word, its edges marked."""
    point = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64) if words else np.zeros(0, np.uint64)
    owner = np.cumsum(point == ord("<")) - 1
    at, bucket = [], []
    for n in GRAMS:
        m = point.size - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + point[k : k + m]
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        at.append(owner[:m][inside])
        bucket.append((K.mix(h[inside]) >> np.uint64(40)).astype(np.int64) % BUCKETS)
    # a word shorter than the least n-gram has its own letters as one
    short = [i for i, w in enumerate(words) if len(w) + 2 < GRAMS[0]]
    at.append(np.array(short, np.int64))
    bucket.append(np.array([sum(map(ord, words[i])) % BUCKETS for i in short], np.int64))
    return np.concatenate(at).astype(np.int64), np.concatenate(bucket)


@dataclass
class SubwordSoftmax:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, seed: int = 11) -> SubwordSoftmax:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.array([3.0, 0.0], np.float32))

    def gram_scores(self) -> np.ndarray:
        """What each n-gram adds to the difference of a bag's two logits, before the mean."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)

    def word_logits(self, words: list[str], scores: np.ndarray | None = None) -> np.ndarray:
        at, bucket = bags(words)
        scores = self.gram_scores() if scores is None else scores
        n = np.maximum(np.bincount(at, minlength=len(words)), 1)
        return np.bincount(at, scores[bucket], minlength=len(words)) / n + float(self.bias[1] - self.bias[0])

    def calibrate(self, docs: list[list[str]], y: np.ndarray, cost: float = 5.0) -> None:
        """Shift the bias so that 0.5 parts the labelled documents best, a clean one above it weighing ``cost`` times as much (by share)."""
        every = sorted({w for d in docs for w in d})
        z = dict(zip(every, self.word_logits(every).tolist(), strict=True))
        top = np.array([max((z[w] for w in d), default=-30.0) for d in docs])
        order = np.argsort(-top)
        toxic, top = y[order] == 1, top[order]
        gain = np.cumsum(toxic) / toxic.sum() - cost * np.cumsum(~toxic) / (~toxic).sum()
        best = int(np.argmax(gain))
        after = top[best + 1] if best + 1 < len(top) else top[best] - 1
        cut = after + 0.3 * (top[best] - after)  # nearer to the clean side: misspellings score lower than what they misspell
        self.bias[1] -= np.float32(cut)

    def step(self, at: np.ndarray, bucket: np.ndarray, n: int, y: np.ndarray, weight: np.ndarray, rate: float, seen: np.ndarray) -> None:
        """A step of Adagrad over n words with their targets and weights."""
        size = np.maximum(np.bincount(at, minlength=n), 1).astype(np.float32)
        order = np.argsort(at, kind="stable")
        at, bucket = at[order], bucket[order]
        mean = np.zeros((n, WIDTH), np.float32)
        has = np.flatnonzero(np.bincount(at, minlength=n))
        mean[has] = np.add.reduceat(self.vectors[bucket], np.searchsorted(at, has), axis=0)
        mean /= size[:, None]
        z = mean @ self.weights + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = ((p - np.stack([1 - y, y], axis=1)) * weight[:, None]).astype(np.float32)
        back = (d @ self.weights.T) / size[:, None]
        by = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[by], return_index=True)
        g = np.add.reduceat(back[at[by]], first, axis=0)
        seen[used] += (g**2).mean(1)
        self.vectors[used] -= rate * g / np.sqrt(seen[used] + 1e-8)[:, None]
        scale = rate / np.sqrt(weight.sum() + 1)
        self.weights -= scale * (mean.T @ d)
        self.bias -= scale * d.sum(0)

    def fit(self, docs: list[list[str]], y: np.ndarray, rounds: int = 12, rate: float = 0.1, seed: int = 13) -> None:
        """Fit on the distinct words of documents with their labels; each round ranks the toxic documents' words anew."""
        rng = np.random.default_rng(seed)
        clean: dict[str, int] = {}
        for doc, label in zip(docs, y, strict=True):
            if not label:
                for w in doc:
                    clean[w] = clean.get(w, 0) + 1
        toxic = [d for d, label in zip(docs, y, strict=True) if label and d]
        negatives = sorted(clean)
        seen = np.zeros(BUCKETS, np.float32)
        # to begin with, a word counts by how much more often toxic documents have it
        counts: dict[str, int] = {}
        for d in toxic:
            for w in d:
                counts[w] = counts.get(w, 0) + 1
        prior = lambda w: counts[w] / (1 + 3 * clean.get(w, 0))
        chosen = [sorted(d, key=lambda w: (-prior(w), w))[:TOP] for d in toxic]
        positive_words = sorted(counts)
        place = {w: i for i, w in enumerate(positive_words)}
        for turn in range(rounds):
            if turn:
                z = self.word_logits(positive_words)
                # a word that clean documents have doesn't stand for a toxic one
                z -= np.array([2.0 * min(clean.get(w, 0), 10) for w in positive_words])
                chosen = [sorted(d, key=lambda w: (-z[place[w]], w))[:TOP] for d in toxic]
            share: dict[str, float] = {}
            for some in chosen:
                for rank, w in enumerate(some):
                    share[w] = share.get(w, 0) + 1 / (1 + rank) ** 2
            # a word that stands for one document only is more likely chance than a term
            positives = sorted(w for w in share if counts[w] > 1 and not clean.get(w)) or sorted(share)
            words = positives + negatives
            target = np.r_[np.ones(len(positives)), np.zeros(len(negatives))].astype(np.float32)
            weight = np.r_[np.sqrt([share[w] for w in positives]), [min(30.0, clean[w] ** 0.7) for w in negatives]].astype(np.float32)
            weight[: len(positives)] *= min(50.0, 0.25 * len(negatives) / max(weight[: len(positives)].sum(), 1))  # toxic words are rare
            at, bucket = bags(words)
            cut = np.searchsorted(np.sort(at), np.arange(len(words) + 1)) if at.size else np.zeros(len(words) + 1, np.int64)
            order = np.argsort(at, kind="stable")
            at, bucket = at[order], bucket[order]
            shuffled = rng.permutation(len(words))
            for k in range(0, len(words), 4096):
                some = shuffled[k : k + 4096]
                size = cut[some + 1] - cut[some]
                pick = np.repeat(cut[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                self.step(np.repeat(np.arange(len(some)), size), bucket[pick], len(some), target[some], weight[some], rate, seen)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> SubwordSoftmax | None:
    """A model fitted on at most ``max_rows`` labelled rows, none of them held out; None without labels of both kinds."""

    small_batches(docs.sparkSession)

    def gather(batches):
        for batch in batches:
            found: list[str] = []
            for chunk in K.chunks(batch.column(0)):
                w = words_of(chunk)
                cut = np.searchsorted(w.row, np.arange(chunk.n + 1)).tolist()
                found += [" ".join(sorted(w.words[k] for k in w.word[a:b].tolist())) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(1), batch.column(2)], names=["words", "label", "doc_id"])

    train = sample(docs, labels, "toxic", where=fold("doc_id", 5) != 0, max_rows=max_rows)
    rows = train.select("text", "label", "doc_id").mapInArrow(K.tidy(gather), "words string, label int, doc_id long").collect()
    rows.sort(key=lambda r: (r.doc_id, r.words))
    y = np.array([r.label for r in rows])
    if not len(rows) or y.min() == y.max():
        return None
    return trained([r.words.split() for r in rows], y)


def trained(docs: list[list[str]], y: np.ndarray) -> SubwordSoftmax:
    """A model fitted on most of the documents; one in ``KEPT_OUT`` of either label sets its threshold, where that leaves some of both."""
    rank = np.zeros(y.size, np.int64)
    for label in (0, 1):
        rank[y == label] = np.arange((y == label).sum())
    out = rank % KEPT_OUT == KEPT_OUT - 1
    if not 0 < y[out].sum() < out.sum():
        out[:] = False
    pick = lambda mask: [d for d, m in zip(docs, mask, strict=True) if m]
    model = SubwordSoftmax.new()
    model.fit(pick(~out), y[~out])
    model.calibrate(pick(out), y[out]) if out.any() else model.calibrate(docs, y)
    return model


def chunk_logits(chunk: K.Chunk, scores: np.ndarray, shift: float) -> np.ndarray:
    """The largest word logit of each row; rows without a word get the least."""
    w = words_of(chunk)
    top = np.full(chunk.n, -30.0)
    if w.words:
        at, bucket = bags(w.words)
        z = np.bincount(at, scores[bucket], minlength=len(w.words)) / np.maximum(np.bincount(at, minlength=len(w.words)), 1) + shift
        np.maximum.at(top, w.row, z[w.word])
    return top


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Rows whose crc32 of the id modulo 5 is 0 are held out of the fit; a null id is never held out.
    Null and empty texts and texts without letters get a score next to 0. Without labels of both
    kinds every document does. Texts of any length are read whole. Repeated rows each get their
    row, equal texts the same score; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    model = fit(docs, labels, max_rows)
    scores = np.zeros(BUCKETS, np.float32) if model is None else model.gram_scores().astype(np.float32)
    shift = -30.0 if model is None else float(model.bias[1] - model.bias[0])

    def judge(batches):
        for batch in batches:
            z = [chunk_logits(chunk, scores, shift) for chunk in K.chunks(batch.column(2))]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate([*z, np.zeros(0)]), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(K.tidy(judge), "doc_id long, held_out boolean, score double, predicted int")
