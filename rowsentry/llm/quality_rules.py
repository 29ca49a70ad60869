"""Quality rules: base rules, then an isolation forest on rule statistics.

The trees split the box of the labelled rows' statistics at random; clean documents fill small
parts of it and need many splits, while a path into empty space ends early. The score of a
document is its mean path length. The box is that of all labelled rows; each tree grows on its own 256 rows, drawn from all clean
ones that don't set the threshold, as the method has it; the threshold is the best over all other labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_sum
from . import docstats
from . import kernels as K
from .labelled import agreed
from .store import materialize, small_batches

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, path_length double"
COUNTED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, x array<double>"
TREES, POINTS = 100, 256
#: Of each three clean labelled rows two may grow trees, by a hash of the row. What a clean document below the threshold weighs, by share, for a poor one.
FOLDS, COST = 3, 10.0


def _expected(n: np.ndarray) -> np.ndarray:
    """The mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, box: tuple[np.ndarray, np.ndarray], depth: int, rng: np.random.Generator) -> tuple[list, list, list, list]:
    """Feature, split, children and path length of each node."""
    live = np.flatnonzero(box[1] > box[0])
    feature, split, child, length = [], [], [], []

    def grow(rows, low, high, level):
        at = len(feature)
        feature.append(-1)
        split.append(0.0)
        child.append((at, at))
        length.append(level + float(_expected(rows.shape[0])))
        if rows.shape[0] <= 1 or level >= depth or not live.size:
            return at
        f = int(rng.choice(live))
        x = rng.uniform(low[f], high[f])
        less, more = high.copy(), low.copy()
        less[f], more[f] = x, x
        go = rows[:, f] < x
        feature[at], split[at] = f, x
        child[at] = (grow(rows[go], low, less, level + 1), grow(rows[~go], more, high, level + 1))
        return at

    grow(points, box[0].copy(), box[1].copy(), 0)
    return feature, split, child, length


@dataclass
class IsolationForest:
    """Trees as arrays: ``feature`` (-1 at leaves), ``split``, ``left`` and ``right`` child, ``length`` of the path at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    length: np.ndarray
    threshold: float = 0.0

    @classmethod
    def fit(cls, clean: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, points: int = POINTS, depth: int = 14, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        return cls.of([grow_tree(clean[rng.permutation(len(clean))[:points]], box, depth, rng) for _ in range(trees)])

    @classmethod
    def of(cls, forest: list[tuple[list, list, list, list]]) -> IsolationForest:
        size = max(len(t[0]) for t in forest)
        pad = lambda k, fill, kind: np.array([[*t[k], *[fill] * (size - len(t[0]))] for t in forest], kind)
        return cls(pad(0, -1, np.int16), pad(1, 0.0, np.float64), pad(2, (0, 0), np.int32), pad(3, 0.0, np.float64))

    def path_length(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, split, child, length in zip(self.feature, self.split, self.child, self.length, strict=True):
            at = np.zeros(len(x), np.int32)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                i = every[inner]
                right = x[i, f[i]] >= split[at[i]]
                at[i] = child[at[i], right.astype(np.int8)]
            total += length[at]
        return total / len(self.feature)

    def calibrate(self, paths: np.ndarray, clean: np.ndarray, cost: float = COST) -> None:
        """The threshold with the most junk below it, a clean document there weighing ``cost`` times as much (by share)."""
        self.threshold = -np.inf
        if clean.all() or not clean.any():
            return
        order = np.argsort(paths)
        good, p = clean[order], paths[order]
        gain = np.cumsum(~good) / (~good).sum() - cost * np.cumsum(good) / good.sum()
        gain[:-1][p[1:] == p[:-1]] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] > 0:
            after = p[best + 1] if best + 1 < len(p) else p[best] + 1
            self.threshold = float((p[best] + after) / 2)


def base_failed(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < 10) | (100 * c[:, 4] > 20 * c[:, 0])


def counted(docs: DataFrame) -> DataFrame:
    """Base statistics of each row of ``docs``, and the rates that trees look at as ``x``."""
    small_batches(docs.sparkSession)

    def count(batches):
        for batch in batches:
            c = docstats.batch_counts(batch.column(1))
            x = pa.array(list(docstats.rates(c)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[:, k]) for k in range(5)), pa.array(base_failed(c)), x], names=[x.split()[0] for x in COUNTED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.tidy(count), COUNTED)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), len(docstats.RATES))


def fit(docs: DataFrame, labels: DataFrame) -> IsolationForest:
    """A forest from all labelled rows of ``docs``."""
    return fit_counted(counted(docs), labels)


def fit_counted(statistics: DataFrame, labels: DataFrame) -> IsolationForest:
    """A forest from all labelled rows that pass the base rules; the driver sees the box, the trees and the threshold."""
    rows = statistics.where(~F.col("base_failed")).select("doc_id", "x").join(agreed(labels, "quality"), "doc_id")
    clean = F.col("label") == 1
    rows = materialize(rows.select(F.xxhash64("doc_id", "x").alias("h"), clean.alias("clean"), "x").withColumn("grown", F.col("clean") & (F.pmod("h", F.lit(FOLDS)) > 0)), "rule-statistics")
    d = range(len(docstats.RATES))
    got = rows.agg(F.count_if("grown").alias("grown"), F.count_if(~F.col("clean")).alias("junk"), F.array(*[F.min(F.col("x")[k]) for k in d]).alias("low"), F.array(*[F.max(F.col("x")[k]) for k in d]).alias("high")).first()
    if not got.grown or not got.junk:
        forest = IsolationForest.fit(np.zeros((0, len(d))), (np.zeros(len(d)), np.ones(len(d))), trees=1)
        forest.threshold = -np.inf
        return forest
    forest = _grown(rows, got.grown, (np.array(got.low), np.array(got.high)))
    forest.threshold = _threshold(rows, forest)
    return forest


def _grown(rows: DataFrame, many: int, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, points: int = POINTS, depth: int = 14, seed: int = 7) -> IsolationForest:
    """Each tree in a task, on the ``points`` rows with the smallest hashes for it; rows with large ones don't travel."""
    share = min(1.0, 4 * points / many)
    most = np.uint64(min(2**64 - 1, int(share * 2**64)))

    def deal(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            for tree in range(trees):
                own = K.mix(h ^ np.uint64(K.mix_one(seed * 1000 + tree)))
                at = np.flatnonzero(own <= most)
                if at.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, tree, np.int32)), pa.array(own[at].view(np.int64)), batch.column(1).take(pa.array(at))], names=["tree", "own", "x"])

    def grow(key, table):
        table = table.combine_chunks()
        own, x = table["own"].to_numpy().view(np.uint64), _matrix(table["x"].combine_chunks())
        order = np.lexsort((*x.T, own))[:points]
        tree = key[0].as_py()
        feature, split, child, length = grow_tree(x[order], box, depth, np.random.default_rng([seed, tree]))
        return pa.table({"tree": pa.array([tree], pa.int32()), "feature": [feature], "split": [split], "less": [[c[0] for c in child]], "more": [[c[1] for c in child]], "length": [length]})

    dealt = rows.where("grown").select("h", "x").mapInArrow(K.tidy(deal), "tree int, own long, x array<double>")
    found = dealt.groupBy("tree").applyInArrow(K.tidy_group(grow), "tree int, feature array<long>, split array<double>, less array<long>, more array<long>, length array<double>").collect()
    return IsolationForest.of([(t.feature, t.split, list(zip(t.less, t.more, strict=True)), t.length) for t in sorted(found, key=lambda t: t.tree)])


def _threshold(rows: DataFrame, forest: IsolationForest, cost: float = COST) -> float:
    """What ``IsolationForest.calibrate`` finds, over all rows that may not grow trees: sums along their sorted paths."""

    def walk(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.path_length(_matrix(batch.column(1))))], names=["clean", "path"])

    rest = rows.where("NOT grown").select("clean", "x").mapInArrow(K.tidy(walk), "clean boolean, path double")
    steps = rest.groupBy("path").agg(F.count_if("clean").alias("good"), F.count_if(~F.col("clean")).alias("bad"))
    steps, good = running_sum(steps, [F.col("path")], "good", "good_before")
    steps, bad = running_sum(steps, [F.col("path")], "bad", "bad_before")
    if not good or not bad:
        return -np.inf
    gain = (F.col("bad_before") + F.col("bad")) / bad - cost * (F.col("good_before") + F.col("good")) / good
    best = steps.select("path", gain.alias("gain")).orderBy(F.desc("gain"), "path").first()
    if best.gain <= 0:
        return -np.inf
    after = steps.where(F.col("path") > best.path).agg(F.min("path")).first()[0]
    return float((best.path + (after if after is not None else best.path + 1)) / 2)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base statistics and a verdict for each row of ``docs``.

    ``base_failed``: fewer than 10 words, or more than a fifth of them in repeated 5-word windows.
    ``kept``: neither ``base_failed`` nor of a ``path_length`` under the forest's threshold. A null
    or empty text has zero counts and fails. Without labels of both kinds every document that
    passes the base rules is kept. Repeated rows and null ids each get their row, equal texts the same
    verdict; texts of any length are read whole, once; an empty table gives no rows; other columns are ignored.
    """
    statistics = materialize(counted(docs), "rules-counted")
    forest = fit_counted(statistics, labels)

    def judge(batches):
        for batch in batches:
            path = forest.path_length(_matrix(batch.column(7)))
            kept = ~batch.column(6).to_numpy(zero_copy_only=False) & (path >= forest.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(kept), pa.array(path)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return statistics.mapInArrow(K.tidy(judge), SCHEMA)


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns; no text is shuffled."""
    forest = fit(docs, labels)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            c = docstats.batch_counts(batch.column(at))
            yield batch.filter(pa.array(~base_failed(c) & (forest.path_length(docstats.rates(c)) >= forest.threshold)))

    return docs.mapInArrow(K.tidy(keep), docs.schema)
