"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms within a band of document frequency over the whole corpus. A
document's distinct lexicon terms, sorted, are hashed once for each of several random subsets of
the lexicon; subsets of different density suit documents of different length. The likeness of two
fingerprints is the share of equal hashes among the subsets that hold a term of either.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import materialize, small_batches, text_volume

U = np.uint64
#: The band: terms in at least this and at most that share of the documents, and in two at least.
#: So the lexicon has at most 1 / LEAST_SHARE terms for each distinct term of a mean document,
#: however many documents there are; it goes to the driver and into the tasks.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.2
#: Densities of the random subsets, and subsets of each.
DENSITIES, EACH = (1.0, 1 / 16, 1 / 64, 1 / 256, 1 / 1024), (1, 4, 12, 16, 12)
#: Bytes of text in a range of neighbours, at least, and ranges at most.
RANGE_BYTES, MOST_RANGES = 16 << 20, 200_000
#: Terms that a task holds before it counts them.
FLUSH = 2_000_000


@dataclass
class Lexicon:
    terms: np.ndarray
    limits: np.ndarray
    salts: np.ndarray

    @classmethod
    def of(cls, terms: np.ndarray, seed: int = 17) -> Lexicon:
        rng = np.random.default_rng(seed)
        density = np.repeat(DENSITIES, EACH)
        limits = np.array([min(int(d * 2**64), 2**64 - 1) for d in density], dtype=U)
        return cls(np.sort(terms.astype(U)), limits, rng.integers(1, 2**63, size=len(limits), dtype=np.int64).astype(U))

    def hashes(self, terms: np.ndarray) -> np.ndarray:
        """A hash for each subset of the sorted distinct terms; 0 where the subset has none of them."""
        if not terms.size or not self.terms.size:
            return np.zeros(len(self.salts), dtype=U)
        at = np.minimum(np.searchsorted(self.terms, terms), self.terms.size - 1)
        own = terms[self.terms[at] == terms]
        if not own.size:
            return np.zeros(len(self.salts), dtype=U)
        draw = K.mix(own[:, None] ^ self.salts[None, :])
        chosen = draw <= self.limits[None, :]
        total = np.where(chosen, K.mix(draw + U(1)), U(0)).sum(axis=0, dtype=U)
        return np.where(chosen.any(axis=0), K.mix(total) | U(1), U(0))


def terms_of(chunk: K.Chunk) -> list[np.ndarray]:
    """The sorted distinct terms (hashes of lower-cased words) of each row."""
    low = chunk.lower()
    start, end, first = low.words()
    h = low.hashes(start, end)
    return [np.unique(h[first[i] : first[i + 1]]) for i in range(chunk.n)]


def fingerprints(texts: list[str], lexicon: Lexicon) -> list[tuple[str, np.ndarray]]:
    """The fingerprint of each text as a string, and its hashes."""
    out = []
    for chunk in K.chunks(pa.array(texts, pa.string())):
        for i, terms in enumerate(terms_of(chunk)):
            h = lexicon.hashes(terms)
            if h.any():
                out.append(("-".join(f"{int(x) >> 32:x}" for x in h), h))
            else:  # no term of the lexicon: the whole text stands for itself
                out.append(("t" + hashlib.sha256(texts[chunk.first + i].encode("utf-8", "replace")).hexdigest()[:32], h))
    return out


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    if a[0] == b[0]:
        return 1.0
    either = (a[1] != 0) | (b[1] != 0)
    return float(((a[1] == b[1]) & either).sum() / either.sum()) if either.any() else 0.0


def _count(batches):
    """Documents that hold each term, combined within the task; term 0 counts the documents."""
    held: list[np.ndarray] = []
    size = docs = 0

    def flush():
        term, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    for batch in batches:
        for chunk in K.chunks(batch.column(0)):
            for terms in terms_of(chunk):
                held.append(terms)
                size += terms.size
                docs += 1
        if size > FLUSH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["term", "n"])


def build_lexicon(docs: DataFrame) -> Lexicon:
    """The terms within the band, counted over all documents."""
    counts = materialize(docs.select("text").mapInArrow(K.tidy(_count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    n = counts.where("term = 0").first()
    if n is None or not n.n:
        return Lexicon.of(np.zeros(0, U))
    least = max(2, math.ceil(n.n * LEAST_SHARE))
    band = counts.where((F.col("term") != 0) & F.col("n").between(least, max(least, math.floor(n.n * MOST_SHARE)))).select("term")
    return Lexicon.of(band.toPandas()["term"].to_numpy(np.int64).view(np.uint64))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all rows of ``docs`` and of their edited texts.

    The edited text has its last third (floor of n_chars / 3 code points) replaced by as many first
    code points of the next document, in descending order of ``doc_id``; the first follows the last.
    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. A null text is empty. Null ids come last; equal ids are ordered by their texts'
    hashes, and rows that share both may stand for each other. A text without a lexicon term has a
    fingerprint of its own text, like nothing but itself. Texts of any length are taken whole. Other
    columns are ignored, whatever their names; an empty table gives no rows.

    The documents are dealt to ranges of neighbours in that order and each range is read as a
    stream; only the first and the last document of a range meet across ranges.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lexicon = build_lexicon(docs)
    volume = text_volume(docs)
    ranges = max(1, math.ceil(volume / max(RANGE_BYTES, volume / MOST_RANGES)))
    # equal rows are spread by their number; they may stand for each other
    keyed = docs.withColumn("tie", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), F.col("n")]
    dealt = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        """Neighbours within a range; the first and the last document of a range come with their texts."""
        part, pending = TaskContext.get().partitionId(), None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            prints = fingerprints(texts, lexicon)
            rows = list(zip(ids, texts, prints, strict=True))
            if pending is None:
                yield _edge(part, 1, ids[0], texts[0])
            else:
                rows = [pending, *rows]
            pending = rows[-1]
            yield _results(rows, lexicon)
        if pending is not None:
            yield _edge(part, 2, pending[0], pending[1])

    found = materialize(dealt.mapInArrow(K.tidy(run), _SCHEMA + ", part int, edge int, text string"), "neighbours")
    edges = found.where("edge > 0").select("part", "edge", "doc_id", "text")
    # a row for each range at the driver, of its number
    full = sorted(r.part for r in edges.where("edge = 1").select("part").collect())
    after = spark.createDataFrame(list(zip(full, full[1:] + full[:1], strict=True)), "part int, following int")
    lead = edges.where("edge = 1").select(F.col("part").alias("following"), F.col("text").alias("follower"))
    pairs = edges.where("edge = 2").join(after, "part").join(lead, "following").select("doc_id", "text", "follower")

    def close(batches):
        for batch in batches:
            for doc, text, follower in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prints = fingerprints([text, follower], lexicon)
                yield _results([(doc, text, prints[0]), (None, follower, prints[1])], lexicon).select(range(7))

    return found.where("edge = 0").drop("part", "edge", "text").union(pairs.mapInArrow(K.tidy(close), _SCHEMA))


def _results(rows: list[tuple], lexicon: Lexicon) -> pa.RecordBatch:
    """The results of all but the last of some neighbours (id, text, fingerprint)."""
    own, n = rows[:-1], range(len(rows) - 1)
    edited = [t[: len(t) - len(t) // 3] + rows[k + 1][1][: len(t) // 3] for k, (_, t, _) in enumerate(own)]
    changed = fingerprints(edited, lexicon)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in own], pa.int64()), pa.array([len(r[1]) for r in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited], pa.string()),
            pa.array([r[2][0] for r in own], pa.string()), pa.array([c[0] for c in changed], pa.string()),
            pa.array([likeness(own[k][2], changed[k]) for k in n], pa.float64()), pa.array([likeness(rows[k][2], rows[k + 1][2]) for k in n], pa.float64()),
            pa.nulls(len(own), pa.int32()), pa.array([0] * len(own), pa.int32()), pa.nulls(len(own), pa.string()),
        ],
        names=_NAMES,
    )


def _edge(part: int, edge: int, doc, text: str) -> pa.RecordBatch:
    values = [[doc], [None], [None], [None], [None], [None], [None], [part], [edge], [text]]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=_NAMES)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")] + ["part", "edge", "text"]
