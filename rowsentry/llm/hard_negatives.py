"""Hard negatives: for each anchor and each of its positives, the best rows of other labels within a score window.

Rows are dealt to parts by a hash, each part gets a ball tree, written once. Anchors come in blocks
of a bounded size, and each block goes down each part's tree: first for the best rows of its own
label, then, with the windows that these give, for the best of the others. What the parts find is
ranked by the anchor; a part gives no more than the wanted number for each query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .ball_tree import BallTree
from .store import batches_of, discard, materialize

#: Rows of a part, at least and at most; between them there are ``PARTS``. Anchors of a block, on average.
LEAST_ROWS, MOST_ROWS, PARTS, BLOCK = 2048, 65_536, 64, 4096
#: Joined rows of a tree and a block that a worker gets at once.
AT_ONCE = 4
_TREE = [f.name for f in BallTree.__dataclass_fields__.values()]


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, q, copies``: the rows that take part, labels moved where 7 divides the id, components as floor(256 x)."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("q"))
    return rows.groupBy("vec_id", "label", "q").agg(F.count(F.lit(1)).alias("copies"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in zeros."""
    size = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out


def build_trees(vectors: DataFrame, parts: int, width: int, copies: int) -> DataFrame:
    """A row for each part: its ball tree. A row that stands in the table n times is there min(n, ``copies``) times."""

    def build(key, table):
        table = table.combine_chunks()
        times = np.minimum(table.column("copies").to_numpy(), copies)
        rows = np.repeat(_matrix(table.column("q").chunk(0), width), times, axis=0)
        tree = BallTree.build(rows, np.repeat(table.column("vec_id").to_numpy(), times), np.repeat(table.column("label").to_numpy(), times))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), **{n: pa.array([b], pa.binary()) for n, b in tree.to_bytes().items()}})

    part = F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(parts)).cast("long")
    schema = "part long, " + ", ".join(f"{n} binary" for n in _TREE)
    return materialize(vectors.withColumn("part", part).groupBy("part").applyInArrow(K.tidy_group(build), schema), "trees")


def _dealt(blocks: DataFrame, trees: DataFrame, parts: int) -> DataFrame:
    """Each block of anchors beside each part's tree. Spark takes the blocks for as small as they are before they are
    repeated for the parts, so it has to be told that neither side goes through the driver."""
    each = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return each.hint("merge").join(trees, "part").select("anchors", *_TREE)


def _down_all(blocks: DataFrame, trees: DataFrame, parts: int, search, schema: str, tag: str) -> DataFrame:
    """What ``search`` finds for each block of anchors in each part's tree."""
    with batches_of(blocks.sparkSession, AT_ONCE):
        return materialize(_dealt(blocks, trees, parts).mapInArrow(K.tidy(search), schema), tag)


def _blocks(anchors: DataFrame, count: int) -> DataFrame:
    block = F.pmod(F.xxhash64("mark", F.lit(13)), F.lit(max(1, math.ceil(count / BLOCK))))
    return anchors.groupBy(block.alias("block")).agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors")).select("anchors")


def _loads(batches, width: int):
    """Each block of anchors and the tree that it goes down."""
    for batch in batches:
        for k in range(batch.num_rows):
            anchors = batch.column("anchors").slice(k, 1).flatten()
            tree = BallTree.from_bytes({n: batch.column(n)[k].as_py() for n in _TREE}, width)
            yield pa.RecordBatch.from_struct_array(anchors), tree


def mine(embeddings: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, exact.

    Anchors are the rows whose id ``anchor_every`` divides. The positives of an anchor are its best rows of
    the same label and other ids; the negatives of a positive the best rows of other labels whose scores
    are ``least`` to ``most`` hundredths of the positive's. Scores are inner products of whole numbers, the
    greater first, then the smaller id. Rows without id, label or vector, or with a component that is
    null, NaN or infinite, take no part. A shorter vector counts as followed by zeros. Repeated rows
    each take their place as positives and negatives; an anchor that is repeated is one, rows with its
    id and another label or vector are anchors of their own. Where no row fits there is none; an empty
    table gives none; other columns are ignored.
    """
    vectors = materialize(whole_vectors(embeddings), "vectors")
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.greatest(F.max(F.size("q")), F.lit(1)), F.lit(1))).first()
    parts = max(1, math.ceil(n / min(MOST_ROWS, max(LEAST_ROWS, n // PARTS))))
    trees = build_trees(vectors, parts, width, max(positives, negatives))
    anchors = vectors.where(F.col("vec_id") % anchor_every == 0).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("vec_id", "label", "q").alias("mark"), "label", "q")
    count = anchors.count()

    def nearest(batches):
        for block, tree in _loads(batches, width):
            owner = np.arange(block.num_rows)
            open_low, open_high = np.full(owner.size, np.iinfo(np.int64).min), np.full(owner.size, np.iinfo(np.int64).max)
            query, row, score = tree.best(_matrix(block.column("q"), width), block.column("anchor_id").to_numpy(), block.column("label").to_numpy(), owner, open_low, open_high, positives, True)
            yield pa.RecordBatch.from_arrays([block.column("anchor_id").take(pa.array(query)), block.column("mark").take(pa.array(query)), pa.array(tree.ids[row]), pa.array(score, pa.int64())], names=["anchor_id", "mark", "positive_id", "positive_score"])

    found = _down_all(_blocks(anchors, count), trees, parts, nearest, "anchor_id long, mark long, positive_id long, positive_score long", "positives")
    place = F.row_number().over(Window.partitionBy("anchor_id", "mark").orderBy(F.col("positive_score").desc(), "positive_id"))
    best = found.withColumn("place", place).where(F.col("place") <= positives)
    windows = best.groupBy("anchor_id", "mark").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))

    def windowed(batches):
        for block, tree in _loads(batches, width):
            listed = block.column("positives")
            each = pa.RecordBatch.from_struct_array(listed.flatten())
            owner = np.repeat(np.arange(block.num_rows), listed.value_lengths().to_numpy())
            scores = [int(s) for s in each.column("positive_score").to_pylist()]
            low, high = np.array([-(-least * s // 100) for s in scores], np.int64), np.array([most * s // 100 for s in scores], np.int64)
            query, row, score = tree.best(_matrix(block.column("q"), width), block.column("anchor_id").to_numpy(), block.column("label").to_numpy(), owner, low, high, negatives, False)
            of, at = pa.array(owner[query]), pa.array(query)
            yield pa.RecordBatch.from_arrays(
                [block.column("anchor_id").take(of), block.column("mark").take(of), *(each.column(c).take(at) for c in ("place", "positive_id", "positive_score")), pa.array(tree.ids[row]), pa.array(score, pa.int64())],
                names=["anchor_id", "mark", "place", "positive_id", "positive_score", "negative_id", "negative_score"],
            )

    asked = anchors.join(windows, ["anchor_id", "mark"])
    schema = "anchor_id long, mark long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
    tops, found = found, _down_all(_blocks(asked, count), trees, parts, windowed, schema, "negatives")
    discard(tops, trees, vectors)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "mark", "place").orderBy(F.col("negative_score").desc(), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB SQL for the rows of ``mine`` where no id repeats and all vectors are of one length.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
"""
