"""Connected components of a distributed graph; only a count of changes reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize

#: Edges that a task holds at once to contract them.
HELD = 1 << 20


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges with the least node of its component among them."""
    node, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = place[: u.size], place[u.size :], np.arange(node.size)
    while True:
        was = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(label, side, least)
            np.minimum.at(label, was[side], least)
        label = label[label]
        if (label == was).all():
            return node, node[label]


def _contract(batches):
    """Edges of a task as stars around the least node of each component among them."""
    held: list[pa.RecordBatch] = []

    def stars():
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        node, root = _least(u, v)
        apart = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(root[apart])], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield stars()
            held = []
    if held:
        yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)`` with another one; the label is the component's least node.

    Each task first contracts its own edges to stars, and then the stars that meet at its nodes, so
    that a component has few more edges than nodes however many there were. Then each round takes the least label among
    a node's neighbours (combined before the shuffle, so that a hub costs one row a task) and lets
    every node take its label's own label, which halves the remaining paths. Rounds are written to
    the shared folder.
    """
    ends = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    few = ends.mapInArrow(_contract, "u long, v long").repartition("u").mapInArrow(_contract, "u long, v long")
    both = few.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    arcs = materialize(both.distinct(), "arcs")
    labels = materialize(arcs.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        least = arcs.join(labels.select("node", "label"), F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        stepped = labels.select("node", "label").join(least, F.col("node") == F.col("u")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        stepped = materialize(stepped, "stepped")
        up = stepped.select(F.col("node").alias("up"), F.col("label").alias("upper"))
        jumped = stepped.join(up, stepped.label == up.up, "left").select("node", "was", F.least("label", "upper").alias("label"))
        jumped = materialize(jumped, "jumped")
        changed = jumped.where("label <> was").limit(1).count()
        discard(labels, stepped)
        labels = jumped
        if not changed:
            discard(arcs)
            return labels.select("node", "label")
