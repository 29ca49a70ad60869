"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled rows that a classifier is fitted on.
MAX_ROWS = 6000


def fold(id_col: str, modulus: int) -> Column:
    """The fold of a row: crc32 of its id as text; null ids are in no fold."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def agreed(labels: DataFrame, label: str, where: Column | None = None) -> DataFrame:
    """``(doc_id, label)`` of all ids with one label, 0 or 1; an id with two different labels is left out."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        ids = ids.where(where)
    return ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"), F.max(label).alias("other")).where("label = other").drop("other")


def sample(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``max_rows`` rows with a labelled id, chosen by a hash of the id.

    An id with two different labels is left out; a label other than 0 and 1 doesn't count. Where
    ``docs`` repeats an id all its rows come, or none if there are too many of them.
    """
    ids = agreed(labels, label, where)
    # only rows with a label are counted; copies of one id meet as counts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(ids, "doc_id")
    ids = rows.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") <= max_rows)
    chosen, total = [], 0
    for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect():
        if total + r["rows"] <= max_rows:
            chosen.append((r.doc_id, r.label))
            total += r["rows"]
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
