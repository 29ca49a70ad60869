"""Places of rows in a sorted order, without a window over a whole table or group.

Rows are dealt to ranges of the order and sorted there; a row's place is its place in its range and
the number of rows in the ranges before. The driver sees a count for each range, whose number is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import discard, materialize

#: Rows of a range, and the most ranges; beyond, ranges get longer.
RANGE_ROWS, MOST_RANGES = 1 << 15, 20_000
_SHIFT = 33


def _ranged(df: DataFrame, keys: Sequence[Column], range_rows: int | None) -> DataFrame:
    """``df`` dealt to ranges of ``keys`` and sorted, with ``_part`` and ``_pos`` in it, written to the shared folder."""
    kept = materialize(df.withColumn("_tie", F.monotonically_increasing_id()), "unordered")
    total = kept.count()
    ranges = max(1, math.ceil(total / max(range_rows or RANGE_ROWS, total / MOST_RANGES)))
    keys = [*keys, F.col("_tie")]
    ranged = materialize(kept.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_n", F.monotonically_increasing_id()), "ranges")
    discard(kept)
    return ranged.select("*", F.shiftright("_n", _SHIFT).alias("_part"), F.col("_n").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("_pos"))


def numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), at: str = "_at", of: str = "_of", range_rows: int | None = None) -> DataFrame:
    """``df`` with the place of each row, from 0, in ``order`` among the rows of equal ``by``, and their number.

    Rows that ``order`` doesn't tell apart follow each other in any order, once and for all: the result
    is written to the shared folder. Nulls of ``by`` are equal to each other. However many rows share a
    group or a key, they are dealt to several ranges.
    """
    spark = df.sparkSession
    ranged = _ranged(df, [*(F.col(c).asc_nulls_first() for c in by), *order], range_rows)
    counts = ranged.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_first"))
    if by:
        group = Window.partitionBy(*by)
        before = F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        shifts = counts.select("_part", *by, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias(of))
        shifts = materialize(shifts, "shifts")  # Spark sees its size and broadcasts it if it is small
    else:
        rows, done = [], 0
        found = sorted(counts.collect())
        total = sum(r["_rows"] for r in found)
        for r in found:
            rows.append((r["_part"], done - r["_first"], total))
            done += r["_rows"]
        shifts = spark.createDataFrame(rows, f"_part long, _shift long, `{of}` long")
    same = ranged["_part"] == shifts["_part"]
    for c in by:
        same = same & ranged[c].eqNullSafe(shifts[c])
    return ranged.join(shifts, same).select(*[ranged[c] for c in df.columns], (ranged["_pos"] + shifts["_shift"]).alias(at), shifts[of])


def running_sum(df: DataFrame, order: Sequence[Column], value: str, before: str, range_rows: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with the sum of a column of whole numbers over the rows before each in ``order``, and the sum over all."""
    ranged = _ranged(df, order, range_rows)
    rows, done = [], 0
    for r in sorted(ranged.groupBy("_part").agg(F.sum(value).alias("sum")).collect()):
        rows.append((r["_part"], done))
        done += r["sum"] or 0
    inner = F.sum(value).over(Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1))
    shifts = F.broadcast(df.sparkSession.createDataFrame(rows, "_part long, _shift long"))  # a row for each range
    return ranged.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(shifts, "_part").select(*df.columns, (F.col("_inner") + F.col("_shift")).alias(before)), done


def page(rows: DataFrame, offset: int, limit: int, at: str = "_at") -> DataFrame:
    """The rows of a numbered table from a place on, in order; found by their places, nothing before them is sorted."""
    return rows.where(F.col(at).between(offset, offset + limit - 1)).orderBy(at)
