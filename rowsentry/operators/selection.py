"""Exact order statistics of a column by repeated range counting.

Each pass counts the values below, at and between two pivots that an approximate percentile puts
close around the wanted ranks; what is left between them is a small part of what was left before.
A task holds counters and a sketch, never the values; the driver gets the last ``HELD`` at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that may be left at the end; counters of the sketch, whose error is that part of the values looked at.
HELD, ACCURACY = 1 << 16, 2000


def order_statistics(values: DataFrame, ranks: Sequence[int], column: str = "x", held: int | None = None, n: int | None = None) -> dict[int, float]:
    """The values (doubles, no null, no NaN) at ranks from 0 in ascending order, of ``n`` values if their number is known."""
    out: dict[int, float] = {}
    held = HELD if held is None else held
    n = values.count() if n is None else n
    todo = [(-math.inf, math.inf, 0, n, sorted(set(ranks)))] if ranks else []
    while todo:
        low, high, below, inside, wanted = todo.pop()
        x = F.col(column)
        part = values.where((x >= low) & (x <= high))
        if inside <= held:
            found = sorted(r[0] for r in part.select(column).collect())
            out |= {r: found[r - below] for r in wanted}
            continue
        share = [max(0.0, (wanted[0] - below) / inside - 1 / ACCURACY), min(1.0, (wanted[-1] - below + 1) / inside + 1 / ACCURACY)]
        a, b = part.agg(F.percentile_approx(column, share, F.lit(ACCURACY))).first()[0]
        parts = [x < a, x == a, (x > a) & (x < b), (x == b) & (F.lit(b) > a), x > b]
        counts = part.agg(*[F.count_if(p) for p in parts]).first()
        bounds = [(low, math.nextafter(a, -math.inf)), (a, a), (math.nextafter(a, math.inf), math.nextafter(b, -math.inf)), (b, b), (math.nextafter(b, math.inf), high)]
        at = below
        for (lo, hi), k in zip(bounds, counts, strict=True):
            own = [r for r in wanted if at <= r < at + k]
            if own and lo == hi:
                out |= dict.fromkeys(own, lo)
            elif own:
                todo.append((lo, hi, at, k, own))
            at += k
    return out


def exact_median(values: DataFrame, column: str = "x", held: int | None = None) -> tuple[float | None, int]:
    """The median, halfway between the two middle values of an even number, and how many values there are."""
    n = values.count()
    if not n:
        return None, 0
    found = order_statistics(values, [(n - 1) // 2, n // 2], column, held, n)
    return (found[(n - 1) // 2] + found[n // 2]) / 2, n
