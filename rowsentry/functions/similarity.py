"""Similarity of texts, and bounds that spare the costly ones. A bound never changes a result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import WS, collapse_ws


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def levenshtein_at_least(a: Column, b: Column, threshold: float) -> Column:
    """Whether the similarity reaches the threshold; no distance is followed beyond the most edits that this allows."""
    longest = F.greatest(F.length(a), F.length(b))
    cut = F.floor(longest * (1 - threshold) + 1e-9).cast("int")
    edits = F.pmod(F.call_function("levenshtein", a, b, cut), F.lit(2**31 - 1))  # -1, which stands for more, as a large number
    near = (F.abs(F.length(a) - F.length(b)) <= cut) & (1 - edits / longest >= threshold)
    return F.when(longest == 0, F.lit(True)).otherwise(near)


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest for each of the first four equal characters, always."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, f in zip(b, free, strict=True) if not f]
    m = len(mine)
    swapped = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Texts of more characters are compared one pair at a time; pairs that are compared together.
WIDE, TOGETHER = 64, 4096


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler_text`` of many pairs: all pairs take each step of the matching together."""
    out = np.empty(len(a))
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    for k in np.flatnonzero(size > WIDE).tolist():
        out[k] = jaro_winkler_text(a[k], b[k])
    order = np.argsort(size, kind="stable")
    order = order[size[order] <= WIDE]
    for k in range(0, order.size, TOGETHER):
        part = order[k : k + TOGETHER]
        out[part] = _together([a[i] for i in part.tolist()], [b[i] for i in part.tolist()])
    return out


def _letters(texts: list[str], blank: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array(list(map(len, texts)), np.int64)
    grid = np.full((len(texts), max(1, int(size.max(initial=0)))), blank, np.int64)
    grid[np.arange(grid.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return grid, size


def _together(a: list[str], b: list[str]) -> np.ndarray:
    (x, la), (y, lb) = _letters(a, -1), _letters(b, -2)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free, mine = y >= 0, np.zeros(x.shape, bool)
    widest = int(reach.max(initial=0))
    for i in range(x.shape[1]):
        hit = np.zeros(len(a), bool)
        for j in range(max(0, i - widest), min(y.shape[1], i + widest + 1)):
            ok = free[:, j] & ~hit & (y[:, j] == x[:, i]) & (reach >= abs(i - j))
            free[:, j] ^= ok
            hit |= ok
        mine[:, i] = hit
    m = mine.sum(1)
    theirs = (y >= 0) & ~free
    front = lambda grid, taken: np.take_along_axis(grid, np.argsort(~taken, axis=1, kind="stable"), 1)
    both = min(x.shape[1], y.shape[1])
    swapped = ((front(x, mine)[:, :both] != front(y, theirs)[:, :both]) & (np.arange(both) < m[:, None])).sum(1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / la + m / lb + (m - swapped) / m) / 3
    head = min(4, both)
    prefix = np.cumprod(x[:, :head] == y[:, :head], axis=1).sum(1)
    found = np.where(m > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0)
    return np.where([p == q for p, q in zip(a, b, strict=True)], 1.0, found)


def jaro_winkler_grid(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler_text`` of each of ``a`` with each of ``b``. The fewer lengths there are, the more pairs take a step together."""
    out = np.empty((len(a), len(b)))
    sizes = [np.array(list(map(len, texts)), np.int64) for texts in (a, b)]
    for m in np.unique(sizes[0]).tolist():
        own = np.flatnonzero(sizes[0] == m)
        for n in np.unique(sizes[1]).tolist():
            other = np.flatnonzero(sizes[1] == n)
            part = _grid([a[i] for i in own.tolist()], [b[i] for i in other.tolist()], m, n)
            if part.shape == out.shape:
                return part
            out[np.ix_(own, other)] = part
    return out


def _grid(a: list[str], b: list[str], m: int, n: int) -> np.ndarray:
    """The grid of texts of ``m`` and of ``n`` letters: free letters of the right side are bits of a word.

    A beginning that all texts share matches itself, whatever follows, so the words hold what is behind it.
    """
    if not m or not n:
        return np.full((len(a), len(b)), float(m == n))
    x, y = (_letters(texts, 0)[0] for texts in (a, b))
    p = 0
    while p < min(m, n) and (x[:, p] == x[0, p]).all() and (y[:, p] == x[0, p]).all():
        p += 1
    rest, bits, reach = m - p, n - p, max(max(m, n) // 2 - 1, 0)
    if max(rest, bits) > WIDE:
        return np.stack([jaro_winkler_many([text] * len(b), b) for text in a])
    word = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if bits <= np.dtype(t).itemsize * 8)
    mine, theirs = x[:, p:], y[:, p:]
    if max(mine.max(initial=0), theirs.max(initial=0)) < 256:
        letters = 256
    else:
        known, code = np.unique(np.concatenate([mine.ravel(), theirs.ravel()]), return_inverse=True)
        mine, theirs, letters = code[: mine.size].reshape(mine.shape), code[mine.size :].reshape(theirs.shape), known.size
    at = np.zeros((letters, len(b)), word)  # where a letter stands in each text of the right side
    for j in range(bits):
        at[theirs[:, j], np.arange(len(b))] |= word(1 << j)
    shape, one = (len(a), len(b)), word(1)
    first, other, hits = np.empty(shape, word), np.empty(shape, word), np.empty((rest, *shape), bool)
    free, matched, swapped = np.full(shape, np.iinfo(word).max, word), np.zeros(shape, np.uint8), np.zeros(shape, np.uint8)
    for i in range(rest):
        low, high = max(0, i - reach), min(bits, i + reach + 1)
        at.take(mine[:, i], 0, first, "clip")
        first &= word(((1 << high) - (1 << low)) if high > low else 0)
        first &= free
        np.invert(first, out=other)
        other += one
        first &= other  # the first free one
        free ^= first
        np.not_equal(first, 0, out=hits[i])
        matched += hits[i].view(np.uint8)
    taken = np.invert(free, out=free)
    for i in range(rest):
        np.invert(taken, out=first)
        first += one
        first &= taken
        first *= hits[i].view(np.uint8)
        taken ^= first
        at.take(mine[:, i], 0, other, "clip")
        other &= first
        hits[i] &= other == 0
        swapped += hits[i].view(np.uint8)
    place = matched.astype(np.uint16)
    place *= WIDE + 1
    place += swapped
    known, head = np.zeros((min(rest, bits) + 1, WIDE + 1, 5)), min(4, m, n)
    for k in range(known.shape[0]):
        for s in range(k + 1 if p + k else 0):
            jaro = ((p + k) / m + (p + k) / n + (p + k - s / 2) / (p + k)) / 3
            for h in range(min(p, head), head + 1):
                known[k, s, h] = jaro + h * 0.1 * (1 - jaro)
    if p >= head:
        return known[:, :, head].ravel().take(place.astype(np.intp), mode="clip")
    alike, prefix = np.ones(shape, bool), np.full(shape, p, np.uint8)
    for k in range(p, head):
        alike &= x[:, k, None] == y[None, :, k]
        prefix += alike.view(np.uint8)
    place *= 5
    place += prefix
    return known.ravel().take(place.astype(np.intp), mode="clip")


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winkler_many(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")


def jaro_winkler_bound(a: Column, b: Column) -> Column:
    """No pair of these lengths and this common prefix can be more similar."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    jaro = F.when(longer == 0, 1.0).when(shorter == 0, 0.0).otherwise((2 + shorter / longer) / 3)
    prefix = F.lit(0)
    for k in range(1, 5):
        prefix = F.when((shorter >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k)), k).otherwise(prefix)
    return jaro + prefix * 0.1 * (1 - jaro)


def word_set(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_except(F.array_distinct(F.split(collapse_ws(text), f"[{WS}]")), F.array(F.lit("")))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared elements of all; two empty sets are equal."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(word_set(a), word_set(b))


def similarity(algorithm: str, a: Column, b: Column) -> Column:
    return {"levenshtein": levenshtein_similarity, "token_jaccard": token_jaccard}.get(algorithm, jaro_winkler)(a, b)


def may_reach(algorithm: str, a: Column, b: Column, threshold: float) -> Column:
    """A cheap condition that all pairs at the threshold meet."""
    if algorithm == "levenshtein":
        return levenshtein_at_least(a, b, threshold)
    return jaro_winkler_bound(a, b) >= threshold - 1e-12


def reaches(algorithm: str, a: Column, b: Column, threshold: float) -> Column:
    return similarity(algorithm, a, b) >= threshold
