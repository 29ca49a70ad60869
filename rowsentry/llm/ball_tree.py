"""Ball trees over whole-number vectors: exact best inner products within windows, for many queries at once.

A ball holds its rows' mean and the greatest distance from it, so the inner products of a query
with its rows lie within |q| times that distance of the one with the mean, above and below. A ball is passed over
by a query if its rows are of the wrong label, if all lie outside the query's window, or if none
reaches the least score that the query has kept so far; equal ones are still looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rows of a leaf.
LEAF = 128
#: Queries that go down a tree together.
TOGETHER = 1024
#: Scores up to here are exact as doubles, and with a rank below as 64-bit numbers.
EXACT = 1 << 53
_NONE = np.iinfo(np.int64).min


@dataclass
class BallTree:
    """``rows`` in the order of the leaves, with ``ids`` and ``labels``; balls as arrays, children behind their parent."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    label: np.ndarray  # the one label of a ball's rows, or -1 with ``mixed``
    mixed: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> BallTree:
        """First by label, then at the median of the coordinate that varies most, down to ``leaf`` rows."""
        order = np.argsort(labels, kind="stable")
        begin, end, left, right, centre, radius, own, mixed = [], [], [], [], [], [], [], []
        data = rows.astype(np.float64)
        todo = [(0, len(order), -1, False)]
        while todo:
            lo, hi, parent, is_right = todo.pop()
            me = len(begin)
            if parent >= 0:
                (right if is_right else left)[parent] = me
            part = data[order[lo:hi]]
            mean = part.mean(0)
            begin.append(lo), end.append(hi), left.append(-1), right.append(-1), centre.append(mean)
            radius.append(float(np.sqrt(((part - mean) ** 2).sum(1).max())))
            kinds = labels[order[[lo, hi - 1]]]
            if lo == 0 and hi == len(order) or parent >= 0 and mixed[parent]:
                same = bool((labels[order[lo:hi]] == kinds[0]).all())
            else:
                same = True
            own.append(kinds[0] if same else -1), mixed.append(not same)
            if not same:
                # between two labels, the one nearest to the middle
                sorted_labels = labels[order[lo:hi]]
                cuts = np.flatnonzero(np.diff(sorted_labels)) + 1
                cut = lo + int(cuts[np.argmin(np.abs(cuts - (hi - lo) / 2))])
            elif hi - lo > leaf:
                axis = int(part.var(0).argmax())
                order[lo:hi] = order[lo:hi][np.argsort(part[:, axis], kind="stable")]
                cut = (lo + hi) // 2
            else:
                continue
            todo += [(cut, hi, me, True), (lo, cut, me, False)]
        as_int = lambda x: np.array(x, np.int32)
        return cls(rows[order], ids[order], labels[order], as_int(begin), as_int(end), as_int(left), as_int(right), np.array(centre), np.array(radius), np.array(own, np.int64), np.array(mixed))

    def best(self, anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ``k`` rows of each query, as (query, row, score) without order.

        Query i belongs to anchor ``owner[i]`` and takes rows of the anchor's label with other ids
        (``same``) or rows of other labels, with scores from ``low[i]`` to ``high[i]``; the best scores come
        first, of equal ones the smaller ids.
        """
        out = []
        by_id = np.argsort(self.ids, kind="stable")
        rank = np.empty(len(by_id), np.int64)
        rank[by_id] = np.arange(len(by_id))
        for a in range(0, len(owner), TOGETHER):
            part = slice(a, a + TOGETHER)
            query, row, score = self._together(anchors, anchor_ids, anchor_labels, owner[part], low[part], high[part], k, same, rank, by_id)
            out.append((query + a, row, score))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def _together(self, anchors, anchor_ids, anchor_labels, owner, low, high, k, same, rank, by_id):
        used, local = np.unique(owner, return_inverse=True)
        wide = int(np.abs(anchors[used]).sum(1).max(initial=0)) * int(np.abs(self.rows).max(initial=0)) >= EXACT
        kind = object if wide else np.float64
        vectors = anchors[used].astype(kind)
        data = self.rows.astype(kind)
        ids, labels = anchor_ids[used], anchor_labels[used]
        points = anchors[used].astype(np.float64)
        norm = np.sqrt((points**2).sum(1))
        middle = points @ self.centre.T
        reach = norm[:, None] * self.radius[None, :]
        # what rounding of the bounds themselves may hide
        slack = 1e-9 * (np.abs(middle) + reach + norm[:, None] * np.sqrt((self.centre**2).sum(1))[None, :]) + 1e-6
        upper, lower = middle + reach + slack, middle - reach - slack
        # a kept row is its score and, beneath it, its rank backwards, so that greater is better
        bits = max(1, int(len(by_id)).bit_length())
        keep_kind = object if wide or int(np.abs(anchors[used]).sum(1).max(initial=0)) * int(np.abs(self.rows).max(initial=0)) >= 1 << (62 - bits) else np.int64
        none = -(1 << 200) if keep_kind is object else _NONE
        kept = np.full((len(owner), k), none, keep_kind)
        floor = np.full(len(owner), -np.inf)
        todo = [(0, np.arange(len(owner)))]
        while todo:
            ball, live = todo.pop()
            at = local[live]
            go = (upper[at, ball] >= low[live]) & (lower[at, ball] <= high[live]) & (upper[at, ball] >= floor[live])
            if not self.mixed[ball]:
                go &= (labels[at] == self.label[ball]) == same
            live = live[go]
            if not live.size:
                continue
            if self.left[ball] >= 0:
                # the child that more queries look to comes first, so that it raises the floor for the other
                a, b = int(self.left[ball]), int(self.right[ball])
                if (upper[local[live], a] < upper[local[live], b]).mean() > 0.5:
                    a, b = b, a
                todo += [(b, live), (a, live)]
                continue
            lo, hi = int(self.begin[ball]), int(self.end[ball])
            own, back = np.unique(local[live], return_inverse=True)
            score = vectors[own] @ data[lo:hi].T
            score = (score if wide else score.astype(np.int64))[back]
            ok = (score >= low[live, None]) & (score <= high[live, None])
            if same:
                ok &= ids[local[live]][:, None] != self.ids[lo:hi][None, :]
            some = ok.any(1)
            if not some.any():
                continue
            live, score, ok = live[some], score[some].astype(keep_kind), ok[some]
            value = score * (1 << bits) + ((1 << bits) - 1 - rank[lo:hi])[None, :].astype(keep_kind)
            both = np.concatenate([kept[live], np.where(ok, value, none)], 1)
            both.sort(axis=1)
            kept[live] = both[:, -k:]
            least = kept[live, 0]
            full = least > none
            floor[live[full]] = [float(x >> bits) for x in least[full]] if keep_kind is object else (least[full] >> bits).astype(np.float64)
        query, place = np.nonzero(kept > none)
        value = kept[query, place]
        score = value >> bits
        back = ((1 << bits) - 1 - (value - (score << bits))).astype(np.int64)
        return query, by_id[back], score

    def to_bytes(self) -> dict[str, bytes]:
        """The arrays as bytes; the rows as the smallest whole numbers that hold them."""
        found = {name: np.ascontiguousarray(value) for name, value in vars(self).items()}
        found["rows"] = found["rows"].astype(np.min_scalar_type(-int(np.abs(self.rows).max(initial=0)) - 1))
        return {name: value.tobytes() for name, value in found.items()}

    @classmethod
    def from_bytes(cls, parts: dict[str, bytes], width: int) -> BallTree:
        kinds = {"rows": np.int64, "ids": np.int64, "labels": np.int64, "begin": np.int32, "end": np.int32, "left": np.int32, "right": np.int32, "centre": np.float64, "radius": np.float64, "label": np.int64, "mixed": bool}
        kinds["rows"] = f"i{len(parts['rows']) * 8 // max(1, len(parts['ids']) * width)}" if width else np.int64
        found = {name: np.frombuffer(parts[name], kind) for name, kind in kinds.items()}
        for name, n in (("rows", found["ids"].size), ("centre", found["begin"].size)):
            found[name] = found[name].reshape(n, width)
        return cls(**found | {"rows": found["rows"].astype(np.int64)})
