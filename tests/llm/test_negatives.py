"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowsentry.llm import hard_negatives
from rowsentry.llm.ball_tree import BallTree

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    v = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * c) for c in x)))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, label, x in {a for a in v if a[0] % 100 == 0}:
        scored = sorted((-dot(x, y), j, m) for j, m, y in v if j != i)
        for minus, j, _ in [s for s in scored if s[2] == label][:5]:
            p = -minus
            fit = [(k, -s) for s, k, m in scored if m != label and 30 * p <= -100 * s <= 90 * p]
            out += [(i, j, rank + 1, k, p, s) for rank, (k, s) in enumerate(fit[:10])]
    return sorted(out)


def rows_of(seed, n, width=6, coarse=False):
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.4, (n, width))
    x[n // 3 : 2 * n // 3] = x[0]  # a third of all rows are copies of one vector
    if coarse:
        x = np.round(x * 2) / 2
    return [(int(i), row.tolist(), int(label)) for i, row, label in zip(range(n), x, r.integers(0, 4, n))]


@pytest.mark.parametrize("seed, n, coarse", [(1, 700, False), (2, 700, True), (3, 0, False), (4, 3, False)])
def test_mining_against_brute_force(spark, monkeypatch, seed, n, coarse):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 90)
    monkeypatch.setattr(hard_negatives, "MOST_ROWS", 90)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    rows = rows_of(seed, n, coarse=coarse) if n else []
    odd = [(None, [1.0] * 6, 1), (5, None, 1), (6, [1.0] * 6, None), (8, [1.0, None] * 3, 1), (9, [float("nan")] * 6, 1), (11, [float("inf")] * 6, 1), (12, [0.5], 2), (13, [], 2), (3, [0.1] * 6, 3), (200, [0.3] * 6, 1), (300, [0.2, -0.1] * 3, 0)]
    rows += odd + rows[2:3] * 2
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS mark", "3 AS q").repartition(4)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    assert got == plain(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_an_empty_table(spark):
    got = hard_negatives.mine(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and got.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 120), st.sampled_from([1, 4, 50]), st.booleans(), st.sampled_from([3, 1 << 20, 1 << 30]))
def test_trees_are_exact(seed, n, leaf, same, scale):
    r = np.random.default_rng(seed)
    rows, labels = r.integers(-scale, scale + 1, (n, 3)), r.integers(-1, 3, n)
    ids = r.permutation(n) * 3
    anchors, own = r.integers(-scale, scale + 1, (7, 3)), r.integers(-1, 3, 7)
    tree = BallTree.from_bytes(BallTree.build(rows, ids, labels, leaf).to_bytes(), 3)
    owner = r.integers(0, 7, 15)
    far = int(3 * scale * scale)
    low, high = r.integers(-far, far, 15), r.integers(-far, far, 15)
    query, row, score = tree.best(anchors, np.arange(7), own, owner, low, high, 4, same)
    got = sorted((int(q), int(s), int(tree.ids[k])) for q, k, s in zip(query, row, score))
    want = []
    for q in range(15):
        a = owner[q]
        dots = [(int(sum(int(x) * int(y) for x, y in zip(anchors[a], rows[k]))), int(ids[k])) for k in range(n) if (labels[k] == own[a]) == same and (not same or ids[k] != a)]
        best = sorted((s, i) for s, i in dots if low[q] <= s <= high[q])
        want += [(q, s, i) for s, i in sorted(best, key=lambda t: (-t[0], t[1]))[:4]]
    assert got == sorted(want)


def test_balls_are_passed_over():
    """Of clustered rows a tree looks at few; bounds lie on both sides of every product."""
    r = np.random.default_rng(5)
    centres = r.normal(0, 400, (40, 16))
    rows = np.floor(np.repeat(centres, 50, 0) + r.normal(0, 4, (2000, 16))).astype(np.int64)
    tree = BallTree.build(rows, np.arange(2000), np.zeros(2000, np.int64), 25)
    q = rows[:20].astype(float)
    middle, reach = q @ tree.centre.T, np.sqrt((q**2).sum(1))[:, None] * tree.radius
    for k in range(len(tree.begin)):
        dots = q @ tree.rows[tree.begin[k] : tree.end[k]].T
        assert (dots <= (middle + reach)[:, k, None] + 1e-6).all() and (dots >= (middle - reach)[:, k, None] - 1e-6).all()
    tops = tree.best(rows[:20], -np.arange(1, 21), np.zeros(20, np.int64), np.arange(20), np.full(20, -(1 << 60)), np.full(20, 1 << 60), 5, True)
    leaves = np.flatnonzero(tree.left < 0)
    kth = np.array([np.sort(tops[2][tops[0] == a])[0] for a in range(20)])
    need = ((middle + reach)[:, leaves] >= kth[:, None]).mean()
    assert need < 0.2


def test_blocks_and_trees_stay_off_the_driver(spark):
    blocks = spark.createDataFrame([([(1, 2, 3, [1, 2])],)], "anchors array<struct<anchor_id:long,mark:long,label:long,q:array<long>>>")
    trees = spark.createDataFrame([(0, *[b"x"] * len(hard_negatives._TREE))], "part long, " + ", ".join(f"{n} binary" for n in hard_negatives._TREE))
    dealt = hard_negatives._dealt(blocks, trees, 1)
    assert dealt.count() == 1
    assert "Broadcast" not in dealt._jdf.queryExecution().executedPlan().toString()
