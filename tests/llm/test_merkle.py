"""The manifest against a plain recursion, and the laws of its forests."""

import random
import zlib
from hashlib import sha256
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowsentry.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, more=0):
    n = None if r[4] is None else r[4] + more
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])))


def climb(nodes, arity):
    """All levels over some leaves."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, at, arity):
    out = []
    for nodes in levels[:-1]:
        begin = at // arity * arity
        out.append((at - begin, [h for k, h in enumerate(nodes[begin : begin + arity]) if k != at - begin]))
        at //= arity
    return out


def plain(rows, arity=2):
    lang = lambda r: (r[2] is not None, (r[2] or "").encode())
    order = sorted(rows, key=lambda r: (lang(r), r[0] is not None, r[0] or 0, leaf_of(r)))
    groups = [list(g) for _, g in groupby(order, key=lang)]
    trees = [climb([leaf_of(r) for r in g], arity) for g in groups]
    top = climb([t[-1][0] for t in trees], arity)
    root, out = top[-1][0] if rows else None, []
    for k, (group, tree) in enumerate(zip(groups, trees)):
        for at, r in enumerate(group):
            path = siblings(tree, at, arity) + siblings(top, k, arity)
            h = leaf_of(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for place, others in path:
                h = H(*others[:place], h, *others[place:])
            out.append((r[0], leaf_of(r), tree[-1][0], root, H(*(h for _, others in path for h in others)), h, h == root))
    return out


def rows_of(n, seed=1):
    r = random.Random(seed)
    rows = [(i if r.random() < 0.95 else None, r.choice([None, "", "x", "é" * 40, "w " * 300]), r.choice(["en"] * 6 + ["de", None, "", "fr", "ß"]), r.choice([None, "web", ""]), r.choice([None, 0, i])) for i in range(n)]
    return rows + rows[:5] + rows[:2]


def ordered(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("arity, n", [(2, 157), (3, 157), (2, 0), (2, 1), (5, 26)])
def test_manifest_against_a_plain_recursion(spark, monkeypatch, arity, n):
    monkeypatch.setattr(merkle, "SLICE", 16)
    rows = rows_of(n) if n else []
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit(1), "grp": F.lit("x"), "root": F.lit(2)}).repartition(5)
    monkeypatch.setattr("rowsentry.operators.ranks.RANGE_ROWS", 20)
    got = merkle.manifest(docs, arity, fragment=13).collect()
    assert ordered(got) == ordered(plain(rows, arity))
    if n > 100:
        assert {r.verified for r in got} == {True, False} and all(r.verified == (r.folded_root == r.root) for r in got)


def test_ranges_cut_groups_anywhere(spark):
    """Many small ranges and one group with most rows: nothing depends on how rows are dealt."""
    rows = [(i, f"t{i}", "en" if i % 9 else None, None, i) for i in range(400)]
    leaves = merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("lang", "grp")
    want = {g: climb([leaf_of(r) for r in rows if r[2] == g], 2)[-1][0] for g in ("en", None)}
    for fragment in (1, 7, 1000):
        grown = merkle.grow(leaves, [F.col("doc_id"), F.col("leaf")], 2, fragment)
        assert {r.grp: r.root.hex() for r in grown.roots.collect()} == want
        assert len(grown.forest.loose) <= 2


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.integers(2, 4), st.randoms(use_true_random=False))
def test_forests_are_a_monoid(n, arity, r):
    """Any dealing of the leaves and any bracketing of the merges gives the same forest."""
    leaves = [sha256(str(k).encode()).digest() for k in range(n)]
    part = [r.randrange(4) for _ in leaves]
    make = lambda keep: merkle.Forest.of([("g", n, 0, k, leaves[k]) for k in range(n) if keep(part[k])], arity)
    a, b, c, d = (make(lambda p, q=q: p == q) for q in range(4))
    one, other = a.merge(b).merge(c.merge(d)), d.merge(b.merge(a)).merge(c)
    assert one.loose == other.loose and one.joined == other.joined and one.merge(merkle.Forest(arity)) == one
    want = climb([x.hex() for x in leaves], arity)[-1][0]
    assert [(g, x.hex()) for g, x in one.roots()] == [("g", want)]
    at = r.randrange(n)
    path = one.path("g", 0, at)
    assert merkle.fold(leaves[at], at, n, path, arity).hex() == want
    if n > 1:
        assert merkle.fold(leaves[at - 1], at, n, path, arity).hex() != want


def test_siblings_that_are_missing_are_an_error():
    with pytest.raises(ValueError, match="never met"):
        merkle.Forest.of([("g", 4, 0, 1, b"x" * 32)], 2).roots()
    with pytest.raises(ValueError, match="another length"):
        merkle.fold(b"x" * 32, 0, 2, b"y" * 64, 2)
