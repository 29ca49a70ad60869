"""Similarity joins by signatures against all pairs."""

import itertools
import random

import pytest

from rowsentry.functions import similarity as sim
from rowsentry.operators import executors, fuzzy_join, row_links
from rowsentry.operators.ranks import numbered, page, running_sum
from rowsentry.plans import registry
from rowsentry.plans.model import Check, CompiledRule, Interpretation, Matcher, Plan
from rowsentry.sources.dataset import Dataset
from pyspark.sql import functions as F


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return 1 - p[-1] / max(len(a), len(b), 1)


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a | b else 1.0


MEASURES = {"levenshtein": levenshtein, "jaro_winkler": sim.jaro_winkler_text, "token_jaccard": jaccard}


@pytest.fixture(scope="module")
def values():
    r = random.Random(5)
    base = ["".join(r.choices("abcdefghijké", k=r.randrange(1, 18))) for _ in range(50)] + ["same beginning " + c for c in "abcdef"]

    def noisy(x):
        x = list(x)
        for _ in range(r.randrange(4)):
            k, c = r.randrange(len(x) + 1), r.choice("abcdef")
            x[k : k + r.choice([0, 1, 1])] = r.choice([[c], []])
        return "".join(x)

    v = sorted({noisy(r.choice(base)) for _ in range(260)} - {""})
    w = [" ".join(r.choices(["red", "blue", "old", "nut", "bolt", "x1", "y"], k=r.randrange(1, 5))) for _ in v]
    return [(i, a, b, "k" if i % 3 else "l") for i, (a, b) in enumerate(zip(v, w))]


CASES = [
    ([("v", "levenshtein", 0.8)], False), ([("v", "levenshtein", 0.2)], False), ([("v", "jaro_winkler", 0.9)], False), ([("v", "jaro_winkler", 0.7)], False),
    ([("v", "levenshtein", 0.7), ("w", "token_jaccard", 0.3)], False), ([("w", "token_jaccard", 0.5), ("v", "jaro_winkler", 0.87)], False),
    ([("v", "levenshtein", 0.85), ("w", "token_jaccard", 0.9)], True), ([("v", "levenshtein", 0.9), ("k", None, None)], True),
]


@pytest.mark.parametrize("matchers, any_of", CASES)
def test_no_similar_pair_is_lost(spark, monkeypatch, values, matchers, any_of):
    monkeypatch.setattr(fuzzy_join, "PAIRS", 40)
    monkeypatch.setattr(fuzzy_join, "TASK_PAIRS", 90)
    ds = Dataset.from_df(spark.createDataFrame(values, "id long, v string, w string, k string"), row="id")
    plan = Plan("duplicate", matchers=tuple(Matcher(k, (), m, t) if m else Matcher(k) for k, m, t in matchers), any_of=any_of)
    members, pairs = executors.duplicate_classes(ds, plan)
    got = sorted((x.u, x.v) for x in pairs.collect())
    place, known = {"v": 1, "w": 2, "k": 3}, {}
    for row in values:
        known.setdefault(tuple(row[place[k]] for k, _, _ in matchers), row[0])
    want = []
    for (a, i), (b, j) in itertools.combinations(known.items(), 2):
        good = [MEASURES[m](x, y) >= t if m else x == y for x, y, (_, m, t) in zip(a, b, matchers)]
        exact = [g for g, (_, m, _) in zip(good, matchers) if not m]
        if all(exact) and (any(good) if any_of else all(good)):
            want.append((i, j))
    assert got == sorted(want) and want
    assert {r["_row"]: r.first for r in members.collect()} == {row[0]: known[tuple(row[place[k]] for k, _, _ in matchers)] for row in values}


def test_plans_have_no_nested_loop(spark, values):
    ds = Dataset.from_df(spark.createDataFrame(values, "id long, v string, w string, k string"), row="id")
    _, pairs = executors.duplicate_classes(ds, Plan("duplicate", matchers=(Matcher("v", (), "levenshtein", 0.8),)))
    check = Check("weighted_duplicate", (), weights=(("v", 0.6), ("w", 0.4)), threshold=0.95)
    fields = {t: t for t in check.tokens()}
    found = fuzzy_join.similar_pairs(ds.df.select("_row", "v"), [fuzzy_join.Field("v", "jaro_winkler", 0.9)], lambda p: p.select(F.col("l__row").alias("u"), F.col("r__row").alias("v")))
    assert found.count() > 0
    for df in (pairs, executors.weighted_classes(ds, check, fields, None)[1], found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_rows_without_an_exact_matcher(spark):
    """Beyond the capped plan's block size no pair is lost."""
    r = random.Random(8)
    rows = [(i, "".join(r.choices("abcdefghijklmnop", k=12))) for i in range(6000)]
    rows += [(6000 + i, "Z" + a[1:]) for i, (_, a) in enumerate(rows[:40])]  # another first letter
    ds = Dataset.from_df(spark.createDataFrame(rows, "id long, v string"), row="id")
    plan = Plan("duplicate", matchers=(Matcher("v", (), "levenshtein", 0.9),))
    got = {(x.u, x.v) for x in executors.duplicate_classes(ds, plan)[1].collect()}
    wild = {}
    for i, a in rows:
        for k in range(12):
            wild.setdefault((k, a[:k] + a[k + 1 :]), []).append(i)
    want = {tuple(sorted(p)) for ids in wild.values() for p in itertools.combinations(ids, 2)}
    assert got == want and len(want) >= 40


@pytest.mark.parametrize("threshold, exact", [(0.85, ("name", "zip")), (0.35, ())])
def test_weighted_groups(spark, monkeypatch, threshold, exact):
    monkeypatch.setattr(fuzzy_join, "PAIRS", 30)
    r = random.Random(6)
    rows = [(i, "".join(r.choices("abc", k=6)), r.choice(["p", "q", "", "pq"]), "".join(r.choices("xy", k=4))) for i in range(60)]
    rows += [(60 + i, *row[1:]) for i, row in enumerate(rows[:7])]
    ds = Dataset.from_df(spark.createDataFrame(rows, "id long, name string, zip string, street string"), row="id")
    weights = (("name", 0.5), ("zip", 0.2), ("street", 0.3))
    check = Check("weighted_duplicate", (), exact_fields=exact, weights=weights, threshold=threshold)
    fields = {t: t for t in check.tokens()}
    links, least, by = {}, {}, {}
    for a, b in itertools.combinations(rows, 2):
        same = bool(exact) and all(a[k] == b[k] and a[k] for k in (1, 2))
        score = sum(sim.jaro_winkler_text(a[k], b[k]) * w for k, (_, w) in zip((1, 2, 3), weights))
        if same or (a[2] and b[2] and score + 2.3e-16 >= threshold):
            links[a[0], b[0]] = 1.0 if same else score
            for i in (a[0], b[0]):
                least[i] = min(least.get(i, 9), links[a[0], b[0]])
                by.setdefault(i, set()).update(exact if same else [t for t, _ in weights])
    assert {(e.u, e.v): round(e.score, 9) for e in executors.weighted_edges(ds, check, fields, None).collect()} == {k: round(v, 9) for k, v in links.items()}
    root = {i: i for i in least}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in links:
        x, y = sorted((find(u), find(v)))
        root[y] = x
    groups = {}
    for i in root:
        groups.setdefault(find(i), []).append(i)
    rule = CompiledRule(Interpretation("r", "r", "business", "valid"), Plan("business", check=check, fields=fields))
    got = executors.weighted_duplicate(ds, rule, pair_limit=None).collect()
    assert sorted(f.rows for f in got) == sorted(map(sorted, groups.values()))
    for e in (e for f in got for e in f.evidence):
        assert e.score == pytest.approx(least[e.row]) and e.column_key in by[e.row]
    assert sum(len(f.evidence) for f in got) == sum(map(len, by.values()))


def test_jaro_winkler_grid():
    """A grid is what its pairs are one by one: shared beginnings, words of each width, texts beyond them, empty ones."""
    r = random.Random(2)
    for k in range(120):
        letters = r.choice(["ab", "abcdefgh", "0123456789", "a\u00e9\U0001f600z"])
        shared = "".join(r.choices(letters, k=r.choice([0, 1, 3, 4, 12])))
        text = lambda: (shared if k % 2 or r.random() < 0.9 else "") + "".join(r.choices(letters, k=r.choice([k % 7, r.randrange(12), r.choice([0, 20, 40, 70])])))  # noqa: E731, B023
        a, b = ([text() for _ in range(r.randrange(1, 7))] for _ in range(2))
        b[0] = r.choice([b[0], a[0]])
        assert sim.jaro_winkler_grid(a, b).tolist() == [[sim.jaro_winkler_text(x, y) for y in b] for x in a]


def _links(rows, exact, weights, threshold):
    """``u: (links, best)`` of rows ``(id, values)`` in the order of their ids, pair by pair."""
    out = {}
    for (u, a), (_, b) in itertools.combinations(sorted(rows), 2):
        same = bool(exact) and all(a[k] and a[k] == b[k] for k in exact)
        score = 1.0 if same else sum(sim.jaro_winkler_text(a[k], b[k]) * w for k, w in weights) if all(a[k] and b[k] for k, _ in weights) else -1
        if same or score + 2.3e-16 >= threshold:
            n, best = out.get(u, (0, 0.0))
            out[u] = (n + 1, max(best, round(score, 9)))
    return out


@pytest.mark.parametrize("route", ["counted", "asked", "pairs"])
@pytest.mark.parametrize("threshold, exact", [(0.9, ("name", "zip")), (0.9, ())])
def test_weighted_link_counts(spark, monkeypatch, route, threshold, exact):
    """Rows of small blocks, repeated and empty ones among them, against brute force; where counting isn't worth it, pairs are made."""
    monkeypatch.setattr(row_links, "BLOCK_ROWS", 7)
    if route != "counted":
        monkeypatch.setattr(executors, "FREE_COUNTED", 0)
        monkeypatch.setattr(executors, "WORTH", 10**6 if route == "asked" else 0)
    r = random.Random(4)
    rows = [("ana" + "".join(r.choices("abc", k=r.randrange(2, 5))), r.choice(["pq1", "pq2", "pq12", "", "z"]), "".join(r.choices("xy", k=r.randrange(4)))) for _ in range(70)]
    rows = [(i * 37 % 101, *row) for i, row in enumerate([*rows, *rows[:20]])]
    ds = Dataset.from_df(spark.createDataFrame(rows, "id long, name string, zip string, street string"), row="id")
    weights = (("name", 0.5), ("zip", 0.4), ("street", 0.1))
    check = Check("weighted_duplicate", (), exact_fields=exact, weights=weights, threshold=threshold)
    place = {"name": 0, "zip": 1, "street": 2}
    want = _links([(x[0], x[1:]) for x in rows], [place[t] for t in exact], [(place[t], w) for t, w in weights], threshold)
    got = executors.weighted_link_counts(ds, check, {t: t for t in check.tokens()}).collect()
    assert {x.u: (x.links, round(x.best, 9)) for x in got} == want and len(want) == len(got) > 20


def test_weighted_query_lists_no_pairs(spark, monkeypatch, tmp_path):
    """The registered query counts links: it neither makes pairs of rows nor of classes, however many rows repeat a name."""
    for made in ("weighted_edges", "weighted_classes", "similar_pairs"):
        monkeypatch.setattr(executors, made, None)
    r = random.Random(9)
    rows = [(i, f"Supplier#{r.randrange(150):09d}", r.choice([1, 2, 12, 3])) for i in range(300)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.queries()["weighted_duplicate"](spark, str(tmp_path)).collect()
    want = _links([(i, (a.lower(), f"z{z}")) for i, a, z in rows], (0, 1), ((0, 0.6), (1, 0.4)), 0.95)
    assert {x.u: (x.links, x.best) for x in got} == want and len(want) == len(got) > 200
    nobody = spark.createDataFrame([], "s_suppkey long, s_name string, s_nationkey int")
    nobody.write.parquet(f"{tmp_path}/none/supplier.parquet")
    assert registry.queries()["weighted_duplicate"](spark, f"{tmp_path}/none").count() == 0


def test_places_and_sums(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, "a", "a", "a", "b"]), r.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, x int").repartition(6)
    got = {x.id: (x["_at"], x["_of"]) for x in numbered(df, [F.col("x").desc(), F.col("id")], by=["g"], range_rows=17).collect()}
    for g in (None, "a", "b"):
        own = sorted((x for x in rows if x[1] == g), key=lambda x: (-x[2], x[0]))
        assert [got[x[0]] for x in own] == [(k, len(own)) for k in range(len(own))]
    whole = numbered(df, [F.col("id")], range_rows=23)
    assert {x.id: (x["_at"], x["_of"]) for x in whole.collect()} == {i: (i, 500) for i in range(500)}
    assert [x.id for x in page(whole, 490, 50).collect()] == list(range(490, 500))
    summed, total = running_sum(df, [F.col("id")], "x", "before", range_rows=31)
    assert total == sum(x for *_, x in rows)
    assert {x.id: x.before for x in summed.collect()} == {i: sum(x for *_, x in rows[:i]) for i in range(500)}
    assert numbered(df.limit(0), [F.col("id")]).count() == 0 and running_sum(df.limit(0), [F.col("id")], "x", "b")[1] == 0


def test_a_ceiling_takes_the_first_pairs(spark):
    """The pairs within a ceiling are those of the first blocks and rows, whatever the block sizes."""
    rows = [(i, "ab"[i % 7 == 0], "x" * 8) for i in range(60)]
    ds = Dataset.from_df(spark.createDataFrame(rows, "id long, k string, v string"), row="id")
    plan = Plan("duplicate", matchers=(Matcher("v", (), "levenshtein", 0.9), Matcher("k")))
    blocks = sorted(([r[0] for r in rows if r[1] == k] for k in "ab"), key=min)
    order = [p for b in blocks for p in itertools.combinations(b, 2)]
    for limit in (20, 5000):
        edges, cut = executors.duplicate_edges(ds, plan, limit)
        assert sorted((e.u, e.v) for e in edges.collect()) == sorted(order[:limit])
        assert cut.first().cut == (len(order) > limit)


def test_a_column_with_few_values_settles_which_classes_meet(spark, monkeypatch):
    from rowsentry.functions.similarity import jaro_winkler_text
    from rowsentry.operators import executors

    monkeypatch.setattr(executors, "TASK_PAIRS", 7)
    monkeypatch.setattr(executors, "LEAST_TASKS", 3)
    zones = ("z1", "z11", "z12", "harbour", "q")
    rows = [(k, f"supplier#{k:04d}", zones[k * k % 5]) for k in range(40)]
    classes = spark.createDataFrame(rows, "_row long, w0 string, w1 string")
    pairs, total = executors._pairs_by_values(classes, "w1", 0.875)
    got = [(p.l__row, p.r__row) for p in pairs.collect()]
    wanted = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and jaro_winkler_text(x[2], y[2]) >= 0.875}
    assert len(got) == len(set(got)) and set(got) == wanted and len(got) <= total


def test_texts_with_one_beginning_meet_their_neighbours_alone(spark, monkeypatch):
    """A crowded segment is refined by the place of the edit, so hardly a pair is compared in vain; none is lost."""
    monkeypatch.setattr(fuzzy_join, "PAIRS", 100)
    rows = [(k, f"Customer#{k:09d}" + ("x" if k % 50 == 0 else "")) for k in range(3000)]
    df = spark.createDataFrame(rows, "_row long, v string")
    seen = []

    def accept(pairs):
        seen.append(pairs.count())
        return pairs.where(sim.levenshtein_at_least(F.col("l_v"), F.col("r_v"), 0.94)).select(F.col("l__row").alias("u"), F.col("r__row").alias("v"))

    got = {(p.u, p.v) for p in fuzzy_join.similar_pairs(df, [fuzzy_join.Field("v", "levenshtein", 0.94)], accept).collect()}
    want = set()
    for k, a in rows:
        near = {a[:i] + c + a[j:] for i in range(len(a) + 1) for j in (i, i + 1) for c in ["", *"0123456789x"]}
        want |= {(k, j) for j in range(k + 1, 3000) if rows[j][1] in near} if k < 60 else set()
    assert {p for p in got if p[0] < 60} == want and want
    assert sum(seen) <= 2 * len(got)


def test_a_banded_distance_decides_like_the_whole_one(spark):
    r = random.Random(4)
    rows = [("".join(r.choices("abé", k=r.randrange(9))), "".join(r.choices("abé", k=r.randrange(9)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string")
    for t in (0.0, 0.5, 0.75, 1.0):
        got = df.select(sim.levenshtein_at_least(F.col("a"), F.col("b"), t).alias("x")).collect()
        assert [g.x for g in got] == [levenshtein(a, b) >= t for a, b in rows]


def test_pairs_within_keys_are_dealt_to_even_cells(spark, monkeypatch):
    """Each pair once, whatever its key's size, and no task has a whole large key."""
    monkeypatch.setattr(fuzzy_join, "CELL_ROWS", 20)
    rows = [(k, "g" if k % 10 else "h", k) for k in range(300)] + [(900, None, 1), (901, None, 2)]
    pairs = fuzzy_join.pairs_within(spark.createDataFrame(rows, "_row long, g string, x int"), ["g"])
    got = [(p.l__row, p.r__row) for p in pairs.collect()]
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] and a[1] == b[1]}
    assert len(got) == len(want) and set(got) == want
    sizes = [x["count"] for x in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < len(want) / 4
    texts = [(1, "g", "ab😀😀c"), (2, "g", "ab😀😀"), (3, "g", "ab😀😁c"), (4, "h", "ab"), (5, "h", "ab"), (6, "i", ""), (7, "i", "x"), (8, "j", None)]
    cut = fuzzy_join.without_shared_beginning(spark.createDataFrame(texts, "_row long, g string, v string"), "v", ["g"])
    assert {x["_row"]: x.v for x in cut.collect()} == {1: "😀c", 2: "😀", 3: "😁c", 4: "", 5: "", 6: "", 7: "x", 8: None}


def test_lines_of_duplicates_are_those_of_the_findings(spark):
    """Scores of rows are had without a row that holds its whole group."""
    rows = [(k, f"part {'abc'[k % 3]}{k % 5}", "xy"[k % 2]) for k in range(90)]
    ds = Dataset.from_df(spark.createDataFrame(rows, "id long, v string, k string"), row="id")
    plan = Plan("duplicate", matchers=(Matcher("v", ("trim",), "levenshtein", 0.6), Matcher("k")))
    members, cut = executors.duplicate_members(ds, plan, None)
    assert "collect_list" not in members._jdf.queryExecution().optimizedPlan().toString() and not cut.first().cut
    lines = {(x.label, e.row, e.column_key, e.score) for x in members.collect() for e in x.cells}
    found = executors.duplicate(ds, CompiledRule(Interpretation("r", "r", "duplicate", "valid"), plan), None, None).collect()
    assert lines == {(min(f.rows), e.row, e.column_key, e.score) for f in found for e in f.evidence} and len(lines) == 180
