"""Selections, profiles and long-form findings against plain counts."""

import random

import pytest
from pyspark.sql import functions as F

from rowsentry.operators import executors, findings, profile
from rowsentry.operators.long_form import Piece, fnv
from rowsentry.operators.selection import exact_median, order_statistics
from rowsentry.plans.model import Check, CompiledRule, Interpretation, Matcher, Plan
from rowsentry.sources.dataset import Dataset


def rule(plan, name="r1"):
    return CompiledRule(Interpretation(name, name, plan.kind, "valid"), plan)


@pytest.mark.parametrize("kind", ["spread", "ties", "heavy", "two", "one"])
def test_selection_is_exact(spark, kind):
    r = random.Random(2)
    x = {"spread": [r.gauss(0, 1) for _ in range(3001)], "ties": [r.choice([1.0, 1.0, 1.0, 2.0, -5.0]) for _ in range(2000)], "heavy": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(2500)], "two": [3.0, -0.5], "one": [7.25]}[kind]
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(3)
    ranks = sorted({0, len(x) - 1, len(x) // 3, len(x) // 2, (len(x) - 1) // 2})
    want = sorted(x)
    assert order_statistics(df, ranks, held=16) == {k: want[k] for k in ranks}
    assert exact_median(df, held=16) == ((want[(len(x) - 1) // 2] + want[len(x) // 2]) / 2, len(x))
    assert exact_median(df.limit(0)) == (None, 0)


def test_profile_of_all_columns(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a ", "a", "b", None, " ", "Ab-1"]), r.choice([1, 2, None]), None) for i in range(400)]
    ds = Dataset.from_df(spark.createDataFrame(rows, "id long, v string, n int, gone string").withColumnRenamed("id", "_row"))
    counts = {c.column: c for c in profile.column_counts(ds).collect()}
    texts = [v for _, v, _, _ in rows if v and v.strip()]
    assert (counts["v"].non_empty, counts["v"].missing, counts["v"].unique_values, counts["v"].types) == (len(texts), 400 - len(texts), len({t.strip() for t in texts}), ["text"])
    assert counts["n"].types == ["number"] and counts["n"].unique_values == 2 and counts["gone"].non_empty == 0 and counts["gone"].types == []
    by = {p.key: p for p in profile.profile(ds)}
    assert by["v"].examples == list(dict.fromkeys(t.strip() for t in texts)) and by["gone"].data_type == "empty"
    plan = profile.column_counts(ds)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # values, then columns
    none = profile.column_counts(Dataset.from_df(ds.df.limit(0))).collect()
    assert {(c.column, c.non_empty, c.missing) for c in none} == {("v", 0, 0), ("n", 0, 0), ("gone", 0, 0)}


def test_pieces_of_a_hash():
    r = random.Random(1)
    text = bytes(r.randrange(256) for _ in range(2000))
    for cut in (0, 1, 700, 1999):
        assert Piece.of(text[:cut]).then(Piece.of(text[cut:])).after(123) == fnv(text, 123)


@pytest.mark.parametrize("plan", [
    Plan("uniqueness", ("v",), (("trim",),)), Plan("business", check=Check("unique_any", ("v", "k")), fields={"v": "v", "k": "k"}), Plan("consistency", ("v", "k"), ((), ())),
    Plan("duplicate", matchers=(Matcher("v", (), "levenshtein", 0.7), Matcher("k"))),
])
def test_long_form_agrees_with_arrays(spark, monkeypatch, plan):
    monkeypatch.setattr("rowsentry.operators.ranks.RANGE_ROWS", 90)
    r = random.Random(9)
    rows = [(i * 3, r.choice(["hot"] * 8 + ["warm", "worn", "cold", f"own {i}"]), r.choice("xy")) for i in range(600)]
    ds = Dataset.from_df(spark.createDataFrame(rows, "id long, v string, k string").withColumnRenamed("id", "_row").repartition(5))
    whole = {f.id: f for f in executors.run_rules(ds, [rule(plan)]).collect()}
    long = executors.findings_in_long_form(ds, rule(plan), evidence=7)
    heads = {h.id: h for h in long.heads.collect()}
    assert heads.keys() == whole.keys() and max(h.n_rows for h in heads.values()) > 100
    for i, h in heads.items():
        w = whole[i]
        assert (h.n_rows, h.rows, h.fields, h.type, h.severity, h.explanation) == (len(w.rows), w.rows[:7], w.fields, w.type, w.severity, w.explanation)
        assert h.evidence == [e for e in w.evidence if e.row in h.rows]
    members = {}
    for m in long.members.collect():
        members.setdefault(m.id, []).append(m.row)
    assert {i: sorted(m) for i, m in members.items()} == {i: w.rows for i, w in whole.items()}


def test_pages_of_source_rows(spark):
    rows = [(i, f"n{i % 2}", f"c{i}", i) for i in range(300)]
    ds = Dataset.from_df(spark.createDataFrame(rows, "id long, a string, b string, c int").withColumnRenamed("id", "_row"))
    check = rule(Plan("business", check=Check("duplicate_fields", ("a",)), fields={"a": "a"}))
    found = executors.run_rules(ds, [check])
    one = min(found.collect(), key=lambda f: f.rows[0])
    page = findings.source_rows(ds, found, one.id, 100)
    assert page.columns == ["_row", "a", "b"] and [p["_row"] for p in page.collect()] == one.rows[100:150]
    assert findings.source_rows(ds, found, one.id, 1000).count() == 0
    gone = Dataset(ds.df.where("_row <> 4"), ds.headers)
    with pytest.raises(LookupError):
        findings.source_rows(gone, found, one.id)
    with pytest.raises(KeyError):
        findings.source_rows(ds, found, "finding-none")


def test_scores_against_the_first_row(spark):
    rows = [(5, "abcdefghij", "k"), (2, "abcdefghix", "k"), (9, "abcdefghyx", "k"), (7, "other", "k"), (8, "abcdefghij", "z")]
    ds = Dataset.from_df(spark.createDataFrame(rows, "id long, v string, k string").withColumnRenamed("id", "_row"))
    found = executors.duplicate(ds, rule(Plan("duplicate", matchers=(Matcher("v", (), "levenshtein", 0.9), Matcher("k")))), pair_limit=None).collect()
    assert [f.rows for f in found] == [[2, 5, 9]]
    assert {(e.row, e.column_key): round(e.score, 6) for e in found[0].evidence} == {(2, "v"): 1.0, (5, "v"): 0.9, (9, "v"): 0.9, (2, "k"): 1.0, (5, "k"): 1.0, (9, "k"): 1.0}


def test_groups_without_evidence(spark):
    rows = [(i, "same" if i % 3 else f"v{i}", "k") for i in range(40)] + [(99, "", "k")]
    ds = Dataset.from_df(spark.createDataFrame(rows, "id long, v string, k string").withColumnRenamed("id", "_row"))
    check = rule(Plan("business", check=Check("duplicate_fields", ("v", "k")), fields={"v": "v", "k": "k"}))
    whole, bare = (executors.run_rules(ds, [check], evidence_limit=n).collect() for n in (None, 0))
    assert [f.asDict() | {"evidence": 0} for f in whole] == [f.asDict() | {"evidence": 0} for f in bare] and bare[0].evidence == [] and whole[0].evidence
