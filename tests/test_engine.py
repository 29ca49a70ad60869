"""Executors, findings, profiles, anomalies and sinks on small tables."""

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rowsentry import api
from rowsentry.functions import similarity as sim
from rowsentry.functions import validate
from rowsentry.functions.normalize import business_value, merge_operations, normalize, structure_mask
from rowsentry.operators import anomaly, executors, findings
from rowsentry.operators.graph import connected_components
from rowsentry.operators.profile import profile, semantic_candidates, select_semantic
from rowsentry.plans.gate import DeterministicGate
from rowsentry.plans.model import Check, Matcher, Plan, Predicate, When
from rowsentry.plans.registry import business, rule
from rowsentry.sources.dataset import ROW, Dataset, detect_header_row, name_columns
from rowsentry.sources.export import corrected_csv, csv_lines, review_columns, reviewed_rows
from rowsentry.sources.xlsx import WorkbookError, from_records, read_dataset, write_workbook


def table(spark, headers, rows):
    return from_records(spark, headers, [(i + 2, r) for i, r in enumerate(rows)])


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def flagged(df):
    return sorted({r for f in df.collect() for r in f.rows})


def test_normalizers(spark):
    ops = merge_operations("name", ["remove_punctuation"])
    assert ops == ("unicode", "trim", "lowercase", "remove_accents", "normalize_whitespace", "remove_punctuation")
    assert values(spark, ["  João   D'Ávila  "], lambda t: normalize(t, ops)) == ["joao d avila"]
    assert values(spark, ["+55 (11) 2030-9090", "011 99999-8888"], lambda t: normalize(t, ["phone_br"])) == ["1120309090", "11999998888"]
    assert values(spark, ["001.234-00", " ab "], lambda t: normalize(t, ["identifier"])) == ["00123400", "ab"]
    assert values(spark, ["  Gréen   Seeds "], lambda t: business_value(t, "Name")) == ["green seeds"]
    assert values(spark, ["USA", " United  States"], lambda t: business_value(t, "Country")) == ["us", "us"]
    assert values(spark, [" 001aBC "], lambda t: business_value(t, "Salesforce ID")) == ["001aBC"]
    assert values(spark, ["Ab1 ÉLDU"], structure_mask) == ["ULD UUUU"]


def test_validators(spark):
    check = lambda name, texts: values(spark, texts, lambda t: validate.is_valid(name, t))
    assert check("cpf", ["529.982.247-25", "123.456.789-00", "111.111.111-11", "", " "]) == [True, False, False, True, True]
    assert check("cnpj", ["11.222.333/0001-81", "11.111.111/1111-11"]) == [True, False]
    assert check("phone_br", ["(11) 2030-9090", "(31) 98888-2222", "(00) 98888-2222"]) == [True, True, False]
    assert check("email", ["", "a@b.cd", "a@b.c", "a b@c.de"]) == [True, True, False, False]
    assert check("required", ["", " ﻿", "0"]) == [False, False, True]
    assert check("number", ["1d", "0x10", "NaN", "1,5", "1e400", ".5", "5.", "1,0,0"]) == [False, True, False, True, False, True, True, False]
    assert check("date", ["2024-02-29", "2023-02-29", "x"]) == [True, False, False]
    fmt = lambda name, texts: values(spark, texts, lambda t: validate.matches_format(name, t))
    assert fmt("us_state", ["NY", " new  york ", "ZZ", ""]) == [True, True, False, False]
    assert fmt("zip", ["00501", "00501-1234", ""]) == [True, False, False]
    ranged = lambda t: validate.matches_predicate("number_range", t, low=0, high=100)
    assert values(spark, ["", " ", "0x10", "12kg", "0", " 100 ", "101"], ranged) == [False, False, False, False, True, True, False]
    assert values(spark, ["AxB", "A.B"], lambda t: validate.matches_predicate("contains", t, ["A.B"])) == [False, True]


def test_similarity(spark):
    r = random.Random(1)
    pairs = [("kitten", "sitting"), ("joao", "joão"), ("", ""), ("a", ""), ("maria souza", "maria de souza"), ("abxx", "abyz")]
    pairs += [("".join(r.choices("abc ", k=r.randrange(8))), "".join(r.choices("abc ", k=r.randrange(8)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", sim.jaro_winkler(a, b).alias("jw"), sim.jaro_winkler_bound(a, b).alias("bound"), sim.levenshtein_similarity(a, b).alias("lev"), sim.levenshtein_at_least(a, b, 0.9).alias("near"), sim.token_jaccard(a, b).alias("tj")).collect()
    for g in got:
        assert 0 <= g.jw <= g.bound + 1e-12
        assert g.near == (g.lev >= 0.9)
        x, y = set(g.a.split()), set(g.b.split())
        assert g.tj == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
    assert got[4].jw > 0.9 and got[5].jw == pytest.approx(0.7333333, abs=1e-6) and got[1].lev == 0.75


def test_row_local(spark):
    ds = table(spark, ["Status", "Phone", "Email", "Age"], [["Active", "", "a@b.cd", 5], ["Inactive", None, "bad", "200"], ["active ", "1", "", True], [None, 0, False, "0x10"]])
    found = lambda *rules: flagged(executors.run_rules(ds, rules))
    assert found(business(Check("required", ("phone",)))) == [2, 3]
    assert found(business(Check("required", ("phone",), When((("status", ("ACTIVE",)),))))) == [2]
    assert found(business(Check("required", ("phone", "email"), mode="all"))) == []
    assert found(business(Check("value_check", ("age",), predicate=Predicate("number_range", low=0, high=100)))) == [3, 4, 5]
    assert found(rule(Plan("validation", ("email",), validator="email"))) == [3, 5]
    both = executors.run_rules(ds, [rule(Plan("missing", ("phone",)), "a"), business(Check("same_fields", ("phone", "email")), "b")])
    assert sorted(((f.rule_id, f.rows[0]) for f in both.collect())) == [("a", 2), ("a", 3), ("b", 2), ("b", 3), ("b", 4), ("b", 5)]
    assert both._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1


def test_grouping(spark):
    ds = table(spark, ["Name", "Zip", "Id"], [["Green Seeds", "1", "x"], ["  Gréen   Seeds ", "1", "X"], ["Green Seeds", "", "x"], ["Blue", "2", ""], ["Blue", "3", ""]])
    assert [sorted(f.rows) for f in executors.run_rules(ds, [business(Check("duplicate_fields", ("name", "zip")))]).collect()] == [[2, 3]]
    assert [f.rows for f in executors.run_rules(ds, [business(Check("unique_any", ("id",)))]).collect()] == [[2, 4]]
    assert flagged(executors.run_rules(ds, [rule(Plan("consistency", ("name", "zip"), (("lowercase",), ())))])) == [5, 6]
    plan = Plan("duplicate", matchers=(Matcher("name", ("lowercase", "trim")), Matcher("id")), any_of=True)
    groups = sorted(f.rows for f in executors.run_rules(ds, [rule(plan)]).collect())
    assert groups == [[2, 4], [5, 6]]


@pytest.mark.parametrize("any_of", [False, True])
def test_fuzzy_against_brute_force(spark, any_of):
    r = random.Random(5)
    names = ["".join(r.choices("abcd", k=r.randrange(3, 9))) for _ in range(34)]
    names += names[:6]
    rows = [[n, r.choice("xy")] for n in names]
    ds = table(spark, ["Name", "Kind"], rows)
    plan = Plan("duplicate", matchers=(Matcher("name", (), "jaro_winkler", 0.8), Matcher("kind")), any_of=any_of)
    edges, cut = executors.duplicate_edges(ds, plan)
    got = {(e.u, e.v) for e in edges.collect()}
    near = lambda i, j: sim.jaro_winkler_text(rows[i][0], rows[j][0]) >= 0.8
    want = {(i + 2, j + 2) for i, j in itertools.combinations(range(40), 2) if rows[i][1] == rows[j][1] and (any_of or near(i, j))}
    assert got == want and not cut.first().cut
    # without a ceiling: classes of equal values close to the same groups
    loose, _ = executors.duplicate_edges(ds, plan, None)
    label = lambda e: {r.node: r.label for r in connected_components(e).collect()}
    assert label(loose) == label(edges)
    few, cut = executors.duplicate_edges(ds, plan, pair_limit=50)
    assert cut.first().cut and {(e.u, e.v) for e in few.collect()} <= got


def test_weighted_against_brute_force(spark):
    r = random.Random(6)
    rows = [["".join(r.choices("abc", k=6)), r.choice(["p", "q", ""]), "".join(r.choices("xy", k=4))] for _ in range(30)]
    ds = table(spark, ["Name", "Zip", "Street"], rows)
    check = Check("weighted_duplicate", (), exact_fields=("name", "zip"), weights=(("name", 0.5), ("zip", 0.2), ("street", 0.3)), threshold=0.85)
    got = {(e.u, e.v): round(e.score, 9) for e in executors.weighted_edges(ds, check, {t: t for t in check.tokens()}).collect()}
    want = {}
    for i, j in itertools.combinations(range(30), 2):
        a, b = rows[i], rows[j]
        exact = a[0] == b[0] and a[1] == b[1] and a[1]
        score = sum(sim.jaro_winkler_text(a[k], b[k]) * w for k, w in ((0, 0.5), (1, 0.2), (2, 0.3)))
        if exact or (a[1] and b[1] and score >= 0.85):
            want[(i + 2, j + 2)] = 1.0 if exact else round(score, 9)
    assert got == want
    with pytest.raises(executors.PairLimitError):
        executors.weighted_edges(ds, check, {t: t for t in check.tokens()}, pair_limit=10)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.label for r in connected_components(chain).collect()}
    assert all(got[i] == 0 for i in range(501)) and got[1001] == 1000


def test_findings_algebra(spark):
    make = lambda i, rows, sev="warning", pri=None: (f"f{i}", f"r{i}", "DUPLICATE", sev, "HIGH", "rows", rows, ["Name"], [], f"why {i}", pri, "act")
    found = spark.createDataFrame([make(1, [2, 3]), make(2, [4, 5]), make(3, [3, 4], pri="high"), make(4, [9]), make(5, [])], findings.SCHEMA)
    groups = {tuple(g.rows): g for g in findings.consolidate(found).collect()}
    assert set(groups) == {(2, 3, 4, 5), (9,), ()} and groups[(2, 3, 4, 5)].head == "f3"
    assert [r.id for r in findings.by_impact(found).collect()][0] == "f3"
    assert {r.row: len(r["items"]) for r in findings.action_items(found).collect()} == {2: 1, 3: 2, 4: 2, 5: 1, 9: 1}
    assert found.select(findings.location(F.col("rows")).alias("l")).collect()[0].l == "2, 3"
    h = 2166136261
    for c in "DUPLICATE:r1:2,3":
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    base = ""
    while h:
        h, d = divmod(h, 36)
        base = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + base
    assert found.select(findings.finding_id(F.lit("DUPLICATE"), F.lit("r1"), F.array(F.lit(3), F.lit(2))).alias("x")).first().x == "finding-" + base


def test_profile_and_headers(spark):
    assert detect_header_row([["Report", None, None], ["Name", "Phone", "Email"], ["Ana", "1", "a@b.cd"]]) == 2
    named, warnings = name_columns(["Name", "Name", None])
    assert [k for k, _ in named] == ["name", "name_2", "column_3"] and len(warnings) == 2
    ds = table(spark, ["Nome Cliente", "Telefone", "Email", "N"], [["Ana Maria", "(11) 2030-9090", "a@b.cd", 1], ["Rui Costa", "(31) 98888-2222", "c@d.ef", "x"], [None, None, None, None]])
    by = {p.header: p for p in profile(ds)}
    assert (by["Nome Cliente"].semantic, by["Telefone"].semantic, by["Email"].semantic) == ("name", "phone", "email")
    assert by["N"].data_type == "mixed" and by["N"].missing == 1 and by["Telefone"].format_variants[0] == "(99) 9999-9999"
    assert select_semantic(semantic_candidates("xyz", ["1"]))[0] in ("number", "unknown")


def test_anomalies(spark):
    ds = table(spark, ["Amount"], [[v] for v in (100, 102, 98, 101, 99, 105, 50000)])
    got = anomaly.mad_outliers(ds, "amount").collect()
    assert [(g.row, g.severity) for g in got] == [(8, "critical")]
    ds = table(spark, ["Code"], [[f"{i:04d}-{i:04d}"] for i in range(10)] + [["oops"]])
    assert [g.row for g in anomaly.format_deviations(ds, "code").collect()] == [12]
    ds = table(spark, ["N"], [[1], [2], [3], [4], [5], [6], ["N/A"]])
    assert [g.row for g in anomaly.type_inconsistencies(ds, "n").collect()] == [8]
    rows = [["Shipped", f"T{i}" if i else None] for i in range(7)] + [["Open", "y"]] * 5
    ds = table(spark, ["Order Status", "Tracking"], rows)
    found, drafts = api.scan_anomalies(ds)
    assert [(g.row, g.baseline.condition) for g in found.where("category = 'ATYPICAL_MISSING'").collect()] == [(2, "Shipped")]
    assert any(d.text == 'If Order Status is "Shipped", Tracking must not be empty' for d in drafts)
    lowered, kept = anomaly.adjudicate(found, drafts, keep_draft=lambda d: d.pillar == "status_dependency", doubt=lambda r: True)
    assert lowered.where("severity = 'info'").count() == found.where("severity IN ('error', 'critical')").count() and len(kept) == 1
    ds = table(spark, ["CustomerID"], [[i] for i in range(15)])
    assert [r.column for r in anomaly.primary_keys(ds).collect()] == ["customerid"]


def test_csv(spark, tmp_path):
    ds = table(spark, ["Name", "N"], [["=1+1", -42], ["  @x", None], ['a,"b"', 1.5], ["é", True], ["gone", 0]])
    path = corrected_csv(ds, str(tmp_path / "out.csv"), spark.createDataFrame([(6,)], f"{ROW} long"))
    assert open(path, "rb").read() == "﻿Name,N\r\n'=1+1,-42\r\n'  @x,\r\n\"a,\"\"b\"\"\",1.5\r\né,true\r\n".encode()
    assert csv_lines(ds).count() == 5
    assert review_columns(["Priority"])[1] == "Priority (review 1)"


def test_xlsx_and_review(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    rows = [[None, "a@b.cd"], ["1", "bad"], [None, None], [2.5, "x@y.zz"], [True, datetime(2024, 1, 2).isoformat()]]
    write_workbook(path, {"Data": (["Phone", "Email"], rows)}, {"Data": {(0, 0)}})
    ds = read_dataset(spark, path)
    assert list(ds.headers.values()) == ["Phone", "Email"] and sorted(r[ROW] for r in ds.df.collect()) == [2, 3, 5, 6]
    result = api.analyze(ds, "Phone is required. Priority: High. Action: Call.\n\nEmail must be a valid email address.", DeterministicGate())
    assert flagged(result.findings.where("type = 'MISSING'")) == [2] and flagged(result.findings.where("type = 'INVALID'")) == [3, 6]
    out = reviewed_rows(ds, result.findings, spark.createDataFrame([(3,)], f"{ROW} long")).collect()
    assert sorted(r["Source row"] for r in out) == [3, 5]
    assert next(r for r in out if r["Source row"] == 3).affected_columns == ["email"]
    first = result.findings.where("type = 'MISSING'").first()
    assert first.priority == "high" and first.action == "Call."
    assert api.finding_rows(result, first.id).count() == 1
    accepted = spark.createDataFrame([(3,)], f"{ROW} long")
    target = api.reviewed_workbook(ds, result.findings, accepted, str(tmp_path / "out.xlsx"), ["note", "note"], source=path)
    again = read_dataset(spark, target)
    assert again.df.count() == 2 and list(again.headers.values())[2:] == ["Action items", "Priority", "Detected issues", "Source row"]
    with pytest.raises(ValueError):
        api.reviewed_workbook(ds, result.findings, accepted, path, source=path)
    with pytest.raises(ValueError):
        api.reviewed_workbook(ds, result.findings, spark.createDataFrame([(5,)], f"{ROW} long"), target)
    groups = findings.consolidate(result.findings)
    assert findings.filter_groups(groups, result.findings, types=["MISSING"]).count() == 1
    assert findings.evidence_by_row(result.findings).count() == 3
    decisions = spark.createDataFrame([("x", 2, "accept"), ("y", 3, "accept")], f"analysis string, {ROW} long, decision string")
    assert findings.decided_rows(decisions, "x", "accept").count() == 1
    with pytest.raises(api.RuleError):
        api.analyze(ds, "Fax is required", DeterministicGate())
    with pytest.raises(WorkbookError):
        read_dataset(spark, str(tmp_path / "no.csv"))


def test_columns_exist(spark):
    ds = table(spark, ["Name"], [["a"]])
    got = api.analyze(ds, "Ensure columns Name and Fax exist", DeterministicGate()).findings.collect()
    assert [(g.scope, g.fields, g.rows) for g in got] == [("worksheet", ["Fax"], [])]


def test_streams(spark, tmp_path):
    from rowsentry.streaming.checks import each_batch, stream_findings

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, ""), (3, "a")], "id long, name string").write.parquet(src)
    df = spark.readStream.schema("id long, name string").parquet(src).withColumn(ROW, F.col("id"))
    ds = Dataset(df, {"name": "Name"})
    missing = business(Check("required", ("name",)))
    q = stream_findings(ds, [missing]).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.rows for r in spark.sql("select rows from found").collect()] == [[2]]
    seen = []
    each_batch(ds, [missing, business(Check("unique_any", ("name",)), "u")], lambda f, n: seen.extend(r.rows for r in f.collect()), str(tmp_path / "c2")).awaitTermination(60)
    assert sorted(map(sorted, seen)) == [[1, 3], [2]]
    with pytest.raises(ValueError):
        stream_findings(ds, [business(Check("unique_any", ("name",)))])


def test_partitioning_does_not_matter(spark):
    rows = [[random.Random(i).choice("abc"), str(i % 4)] for i in range(60)]
    ds = table(spark, ["A", "B"], rows)
    rules = [business(Check("duplicate_fields", ("a", "b"))), rule(Plan("consistency", ("a", "b"), ((), ())), "c"), business(Check("required", ("a",)), "m")]
    base = {(f.id, tuple(f.rows)) for f in executors.run_rules(ds, rules).collect()}
    other = Dataset(ds.df.repartition(7).orderBy(F.rand(3)), ds.headers)
    assert {(f.id, tuple(f.rows)) for f in executors.run_rules(other, rules).collect()} == base


def test_review_helpers(spark, tmp_path):
    from rowsentry.operators import review
    from rowsentry.sources.projects import Project, ProjectStore

    ds = table(spark, ["Name", "Fax"], [["Ana", None], ["ana ", "1"], ["Bo", None]])
    profiles = profile(ds)
    comp = api.compile_rules(ds, "Name is required\n\nGreen must be blue")
    kinds = [c.kind for c in review.coverage(profiles, comp)]
    assert kinds == ["unresolved_rule", "unruled_missing"]
    assert review.chosen_candidate(review.coverage(profiles, comp), "rule-0", 0.8) == "rule-0"
    assert review.chosen_candidate(review.coverage(profiles, comp), "rule-0", 0.79) is None
    assert review.allowed_routes("POSSIBLE_DUPLICATE", differing=True) == ["review_duplicate", "check_relationship", "human_review"]
    assert review.chosen_route("verify_source", 0.9, review.allowed_routes("DUPLICATE")) == "verify_source"
    assert {r.column: r.equal for r in review.comparison_signals(ds, [2, 3], ["name", "fax"]).collect()} == {"name": True}
    assert review.context_rows(ds, [2, 3], ["name"]).count() == 2
    assert review.equal_weights(["a", "b"]) == {"a": 0.5, "b": 0.5} and review.condition_values("a; b\na,") == ["a", "b"]
    found = executors.run_rules(ds, [business(Check("required", ("fax",)))])
    first = found.orderBy("id").first()
    assert review.current_finding(found, first.id, "x", "x").id == first.id
    with pytest.raises(LookupError):
        review.current_finding(found, first.id, "x", "y")
    store = ProjectStore(str(tmp_path))
    p = Project("one", rules="a\nb")
    store.save(p)
    store.keep_analysis(p, found, full=True)
    again = store.load(p.id)
    assert again.rules == "a\nb" and again.history[0]["findings"] == 2 and store.list() == [p.id]
    with pytest.raises(ValueError):
        store.load("../x")


def test_rows_are_numbered_as_they_stand_in_files(spark, tmp_path):
    from rowsentry.sources.dataset import Dataset

    (tmp_path / "a.csv").write_text("Name,Zip\nzeta,9\nalpha,1\nmid,5\n")
    ds = Dataset.from_csv(spark, str(tmp_path / "a.csv"))
    assert [(r["_row"], r.name) for r in ds.df.orderBy("_row").collect()] == [(2, "zeta"), (3, "alpha"), (4, "mid")]
    spark.range(1000, 0, -1, 4).selectExpr("id AS v").write.parquet(str(tmp_path / "p"))
    ds = Dataset.from_parquet(spark, str(tmp_path / "p"))
    assert [r.v for r in ds.df.orderBy("_row").collect()] == list(range(1000, 0, -1))
    assert sorted(r["_row"] for r in ds.df.where("v % 7 = 0").select("_row").collect()) == [1002 - v for v in range(994, 0, -7)]


def sharing_an_id(spark):
    """Findings of rows 1, 2 and 2, the first two with one id, as 32-bit ids have it among many."""
    one = lambda id, kind, row, field: (id, "r", kind, "error", "HIGH", "rows", [row], [field], [(row, field, field, "x", "x", "c", None)], "", None, "")
    return spark.createDataFrame([one("finding-a", "MISSING", 1, "p"), one("finding-a", "MISSING", 2, "q"), one("finding-b", "INVALID", 2, "q")], findings.SCHEMA)


def test_findings_that_share_an_id_are_grouped_apart(spark):
    groups = {tuple(g.rows): g for g in findings.consolidate(sharing_an_id(spark)).collect()}
    assert {rows: g.ids for rows, g in groups.items()} == {(1,): ["finding-a"], (2,): ["finding-a", "finding-b"]}
    same_row = sharing_an_id(spark).withColumn("rows", F.array(F.lit(7).cast("long")))
    assert [g.ids for g in findings.consolidate(same_row).collect()] == [["finding-a", "finding-a", "finding-b"]]


def test_evidence_of_findings_that_share_an_id(spark):
    found = sharing_an_id(spark)
    lines = findings.evidence_by_row(found).join(found.select(findings.identity().alias("key"), "fields"), "key")
    assert sorted((r.row, *r.fields) for r in lines.collect()) == [(1, "p"), (2, "q"), (2, "q")]


def test_groups_are_filtered_by_findings_and_not_by_ids(spark):
    found = sharing_an_id(spark)
    groups = findings.consolidate(found)
    assert [g.rows for g in findings.filter_groups(groups, found, types=["INVALID"]).collect()] == [[2]]
    alone = found.where("type = 'INVALID' OR rows[0] = 2").withColumn("id", F.lit("finding-a"))
    both = findings.consolidate(found.withColumn("id", F.lit("finding-a")))
    assert [g.rows for g in findings.filter_groups(both, alone, types=["INVALID"]).collect()] == [[2]]


def test_checksums_look_for_their_digits_once(spark):
    texts = ["529.982.247-25", "52998224725", "529.982.247-24", "111.111.111-11", "11.222.333/0001-81", "11222333000180", "", "x", "1" * 30, "12345678901234567890", "0" * 14, "00000000191"]
    assert values(spark, texts, validate.valid_cpf) == [True, True, *[False] * 9, True]
    assert values(spark, texts, validate.valid_cnpj) == [*[False] * 4, True, *[False] * 7]
    for valid in (validate.valid_cpf, validate.valid_cnpj):
        plan = spark.range(1).select(valid(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_replace") < 10
