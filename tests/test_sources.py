"""Workbooks in ranges, versions of sources, input limits and the gate on executors."""

import os
import random
import re
import time
import zipfile

import pytest

from rowsentry import api
from rowsentry.plans import limits
from rowsentry.plans.gate import ClusterGate, admit
from rowsentry.plans.language import SourceRule, interpret
from rowsentry.sources import xlsx
from rowsentry.sources.dataset import Dataset
from rowsentry.sources.versions import Manifest, Sessions, SourceChangedError
from pyspark.sql import functions as F


def test_a_sheet_read_in_ranges(spark, tmp_path, monkeypatch):
    """Whatever the ranges, each row is read once and whole."""
    r = random.Random(2)
    path = str(tmp_path / "big.xlsx")
    rows = [[f"n{i} <row> & \"{'é' * r.randrange(9)}\"", i / 4, bool(i % 2), None if i % 3 else "x"] for i in range(700)]
    xlsx.write_workbook(path, {"Other": (["A"], [["no"]]), "Data": (["Name", "Number", "Flag", "Gap"], rows)})
    size = xlsx.Workbook(path).size("Data")
    for step in (97, 1000, 5000, size + 1):
        monkeypatch.setattr(xlsx, "READ", r.choice([33, 500, 1 << 20]))
        found = [row for k in range(0, size, step) for row in xlsx.Workbook(path).rows("Data", k, min(k + step, size))]
        assert [n for n, _ in found] == list(range(1, 702))
        assert [c[:3] for _, c in found[1:]] == [row[:3] for row in rows]
    monkeypatch.undo()
    ds = xlsx.read_dataset(spark, path, "Data", size=4000)
    assert ds.df.count() == 700 and list(ds.headers.values()) == ["Name", "Number", "Flag", "Gap"]
    got = ds.df.orderBy("_row").collect()
    assert [(g["_row"], g.name.s, g.number.n, g.flag.b, g.gap and g.gap.s) for g in got] == [(i + 2, row[0], row[1], row[2], row[3]) for i, row in enumerate(rows)]
    spark.dataSource.register(xlsx.WorkbookSource)
    parts = spark.read.format("workbook").option("sheet", "Data").option("range", "4000").load(path)
    assert parts.rdd.getNumPartitions() == -(-size // 4000)


def test_a_sheet_whose_rows_have_no_numbers(spark, tmp_path):
    path = str(tmp_path / "plain.xlsx")
    xlsx.write_workbook(path, {"Data": (["A"], [[f"v{i}"] for i in range(90)])})
    bare = str(tmp_path / "bare.xlsx")
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(bare, "w") as new:
        for name in old.namelist():
            text = old.read(name)
            new.writestr(name, re.sub(rb'<row r="\d+">', b"<row>", text))
    assert not xlsx.Workbook(bare).numbered("Data") and xlsx.Workbook(path).numbered("Data")
    got = xlsx.read_dataset(spark, bare, size=100).df.orderBy("_row").collect()
    assert [(g["_row"], g.a.s) for g in got] == [(i + 2, f"v{i}") for i in range(90)]


def test_rows_are_encoded_on_executors(spark, tmp_path):
    df = spark.createDataFrame([(3, "a<b>&\x01c", ["v"]), (1, None, []), (2, "  lead", [])], "n long, v string, hit array<string>")
    rows = xlsx.encoded_rows(df, "n", ["v", "n"], ["n"], F.col("hit")).orderBy("place")
    path = str(tmp_path / "out.xlsx")
    xlsx.write_workbook(path, {"S": (["V", "N"], (r.xml for r in rows.toLocalIterator()))})
    assert [c for _, c in xlsx.Workbook(path).rows("S")] == [["V", "N"], [None, 1.0], ["  lead", 2.0], ["a<b>&c", 3.0]]
    assert zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").count(b's="1"') == 1


def test_a_source_that_changes(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    loads = []
    held = Sessions(spark, lambda p: loads.append(p) or Dataset.from_parquet(spark, p, row="id"))
    ds = held.open(path)
    assert held.open(path) is ds and len(loads) == 1
    ds.version.check(spark, ds.paths)
    spark.range(6).write.mode("append").parquet(path)
    with pytest.raises(SourceChangedError):
        api.analyze(ds, '"id" is required.', None)
    with pytest.raises(SourceChangedError):
        held.open(path)
    again = held.open(path)
    assert again.df.count() == 11 and len(loads) == 2
    spark.range(2).write.mode("overwrite").parquet(path)
    assert held.open(path, reload=True).df.count() == 2
    for k in range(4):
        other = str(tmp_path / f"o{k}.parquet")
        spark.range(k + 1).write.parquet(other)
        held.open(other)
    assert len(held.held) == 3 and path not in held.held
    own = Manifest.of(spark.read.parquet(other))
    os.utime(own.files[0][0].removeprefix("file://"), (1, 1))
    with pytest.raises(SourceChangedError):
        own.check(spark)


def test_inputs_beyond_their_limits(spark):
    for bad in ({"rule-1-a": {"priority": "urgent"}}, {"rule-1-a": {"action": " "}}, {"rule-1-a": {"condition_values": {"t": ["x"] * 101}}}, {"rule-1-a": {"similarity": {"threshold": 1.5}}}, {"other": {}}, {"rule-1-a": {"similarity": {"weights": {"a": -1}}}}):
        with pytest.raises(limits.InputError):
            limits.check_configurations(bad)
    limits.check_configurations({"rule-1-a": {"priority": "high", "action": "Do", "condition_values": {"t": ["x"]}, "similarity": {"threshold": 0.9, "weights": {"a": 0.5}}}})
    for call in (lambda: limits.check_rules("x" * 100_001), lambda: limits.check_rules("x", ["r"] * 5001), lambda: limits.check_rules("x", mappings={"a": ""}), lambda: limits.check_rules("x", impacts={"rule-1-a": "huge"}), lambda: limits.check_finding("finding-A"), lambda: limits.check_finding("finding-a", -1), lambda: limits.check_columns(["a", "a"]), lambda: limits.check_columns(list("abcdefghi")), lambda: limits.check_project(" ")):
        with pytest.raises(limits.InputError):
            call()
    rows = lambda *n: spark.createDataFrame([(x,) for x in n], "_row long")
    limits.check_rows(rows(1, 2, 1_100_000))
    limits.check_rows(rows())
    for bad in (rows(0), rows(1, 1), rows(1_100_001)):
        with pytest.raises(limits.InputError):
            limits.check_rows(bad)


def test_the_gate_on_executors(spark):
    """One prediction a rule, in order, none beyond the deadline, and nothing below the floor."""
    texts = ["Dock is required", "Height is required", "Label is required", "Email is required", "Everything should be nice.", "Dock is required"]
    its = [interpret(SourceRule(f"r{k}", t), {h: h for h in ("Dock", "Height", "Label", "Email")}) for k, t in enumerate(texts)]

    def load():
        import time as clock

        def predict(text, asked):
            if text.startswith("Height"):
                clock.sleep(30)
            if text.startswith("Email"):
                raise RuntimeError("out of memory")
            return True, 0.79 if text.startswith("Label") else 0.8, False

        return predict

    began = time.monotonic()
    gate = ClusterGate(spark, load, seconds=2)
    decisions = gate.review_all(its)
    assert time.monotonic() - began < 25
    assert [d.approved for d in decisions] == [True, False, False, False, False, True]
    assert "longer than 2 seconds" in decisions[1].reason and "0.79" in decisions[2].reason and "out of memory" in decisions[3].reason and "not supported" in decisions[4].reason
    assert [it.status for it in admit(its, gate)] == ["valid", "unsupported", "unsupported", "unsupported", "unsupported", "valid"]
    # a table of sentences, several models, each row once
    table = spark.range(400).selectExpr("id AS place", "concat('Dock ', id) AS text", "'?' AS question")
    got = ClusterGate(spark, load, seconds=5, models=4).predictions(table).collect()
    assert sorted(r.place for r in got) == list(range(400)) and all(r.match and r.error is None for r in got)

    def broken():
        raise OSError("no such model")

    assert not ClusterGate(spark, broken).review(its[0]).approved


def test_a_project_and_its_source(spark, tmp_path):
    from rowsentry.sources.projects import Project, ProjectStore

    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    store = ProjectStore(str(tmp_path / "projects"))
    project = Project("One", mappings={"a": "b"}, configurations={"rule-1-a": {"priority": "high", "reference": {"sheet": "x"}}})
    store.save(project)
    held = Sessions(spark, lambda p: Dataset.from_parquet(spark, p, row="id"))
    assert store.open(project, held) is None
    store.attach(project, path)
    assert project.mappings == {} and project.configurations == {"rule-1-a": {"priority": "high"}}
    again = store.load(project.id)
    assert again.dataset == path and store.open(again, held).df.count() == 5
    again.mappings = {"a": "id"}
    assert store.attach(again, path, "S").mappings == {"a": "id"} and store.load(project.id).sheet == "S"
    spark.range(2).write.mode("append").parquet(path)
    assert store.open(again, held).df.count() == 7
    with pytest.raises(limits.InputError):
        store.save(Project(" "))
