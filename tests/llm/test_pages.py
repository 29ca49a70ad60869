"""WARC round trips, the loser tree, URL filters and fingerprints."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowsentry.llm import imatch, url_filter, warc


def test_loser_tree_merges():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.choices(range(30), k=r.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_archive_round_trip(spark):
    big = "<p>é" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n" + "</p>"
    rows = [(3, "http://a.example.com/x", big), (1, "http://b.example.net/", big), (2, None, None), (4, "no scheme\nline", ""), (5, "http://www.a.example.com/x", "short"), (6, "http://a.example.com/x", "short"), (None, "http://c/", big), (7, "http://a/", "y" * 70000), (1, "http://b.example.net/", big)]
    df = spark.createDataFrame([(i, u, h, "z") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archive_pages(df).collect()
    assert len(got) == len(rows)
    text = {(i, u): h or "" for i, u, h in rows}
    for g in got:
        html = next(h or "" for i, u, h in rows if i == g.page_id)
        assert g.payload_bytes == len(html.encode()) and g.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        again = g.page_id == 3
        assert (g.record_type, g.refers_to) == (("revisit", 1) if again else ("response", None))
    assert len(text) == 8
    keys = [(g.url_key, g.captured) for g in got]
    assert {k for k, _ in keys} >= {"com,example,a)/x", "net,example,b)/"}
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_index_is_globally_ordered(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    monkeypatch.setattr(warc, "ARCHIVE_ROWS", 9)
    df = spark.range(150).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") * 7 % 11, F.lit(".example.com/")).alias("url"), F.lit("t").alias("html")).repartition(6)
    got = warc.archive_pages(df)
    keys = [(g.place, (g.url_key, g.captured, g.page_id)) for g in got.collect()]
    assert sorted(keys) == list(enumerate(sorted(k for _, k in keys))) and len(keys) == 150


def brute_site(url, rules):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = (None, None)
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return host, path, *best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["http", "://", "/", "net", "org", "example", ".", "com", "en/", "de/", "fr/", "?", "#", "A", "spam-farm", "cheap-pills", "/about"]), max_size=9).map("".join))
def test_urls_against_brute_force(url):
    f = url_filter.UrlFilter()
    host, path, rule, verdict, pattern = f.judge(url)
    bh, bp, br, bv = brute_site(url, url_filter.SITE_RULES)
    assert (host, path, rule) == (bh, bp, br)
    import re

    found = [url_filter.Pattern.parse(p) for p in url_filter.PATTERN_RULES]
    hits = [p for p in found if re.search(p.regex(), url.lower(), re.DOTALL)]
    assert verdict == (bv or ("block" if hits and not any(p.allow for p in hits) else "allow"))


def test_only_candidates_run():
    f = url_filter.UrlFilter(patterns=[f"||site{i}." for i in range(500)])
    assert f.judge("http://site77.example.com/")[3] == "block" and f.ran == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["||", "|", "ads", "site", "1", "x.", "^", "*", "/", "a-b", "Q"]), min_size=1, max_size=6).map("".join), st.lists(st.sampled_from(["http://", "ads", "site", "1", "x.", ".", "/", "a-b", "?q", "Q", "-"]), max_size=9).map("".join))
def test_the_index_loses_no_pattern(rule, url):
    import re

    rules = [rule, *(f"||other{i}." for i in range(50))]
    f = url_filter.UrlFilter(site_rules=(), patterns=rules)
    p = url_filter.Pattern.parse(rule)
    assert (f.judge(url)[3] == "block") == bool(re.search(p.regex(), url.lower(), re.DOTALL))


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("! a comment\n[head]\n\n|http://exact.example/end|\n/Case/$match-case\n||big.\n" + "".join(f"||site{i}.example.\n" for i in range(2000)))
    rules = url_filter.read_rules(spark, str(tmp_path / "rules.txt"))
    assert len(rules) == 2003
    urls = ["http://exact.example/end", "http://exact.example/end2", "http://a/Case/b", "http://a/case/b", "http://site1999.example.org/", "http://site2000.example.org/", "http://x.big.y/" + "z" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {g.page_id: g.verdict for g in url_filter.filter_urls(df, (), rules).collect()}
    assert [got[i] for i in range(7)] == ["block", "allow", "block", "allow", "block", "allow", "block"]
    import pytest

    with pytest.raises(ValueError):
        url_filter.Pattern.parse("||x^$third-party")


def test_archives_by_size(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 20)
    rows = [(i, f"http://h{i}/a b", "s" * (50 + i)) for i in range(40)] + [(100, "http://m/%20x", "m" * 30_000), (101, "http://l/", "l" * 3_000_000), (102, "http://l2/", "k" * 2_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {g.page_id: g for g in warc.archive_pages(df).collect()}
    assert {i: g.payload_bytes for i, g in got.items()} == {i: len(h) for i, _, h in rows}
    assert got[0].url_key == "h0)/a%20b" and got[100].url_key == "m)/%20x"
    assert len({got[i].archive for i in (101, 102)}) == 2


def test_filter_table(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "http://x.net/", 1), (2, "http://x.net", 2), (2, "http://spam-farm.example.org/a", 3)], "page_id long, url string, host int")
    got = [(g.page_id, g.host, g.path, g.rule, g.verdict) for g in url_filter.filter_urls(df).collect()]
    assert got == [(1, "", "", None, "allow"), (None, "x.net", "/", "net/", "block"), (2, "x.net", "", None, "allow"), (2, "spam-farm.example.org", "/a", None, "block")]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_BYTES", 150_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {g.doc_id: g for g in imatch.fingerprint_documents(docs).collect()}
    by_text = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        by_text.setdefault(text, set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert np.mean([g.near_edited for g in got.values()]) > 10 * np.mean([g.near_next for g in got.values()])


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "a b c", "b"), (None, "", "c"), (7, "zz", "d"), (7, "zz", "d"), (3, "q w e r t y", "e")], "doc_id long, text string, fingerprint string")
    got = imatch.fingerprint_documents(df).collect()
    assert len(got) == 6 and len({g.fingerprint for g in got if g.doc_id == 7}) == 1
    assert imatch.fingerprint_documents(df.limit(0)).count() == 0
    one = imatch.fingerprint_documents(df.where("doc_id = 3")).first()
    assert one.edited_sha256 == hashlib.sha256(b"q w e r q w").hexdigest()
