"""Quality rules, the quality classifier and toxicity, on held-out rows and against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rowsentry.llm import quality_fm, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sf(name, spark):
    return spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


ODD = [None, "", " \n\t", "a", "a b c d e f a b c d e f", "x|y ## é é\n\né é\n é é", "no. " * 40, "ab\x0bcd\x1cef", "日本 語 日本 語", "w " * 50000]


def test_rule_statistics(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "q w e"), (3, "twice"), (3, "twice")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = quality_rules.quality_rules(df, labels).collect()
    want = sorted((i if i is not None else -1, *brute_counts(t)) for i, t in rows)
    assert sorted((g.doc_id if g.doc_id is not None else -1, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words)
        assert g.kept == (not g.base_failed)  # no labels: the base rules alone
    assert quality_rules.quality_rules(df.limit(0), labels).count() == 0


def test_rule_statistics_of_the_table(spark):
    docs = sf("documents", spark)
    got = {g.doc_id: g for g in quality_rules.quality_rules(docs, sf("labels", spark)).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == brute_counts(r.text)
    quality = {r.doc_id: r.quality for r in sf("labels", spark).collect()}
    kept = {0: [], 1: []}
    for i, q in quality.items():
        kept[q].append(got[i].kept)
    assert np.mean(kept[1]) > 0.93 and np.mean(kept[0]) < 0.1
    assert quality_rules.keep_documents(docs, sf("labels", spark)).count() == sum(g.kept for g in got.values())


def test_quality_on_held_out_rows(spark):
    docs, labels = sf("documents", spark), sf("labels", spark)
    got = {g.doc_id: g for g in quality_fm.score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    right = []
    for r in labels.collect():
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= g.score <= 1 and g.predicted == (g.score >= 0.5)
        if g.held_out:
            right.append(g.predicted == r.quality)
    assert np.mean(right) > 0.95


def test_sum_of_squares_identity():
    m = quality_fm.FactorisationMachine.new(size=50, rank=4)
    m.linear[:] = np.random.default_rng(1).normal(size=50)
    f, v = np.array([3, 7, 9, 20]), np.array([0.5, 1.0, 2.0, 0.1])
    pairs = sum(m.factors[f[i]] @ m.factors[f[j]] * v[i] * v[j] for i in range(4) for j in range(i))
    z, _ = m.logits(1, np.zeros(4, int), f, v)
    assert z[0] == pytest.approx(m.bias + m.linear[f] @ v + pairs)


def toxic_corpus():
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdefghi", k=r.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = r.choices(vocab, k=r.randrange(10, 80))
        bad = i % 6 == 0
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["zounds", "zoundsy", "quagmire", "Quagmirex,"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_finds_planted_words_and_misspellings(spark):
    rows, labels = toxic_corpus()
    extra = [(2000, "aab zoundss abc"), (2001, "bca quagmiire abd"), (2002, None), (2003, ""), (2004, "123 ###"), (None, "zounds")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(4)
    got = {g.doc_id: g for g in toxicity.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i].held_out]
    assert held == [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    clean = max(got[i].score for i in held if not truth[i])
    assert got[2000].score > 0.3 or got[2000].score > clean
    assert all(got[i].predicted == 0 for i in (2002, 2003, 2004)) and got[None].predicted == 1 and not got[None].held_out


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality_fm.score_quality(df, none).collect()} == {1}
    assert {r.predicted for r in toxicity.score_toxicity(df, none).collect()} == {0}
    assert quality_fm.score_quality(df.limit(0), none).count() == 0 and toxicity.score_toxicity(df.limit(0), none).count() == 0


def test_training_and_scoring_share_their_words():
    import pyarrow as pa

    from rowsentry.llm import kernels as K

    texts = ["good\u00a0zounds a1b, zounds!", None, "", "123 ##", "É é\u2003x"]
    chunk = next(K.chunks(pa.array(texts)))
    w = toxicity.words_of(chunk)
    own = [sorted(w.words[k] for k in w.word[w.row == i]) for i in range(5)]
    assert own == [["ab", "good", "zounds"], [], [], [], ["x", "é"]]


def test_softmax_step_against_finite_differences():
    model = toxicity.SubwordSoftmax.new()
    words, y = ["zounds", "meadow", "ab"], np.array([1.0, 0.0, 0.0], np.float32)
    at, bucket = toxicity.bags(words)

    def loss(m):
        z = m.word_logits(words)
        return float(np.log1p(np.exp(np.where(y == 1, -z, z))).sum())

    before = loss(model)
    z = model.word_logits(words)
    brute = [sum(float(model.vectors[b] @ (model.weights[:, 1] - model.weights[:, 0])) for b in bucket[at == i]) / (at == i).sum() + float(model.bias[1] - model.bias[0]) for i in range(3)]
    assert z == pytest.approx(brute, rel=1e-4)
    for _ in range(20):
        model.step(at, bucket, 3, y, np.ones(3, np.float32), 0.05, np.zeros(toxicity.BUCKETS, np.float32))
    assert loss(model) < before


def test_path_length_against_brute_force():
    r = np.random.default_rng(4)
    x = r.random((200, 5))
    forest = quality_rules.IsolationForest.fit(x, (np.zeros(5), np.ones(5)), trees=7, points=64)

    def walk(tree, row):
        at = 0
        while forest.feature[tree, at] >= 0:
            at = forest.child[tree, at][int(row[forest.feature[tree, at]] >= forest.split[tree, at])]
        return forest.length[tree, at]

    assert forest.path_length(x) == pytest.approx([np.mean([walk(t, row) for t in range(7)]) for row in x])


def test_odd_rows_for_classifiers(spark):
    rows = [(i, t, "s", 1.0) for i, t in [(1, "a " * 60_000), (2, None), (3, ""), (4, "a b"), (4, "a b"), (4, "other text"), (None, "x")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, held_out double")
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (quality_fm.score_quality, toxicity.score_toxicity):
        got = f(df, labels).collect()
        assert len(got) == 7 and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
        assert len({g.score for g in got if g.doc_id == 4}) <= 2


def test_a_repeated_label_id_stays_bounded(spark):
    from rowsentry.llm.labelled import sample

    df = spark.range(3000).selectExpr("if(id < 2500, 1, id) AS doc_id", "'t' AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    assert sample(df, labels, "toxic", max_rows=100).count() == 100


def test_the_driver_gets_packed_features(spark, monkeypatch):
    """Long texts of many words: before, 6000 of them were more than the driver takes as results."""
    import pyarrow as pa

    from rowsentry.llm import kernels as K

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(20_000)) for _ in range(8)] + ["", "one word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    got = []
    monkeypatch.setattr(quality_fm.FactorisationMachine, "fit", lambda self, rows, y: got.extend(rows))
    quality_fm.fit(docs, labels)
    ids = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(got) == len(ids) > 3
    for packed, i in zip(got, ids, strict=True):
        _, feature, value = quality_fm.features(next(K.chunks(pa.array([texts[i]]))))
        there, value_there = quality_fm.unpack(packed)
        assert (there == feature).all() and (value_there == value.astype(np.float32)).all()
        assert len(packed) <= 2 * feature.size + 100, "8 bytes a feature before"
