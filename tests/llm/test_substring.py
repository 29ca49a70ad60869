"""Repeated passages: planted ones are found, clean documents are left alone."""

import random

from rowsentry.llm import substring_dedup as D


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(5000)]
    passages = [" ".join(r.choices(vocab, k=r.randrange(51, 120))) for _ in range(12)]
    rows, users = [], {}
    for i in range(120):
        w = r.choices(vocab, k=r.randrange(40, 300))
        text = " ".join(w)
        if i % 3 == 0:
            p, k, sep = r.randrange(12), r.randrange(len(w) + 1), r.choice([" ", "\n"])
            text = " ".join(w[:k]) + sep + passages[p] + sep + " ".join(w[k:])
            users.setdefault(p, []).append(i)
        rows.append((i, text.strip(), len(text.strip())))
    return rows, users, passages


def test_planted_passages(spark):
    rows, users, passages = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(4)
    got = {x.doc_id: x for x in D.report(df).collect()}
    later = {d for u in users.values() for d in u[1:]}
    for u in users.values():
        for d in u[1:]:
            assert got[d].removed_words >= 24 and u[0] in got[d].kept_by and got[d].component_id == got[u[0]].component_id
    for i, text, n in rows:
        if i not in later:
            assert got[i].removed_words == 0
    out = {x.doc_id: x for x in D.remove_repeats(df).collect()}
    for i, text, _ in rows:
        if i not in later:
            assert out[i].text == text
        elif i in out:
            assert len(out[i].text) < len(text) and out[i].n_chars == len(out[i].text)
    for p, u in users.items():
        assert not any(d in out and passages[p] in out[d].text for d in u[1:])


def test_edges(spark):
    r = random.Random(2)
    long = " ".join(r.choices([f"a{k}" for k in range(900)], k=30000))
    copy = " ".join(r.choices([f"b{k}" for k in range(900)], k=90))
    base = r.choices([f"c{k}" for k in range(900)], k=60)
    edited = [*base[:20], "EDIT", *base[21:]]
    rows = [(1, copy, "x"), (2, copy, "y"), (2, copy, "y"), (3, None, None), (4, "", ""), (None, "x y z", ""), (5, "short text", ""), (6, "short text", ""), (7, "For " * 80, ""), (8, "aa\n" + " ".join(base) + "\nbb", ""), (9, "cc\n" + " ".join(edited) + "\ndd", ""), (10, long, ""), (11, "head " + long, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {}
    for x in D.report(df).collect():
        got.setdefault(x.doc_id, x)
    assert got[1].removed_words == 0 and got[2].removed_words == 90 and got[2].kept_by == [1]
    assert all(got[i].removed_words == 0 for i in (3, 4, None, 5, 6, 7, 8))
    assert got[9].removed_words >= 50 and got[9].component_id == 8
    assert got[11].removed_words > 29900
    out = D.remove_repeats(df)
    assert out.columns == df.columns
    left = {x.doc_id: x.text for x in out.collect()}
    assert 2 not in left and left[9] == "cc\ndd" and left[3] is None and left[5] == left[6] == "short text"
    assert D.report(df.limit(0)).count() == 0 and D.remove_repeats(df.limit(0)).count() == 0


def test_bands_reach_their_recall():
    for hashes, recall in ((24, 0.99), (6, 0.95)):
        bands, rows = D.tune(hashes, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= hashes


def test_many_edited_copies_of_a_line(spark):
    r = random.Random(8)
    base = r.choices([f"w{k}" for k in range(5000)], k=50)
    lines = [base] + [[*base[:k], f"edit{i}", *base[k + 1 :]] for i in range(300) for k in [r.randrange(20, 30)]]
    grams = [{tuple(x[k : k + 5]) for k in range(46)} for x in lines]
    for g in grams[1:]:
        assert 100 * len(g & grams[0]) >= 80 * len(g | grams[0])
    # the original comes last, so that no order of ids brings it to the others first
    rows = [(1000 - i, " ".join(x)) for i, x in enumerate(lines)]
    got = {x.doc_id: x for x in D.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {x.component_id for x in got.values()} == {700}
    assert [i for i, x in got.items() if x.removed_words == 0] == [700]


def test_whole_planted_passages_go(spark):
    r = random.Random(6)
    rows, own, sizes = [], {}, {}
    for i in range(60):
        words = [f"d{i}x{k}" for k in range(r.randrange(40, 200))]
        p, k = i % 12, r.randrange(len(words) + 1)
        passage = [f"p{p}x{j}" for j in range(51 + 5 * p)]
        rows.append((i, " ".join(words[:k] + passage + words[k:])))
        own[i], sizes[i] = words, len(passage)
    # the first text has only the middle of a passage that the second and the third have whole
    long = [f"q{j}" for j in range(90)]
    for i, (part, name) in enumerate(((long[12:78], "e"), (long, "f"), (long, "g"))):
        own[100 + i] = [f"{name}{k}" for k in range(60)]
        rows.append((100 + i, " ".join(own[100 + i][:30] + part + own[100 + i][30:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in D.report(df).collect()}
    out = {x.doc_id: x.text.split() for x in D.remove_repeats(df).collect()}
    # a passage that reaches two words beyond the repeat at one end is still similar at 0.8
    for i in range(12, 60):
        assert set(out[i]) <= set(own[i]) and len(own[i]) - len(out[i]) <= 4 and i % 12 in got[i].kept_by
        assert got[i].removed_words == len(own[i]) + sizes[i] - len(out[i])
    assert not set(out[101]) & set(long[12:78]) and set(long[:10] + long[80:]) <= set(out[101]) and 100 in got[101].kept_by
    assert set(out[102]) <= set(own[102]) and len(out[102]) >= 56 and {100, 101} <= set(got[102].kept_by)
    assert all(got[i].removed_words == 0 for i in [*range(12), 100])


def brute_lines(rows, least, percent=80):
    """Lines of each document that a similar line of an earlier one, or of the earlier ones' component, stands for."""
    lines, grams = [], []
    for doc, text in rows:
        for line in text.split("\n"):
            w = line.lower().split()
            if len(w) >= least:
                lines.append((doc, len(w)))
                grams.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, g in enumerate(grams):
        for j in range(i):
            if 100 * len(g & grams[j]) >= percent * len(g | grams[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    first = {}
    for i, (doc, _) in enumerate(lines):
        first[find(i)] = min(first.get(find(i), doc), doc)
    gone = {}
    for i, (doc, n) in enumerate(lines):
        if first[find(i)] < doc:
            gone[doc] = gone.get(doc, 0) + n
    return gone


def test_near_copies_of_lines_against_brute_force(spark):
    r = random.Random(12)
    vocab = [f"w{k}" for k in range(4000)]
    base = [r.choices(vocab, k=r.randrange(28, 90)) for _ in range(40)]
    rows = []
    for i in range(160):
        own = [" ".join(r.choices(vocab, k=r.randrange(3, 60))) for _ in range(2)]
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, "\n".join([own[0], " ".join(w), own[1]])))
    want = brute_lines(rows, 25)
    got = {x.doc_id: x.removed_words for x in D.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert sum(want.values()) > 2000
    # every removal that Jaccard calls for, but for what banding misses; beyond that only verbatim repeats
    assert sum(min(got[i], n) for i, n in want.items()) >= 0.97 * sum(want.values())
    assert sum(got[i] > 0 for i in want) >= 0.97 * len(want)


def test_verbatim_repeats_against_brute_force(spark):
    r = random.Random(13)
    vocab = [f"v{k}" for k in range(3000)]
    shared = [r.choices(vocab, k=r.randrange(47, 90)) for _ in range(20)]
    rows, inside = [], {}
    for i in range(100):
        w = r.choices(vocab, k=r.randrange(60, 200))
        p, k = i % 20, r.randrange(30, 60)
        rows.append((i, " ".join([*w[:k], *shared[p], *w[k:]])))
        inside[i] = len(shared[p])
    got = {x.doc_id: x.removed_words for x in D.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(got[i] == 0 for i in range(20)) and all(inside[i] <= got[i] <= inside[i] + 2 for i in range(20, 100))


def test_short_lines_by_parameter_and_odd_rows(spark):
    r = random.Random(14)
    line = " ".join(f"s{k}" for k in range(20))
    rows = [(i, "\n".join([" ".join(f"o{i}x{k}" for k in range(12)), line, f"end{i}"])) for i in range(50)]
    near = r.choices([f"n{k}" for k in range(900)], k=70)
    rows += [(None, " ".join(near)), (None, " ".join(near[:69])), (60, " ".join(near)), (60, "u" + " ".join(f"q{k}" for k in range(40))), (61, "h " + " ".join(f"q{k}" for k in range(40)))]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, of_changes int, node string, x_runs int").repartition(3)
    by_default = {x.doc_id: x.removed_words for x in D.report(df).where("doc_id < 50").collect()}
    assert set(by_default.values()) == {0}
    out = D.remove_repeats(df, least_words=20)
    assert out.columns == df.columns
    left = [(x.doc_id, x.text) for x in out.collect()]
    assert sorted(i for i, t in left if i is not None and i < 50 and line in t) == [0]
    # null ids come last, so the named row keeps the text; what repeats 60's second text goes whole as a similar line
    assert [t for i, t in left if i is None] == [] and sum(i == 60 for i, _ in left) == 2
    assert all(i != 61 for i, _ in left)
