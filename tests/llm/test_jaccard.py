import random
import re

import pytest

from rowsentry.llm.jaccard_join import jaccard_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and 100 * len(a & b) >= 80 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(x for x in comp[find(i)]), links[i]) for i, (d, _) in enumerate(rows))


def corpus(seed, n_base=40, hot=0):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    rows, out = [], []
    passage = r.choices(vocab, k=60)
    for k in range(n_base):
        base = r.choices(vocab, k=r.choice([1, 3, 4, 7, 8, 9, 12, 15, 20, 40, 80, 200, 400]))
        if k % 3 == 0:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(r.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, len(base) // 40, len(base) // 25])):
                op, at = r.choice("ids"), r.randrange(len(copy)) if copy else 0
                if op == "i":
                    copy.insert(at, r.choice(vocab))
                elif copy:
                    copy[at : at + 1] = [] if op == "d" else [r.choice(vocab)]
            rows.append(" ".join(copy).title())
    base = r.choices(vocab, k=120)
    for _ in range(hot):
        copy = list(base)
        for _ in range(r.randrange(6)):
            copy[r.randrange(120)] = r.choice(vocab)
        rows.append(" ".join(copy))
    rows += ["", "  \n", "One", "one"]
    r.shuffle(rows)
    for i, t in enumerate(rows):
        out.append((i * 3 + 1, t))
    return out


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 90), (3, 300)])
def test_matches_brute_force(spark, seed, hot):
    rows = corpus(seed, hot=hot)
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in got) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [(5, None, "x"), (4, "", "y"), (3, "a b c d e f", None), (None, "A b c d e f", "z"), (9, "a b c d e f", "z"), (9, "a b c d e f", "z"), (7, long, "n"), (8, long + " more", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((x.doc_id or -1, x.n_shingles, x.component_id, x.n_links) for x in jaccard_groups(df).collect())
    assert got == [(-1, 2, 3, 3), (3, 2, 3, 3), (4, 0, 4, 0), (5, 0, 5, 0), (7, 29996, 7, 1), (8, 29997, 7, 1), (9, 2, 3, 3), (9, 2, 3, 3)]
    assert jaccard_groups(df.limit(0)).count() == 0
