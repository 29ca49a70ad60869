"""BPE and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowsentry.llm import bpe, packing, piece_bpe
from rowsentry.llm import kernels as K

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", " a", "a  b   c\n\n d", "x<|endoftext|> y <|endoftext|><|endoftext|>z", "\x1c a\x1d\x85b\xa0 c", "日本語 テスト 123 ½", "it's 's 'S don't", "a\t b \n", "é" * 50, "a" * 5000, "　 x y", "ΑΣ ΟΔΟΣ.", "İstanbul ǅ", "\x01 a \x01", "a ́x"]


@pytest.fixture(scope="module")
def codec():
    return bpe.loaded(BYTE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinrst \n\t'é日1.,<|>ofx\xa0"), max_size=60))
def test_bpe_equals_the_library(text):
    codec, library = bpe.loaded(BYTE), _library()
    ids = next(iter(codec.encode_column(pa.array([text])))).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


_kept = []


def _library():
    if not _kept:
        _kept.append(Tokenizer.from_file(BYTE))
    return _kept[0]


def test_bpe_on_odd_texts_and_cache_limits(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 8)
    monkeypatch.setattr(codec.numbers, "limit", 8)
    r = random.Random(1)
    texts = ODD + ["".join(r.choices("abcdefg \n'é1", k=60)) for _ in range(300)]
    got = [x.tolist() for x in codec.encode_column(pa.array(texts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts] == codec.encode_batch(texts)


@pytest.mark.parametrize("bits", [0, 3])
def test_words_that_share_a_hash(codec, library, monkeypatch, bits):
    whole = K.span_hashes
    monkeypatch.setattr(K, "span_hashes", lambda *a: whole(*a) & K.U(2**bits - 1))
    codec.numbers.clear()
    codec._forget()
    r = random.Random(7)
    texts = ODD + [" ".join("".join(r.choices("abcé", k=r.randrange(1, 12))) for _ in range(80)) for _ in range(40)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in codec.encode_column(pa.array(texts))] == want
    words, other = packing.WordEncoder(WORD), Tokenizer.from_file(WORD)
    for _ in range(2):
        assert [x.tolist() for x in words.encode(pa.array(texts))] == [other.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.undo()
    codec.numbers.clear()
    codec._forget()


def test_pair_check_against_merging(codec):
    import numpy as np

    r = np.random.default_rng(2)
    a, b = r.integers(0, len(codec.order), 4000), r.integers(0, len(codec.order), 4000)
    whole = np.array([codec._is_whole(int(x)) and codec._is_whole(int(y)) for x, y in zip(a, b)])
    want = np.array([codec.merge(codec.order[x] + codec.order[y]) == [x, y] for x, y in zip(a, b)])
    assert (codec.compatible(a, b)[whole] == want[whole]).all()


def test_digest_query(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "n"), (5, "twice"), (5, "twice"), (99, None)]
    got = bpe.digest_documents(spark.createDataFrame(rows, "doc_id long, text string"), BYTE).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i is not None else -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((g.doc_id if g.doc_id is not None else -1, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == sorted(want)
    one = bpe.encode_documents(spark.createDataFrame([(1, "a b<|endoftext|>")], "doc_id long, text string"), BYTE).first()
    assert one.decoded == "a b<|endoftext|>" and one.ids == library.encode("a b<|endoftext|>", add_special_tokens=False).ids


def test_word_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 50)
    r = random.Random(4)
    texts = ODD + ["".join(r.choices("abCdé́ \n\t'st1.,<|>endoftx\x01", k=r.randrange(150))) for _ in range(600)]
    library = Tokenizer.from_file(WORD)
    assert [x.tolist() for x in packing.WordEncoder(WORD).encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("histogram", [{1: 5}, {2048: 3}, {1024: 3, 1025: 3}, {n: 1 for n in range(1, 2048, 7)}, {n: 40 for n in range(100, 2048, 13)}, {}])
def test_plan_is_a_packing(histogram):
    plan = packing.make_plan(histogram, 2048, 60)
    bins, ranks = defaultdict(list), defaultdict(set)
    for length, rank, count, first, per, offset in plan.runs:
        for i in range(count):
            bins[first + i // per].append((offset + i % per * length, length))
            ranks[length].add(rank + i)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert Counter(n for own in bins.values() for _, n in own) == Counter(histogram)
    assert all(ranks[n] == set(range(c)) for n, c in histogram.items()) and len(bins) == plan.bins
    bound = -(-sum(n * c for n, c in histogram.items()) // 2048)
    assert plan.bins <= 1.02 * bound + 1 + sum(c for n, c in histogram.items() if n > 1024) * (len(histogram) < 5)


def test_knapsack_is_exact():
    import numpy as np

    lengths, values = np.array([3, 5, 7]), np.array([4.0, 7.0, 10.5])
    best = max(a * 4 + b * 7 + c * 10.5 for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 22)
    found = packing.knapsack(lengths, values, 22)
    assert sum(values[k] * n for k, n in found.items()) == pytest.approx(best) and sum(lengths[k] * n for k, n in found.items()) <= 22


def test_pack_documents(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choices(["alpha", "beta!", "Gamma"], k=r.choice([0, 1, 30, 700, 3000])))) for i in range(60)] + [(None, None), (5, "twice"), (5, "twice"), (61, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(5)
    got = packing.pack_documents(df, WORD, rounds=50).collect()
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[(i, p, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(df.limit(0), WORD).count() == 0


def fewest(lengths, capacity):
    """Sequences of an optimal packing, by search over subsets."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[k]:
                rest = list(rooms)
                rest[rest.index(r)] -= lengths[k]
                place(k + 1, rest)
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def check_plan(plan, histogram, capacity):
    used, times = Counter(), Counter()
    for length, _, count, first, per, offset in plan.runs:
        times[length] += count
        for k in range(count):
            used[first + k // per] += length
            assert offset + (k % per + 1) * length <= capacity
    assert times == Counter(histogram) and max(used.values()) <= capacity and len(used) == plan.bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9), st.integers(20, 30))
def test_plans_against_the_optimum(lengths, capacity):
    histogram = dict(Counter(lengths))
    plan = packing.make_plan(histogram, capacity)
    check_plan(plan, histogram, capacity)
    assert plan.bound <= fewest(lengths, capacity) <= plan.bins
    assert plan.bins <= fewest(lengths, capacity) + 1


def test_plans_are_never_worse_than_best_fit():
    import numpy as np

    better = 0
    for seed in range(12):
        r = np.random.default_rng(seed)
        x = [r.integers(1, 2048, 3000), np.minimum(r.lognormal(5.5, 1, 3000).astype(int) + 1, 2047), r.integers(400, 900, 3000), r.choice([683, 684, 682, 500, 1000, 1025, 300], 3000)][seed % 4]
        histogram = dict(Counter(x.tolist()))
        plan = packing.make_plan(histogram)
        check_plan(plan, histogram, 2048)
        alone = packing._finish(packing.Plan(2048), dict(histogram), packing._rooms(2048)).bins
        assert plan.bound <= plan.bins <= alone
        better += plan.bins < alone
    assert better


PIECES = public_tokenizers.path("piece_bpe_32k.model")
MARKS = ["▁a ▁", " ▁ ▁▁x", "<s> </s> <0x0A> <unk>", "a\0b", "日\ud7ff😀", "\ufffd", " ", "   ", " " * 90 + "x", "ab" * 400, "x\n y"]


@pytest.fixture(scope="module")
def pieces():
    return piece_bpe.PieceBpe(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinrst  \n\t'é日1.,<>▁😀\0\xa0"), max_size=90))
def test_pieces_equal_the_library(pieces, text):
    codec, library = pieces
    ids = codec.encode(text)
    assert ids == library.encode(text)
    assert codec.decode(ids) == library.decode(ids) == codec.spelling(np.array(ids, np.int64)).decode()
    assert codec.repaired == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 261), st.integers(0, 31999), st.sampled_from([0, 1, 2, 259, 28705, 3 + 0xE6, 3 + 0x97, 3 + 0xA5])), max_size=9))
def test_pieces_decode_any_ids(pieces, ids):
    codec, library = pieces
    assert codec.decode(ids) == library.decode(ids)


def test_pieces_on_odd_texts_and_cache_limits(pieces, monkeypatch):
    codec, library = pieces
    monkeypatch.setattr(codec.numbers, "limit", 8)
    monkeypatch.setattr(piece_bpe, "ROWS", 5)
    r = random.Random(1)
    texts = ODD + MARKS + ["".join(r.choices("abcdefg \n'é1▁", k=60)) for _ in range(300)]
    assert [x.tolist() for x in codec.encode_column(pa.array(texts))] == [library.encode(t) for t in texts]


def test_agendas_of_rows_and_heaps_agree(pieces):
    codec, _ = pieces
    r = random.Random(6)
    spans = [" " * r.randrange(1, 4) + "".join(r.choices("abehtinr日x", k=r.randrange(64))) for _ in range(400)]
    flat, count = codec.encode_spans(spans)
    heaps = [codec.merge_long(codec.symbol[[ord(c) for c in s]].tolist()) for s in spans]
    want, n = zip(*(codec._spelt_in_bytes(np.array(h), np.array([len(h)])) for h in heaps))
    assert flat.tolist() == [i for w in want for i in w.tolist()] and count.tolist() == [int(x[0]) for x in n]


def test_the_library_corrects_a_wrong_merge(pieces):
    codec = piece_bpe.PieceBpe(PIECES)
    codec.place = codec.place[::-1].copy()
    want = pieces[1].encode("the merging goes wrong here")
    assert codec.encode("the merging goes wrong here") == want and codec.repaired
    codec = piece_bpe.PieceBpe(PIECES, check=False)
    codec.place = codec.place[::-1].copy()
    assert codec.encode("the merging goes wrong here") != want


def test_piece_digests(spark, pieces):
    library = pieces[1]
    rows = [(i, t) for i, t in enumerate(ODD + MARKS)] + [(None, "n"), (5, "twice"), (5, "twice"), (99, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i if i is not None else -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = piece_bpe.digest_documents(docs, PIECES).collect()
    assert sorted((g.doc_id if g.doc_id is not None else -1, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == sorted(want)
    assert piece_bpe.digest_documents(docs.limit(0), PIECES).count() == 0
    one = piece_bpe.encode_documents(docs.where("doc_id = 5 AND text = 'twice'").limit(1), PIECES).first()
    assert one.decoded == "twice" and one.ids == library.encode("twice")


def test_passes_of_the_program_close_the_gap():
    r = np.random.default_rng(1)
    histogram = dict(Counter(r.integers(300, 1026, 20_000).tolist()))
    plan = packing.make_plan(histogram)
    check_plan(plan, histogram, 2048)
    alone = packing._finish(packing.Plan(2048), dict(histogram), packing._rooms(2048)).bins
    assert plan.share > 0.8 and plan.bins <= 1.005 * plan.bound and plan.bins < 0.97 * alone
    mixed = dict(Counter(np.minimum(r.lognormal(6.2, 0.8, 300_000).astype(int) + 1, 2048).tolist()))
    plan = packing.make_plan(mixed)
    alone = packing._finish(packing.Plan(2048), dict(mixed), packing._rooms(2048)).bins
    assert plan.share > 0.5 and plan.bound <= plan.bins < alone and plan.bins <= 1.0005 * plan.bound
