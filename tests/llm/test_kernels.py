"""Hashes and comparisons of spans of bytes."""

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowsentry.llm import kernels as K
from rowsentry.llm.bpe import digest_documents, encode_documents
from rowsentry.llm.imatch import fingerprint_documents
from rowsentry.llm.jaccard_join import jaccard_groups
from rowsentry.llm.packing import tokenized_pieces
from rowsentry.llm.quality_rules import quality_rules
from rowsentry.llm.substring_dedup import report


def thue_morse(n: int, a: str = "a", b: str = "b") -> tuple[str, str]:
    """Two sequences of n letters that any polynomial hash modulo a power of two confuses."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def test_structured_words_have_hashes_of_their_own():
    words = [w for n in (8, 16, 64, 65, 1024, 2048, 4096) for w in thue_morse(n)] + ["a", "b", "ab", "ba", "a" * 8, "a" * 9, "a" * 64]
    chunk = next(K.chunks(pa.array([" ".join(words)])))
    start, end, _ = chunk.words()
    assert len(set(chunk.hashes(start, end).tolist())) == len(set(words)) == len(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=20), min_size=1, max_size=30))
def test_equal_spans(words):
    words += ["a" * 5000, "a" * 4999 + "b", "a" * 5000]
    data = "".join(words).encode()
    import numpy as np

    view = K.lanes(np.frombuffer(data, np.uint8))
    size = np.array([len(w) for w in words])
    at = np.cumsum(size) - size
    for k in range(len(words)):
        got = K.equal_spans(view, at, size, view, np.full(len(words), at[k]), np.full(len(words), size[k]))
        assert got.tolist() == [w == words[k] for w in words]


def test_operators_tell_structured_words_apart(spark):
    texts = list(thue_morse(2048)) + [" ".join(t) for t in thue_morse(256)] + [" ".join(f"{x}{k % 3}" for k in range(40)) for x in thue_morse(64)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.ids for r in encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert [got[i] for i in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert digest_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select("ids_sha256").distinct().count() == len(texts)
    pieces = tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.ids for r in pieces.where("piece = 0").collect()} == {i: ([*words.encode(t, add_special_tokens=False).ids, 0])[:2048] for i, t in enumerate(texts)}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in texts]
    linked = {r.doc_id: r.component_id for r in jaccard_groups(docs).collect()}
    for i in (0, 1, 4, 5):
        assert all(linked[i] != linked[j] or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(len(texts)) if j != i)
    prints = [r.fingerprint for r in fingerprint_documents(docs).orderBy("doc_id").collect()]
    assert prints[0] != prints[1]
    removed = {r.doc_id: r.removed_words for r in report(docs).collect()}
    assert removed[0] == removed[1] == 0
    lines = spark.createDataFrame([(0, "\n".join(thue_morse(2048)))], "doc_id long, text string")
    assert quality_rules(lines, spark.createDataFrame([], "doc_id long, quality int")).first().n_dup_lines == 0
