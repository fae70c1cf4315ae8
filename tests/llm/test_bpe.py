import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from boundwright.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  ", "a  b", "x \n\n y\n", "foo\n \nbar ", "it's we'll", "Ciónue. ñez, 123 45%%% ***", "a" * 3000, "ab" * 50_000, "é" * 700, "\x00\x1f", "語" * 90 + " 🙂🙃", "w " * 5000, "trailing \t ", "　a  b"]


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(texts):
    return [np.frombuffer(x, dtype=np.int32).tolist() for x in bpe.vocabulary(PATH, P.PATTERN).encode(texts)]


def test_chunks_of_few_texts_are_held_at_once(exact, monkeypatch):
    own, met = bpe.Vocabulary(PATH, P.PATTERN), []
    merge = own.merge
    monkeypatch.setattr(own, "merge", lambda words: met.append(len(words)) or merge(words))
    texts = [f"word{i}q" for i in range(1000)]
    assert [np.frombuffer(x, dtype=np.int32).tolist() for x in own.encode(texts)] == [exact.encode_ordinary(x) for x in texts]
    assert max(met) <= 3 * 200 and own.encode([]) == []


def test_odd_texts(exact):
    assert ids(ODD) == [exact.encode_ordinary(x) for x in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("  \n\tabtheing.'s1")), st.characters(codec="utf-8")), max_size=200))
def test_any_text(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))} if not hasattr(test_any_text, "e") else None
    if ranks:
        test_any_text.e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids([text]) == [test_any_text.e.encode_ordinary(text)]


def test_both_trees_agree():
    own = bpe.vocabulary(PATH, P.PATTERN)
    words = [b"thleandmoron", b"x", b"abababab" * 6, "ciónarmenteñ".encode(), b"aaaaaaaaaaaaaaaaaaaaaaa"]
    assert [np.frombuffer(x, dtype=np.int32).tolist() for x in own.merge_rows(words, 64)] == [own.merge_long(w) for w in words]


def test_query_equals_tiktoken(spark, sf_dir, exact):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bpe.op10_bpe_round_trip(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        want = exact.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_nulls_empties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "x", 5), (None, "", "y", 6), (1, "a b", "z", 7), (1, "a b", "z", 7)], "doc_id long, text string, ids string, n_tokens long")
    got = sorted(bpe.digests(docs).select("n_tokens", "ids_sha256").collect())
    nothing = hashlib.sha256(b"").hexdigest()
    assert [r.n_tokens for r in got] == [0, 0, 2, 2] and got[0].ids_sha256 == nothing == got[1].ids_sha256
    assert bpe.digests(docs.limit(0)).collect() == []


def test_names_and_other_patterns(spark):
    docs = spark.createDataFrame([(1, "a b", "own")], "doc_id long, text string, IDS string")
    with pytest.raises(ValueError):
        bpe.encoded(docs, PATH, P.PATTERN)
    row = bpe.encoded(docs, PATH, P.PATTERN, ids="n", decoded="back").first()
    assert row.IDS == "own" and bytes(row.back) == b"a b" and len(row.n) == 2
    assert bpe.CUTTABLE == P.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    other = "[a-z]+ ?|[^a-z]+"
    want = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=ranks, special_tokens={})
    for x in ("the end of it. Yes,  no", "", "A b c. d, e"):
        assert np.frombuffer(bpe.Vocabulary(PATH, other).encode([x])[0], dtype=np.int32).tolist() == want.encode_ordinary(x)
