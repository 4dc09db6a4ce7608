import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from fixtures import ODD, documents

from quern.llm import bpe as B


@pytest.fixture(scope="module")
def bpe():
    return B.Bpe(public_tokenizers.path(B.VOCABULARY))


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_odd_texts(bpe, library):
    for t in ODD:
        assert bpe.encode([t])[0].tolist() == library.encode_ordinary(t or "")


def test_random_texts(bpe, library):
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(" \n\t'aslretvmd1.é漢́\x85　\xa0 ") for _ in range(r.randint(1, 30)))
        assert bpe.encode([t])[0].tolist() == library.encode_ordinary(t), repr(t)


def test_one_tree_and_many_agree(bpe):
    r = random.Random(3)
    for _ in range(200):
        s = bytes(r.choice(b"abthe in") for _ in range(r.randint(2, 300)))
        width = 1 << max(2, (len(s) - 1).bit_length())
        import numpy as np

        assert bpe.merge_one(s) == np.frombuffer(bpe.merge_many([s, s], width)[1], bpe.kind).tolist()


def test_small_cache_changes_nothing(library):
    small = B.Bpe(public_tokenizers.path(B.VOCABULARY))
    small.cache.most = 3
    for t in ["the cat sat on the mat and the hat", "on the mat of the cat"] * 3:
        assert small.encode([t, t])[1].tolist() == library.encode_ordinary(t)


def test_cache_keeps_what_is_met_again(library):
    small = B.Bpe(public_tokenizers.path(B.VOCABULARY))
    small.cache.most = 40
    r = random.Random(5)
    for _ in range(60):
        t = " ".join(["the", "cat", "sat.", *(f"w{r.randint(0, 10**6)}" for _ in range(15))])
        assert small.encode([t])[0].tolist() == library.encode_ordinary(t)
    assert " cat" in small.cache.number and len(small.cache.number) < 100


def test_ids_outside_the_vocabulary(bpe):
    for ids in ([bpe.size], [-1]):
        with pytest.raises(KeyError):
            bpe.decode(ids)


def test_query(spark, tmp_path, library):
    documents(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in B.op1_byte_bpe(spark, str(tmp_path)).collect()}
    assert len(rows) == len(ODD)
    for k, t in enumerate(ODD):
        ids = library.encode_ordinary(t or "")
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_decode_and_empty_table(spark):
    docs = documents(spark, ODD)
    back = {r.doc_id: bytes(r.decoded) for r in B.decode(B.encode(docs)).collect()}
    assert back == {k: (t or "").encode() for k, t in enumerate(ODD)}
    assert B.encode(docs.where("false")).count() == 0
    one = spark.createDataFrame([(None, [1, 2]), (1, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: len(r.decoded) for r in B.decode(one).collect()}[1] == 0
