import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import ODD, documents
from tokenizers import Tokenizer, normalizers

from quern.llm import rans as R
from quern.llm import words as W


@pytest.mark.parametrize("n,symbols", [(0, 1), (1, 1), (5, 3), (511, 9), (513, 2), (200_000, 1), (200_000, 40_000), (300_000, 100)])
def test_round_trip(n, symbols):
    r = np.random.default_rng(n + symbols)
    ids = (r.zipf(1.3, n) % symbols).astype(np.uint32)
    image = R.pack([3, None], [n, 0], ids)
    s = R.Shard(image)
    assert (s.ids() == ids).all() and s.doc_ids == [3, None] and s.lengths.tolist() == [n, 0]
    if n > R.BLOCK:
        assert (s.block(1) == ids[R.BLOCK : 2 * R.BLOCK]).all()


def test_size_is_near_the_entropy():
    ids = np.random.default_rng(1).zipf(1.5, 400_000).clip(max=5000).astype(np.uint32)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = -(p * np.log2(p)).sum() * len(ids)
    assert len(R.pack([1], [len(ids)], ids)) * 8 < 1.08 * bits + 64 * 5000


def test_checksums():
    image = bytearray(R.pack([1], [1000], np.arange(1000, dtype=np.uint32)))
    for at in (30, len(image) - 5):
        broken = image.copy()
        broken[at] ^= 1
        with pytest.raises(ValueError):
            R.Shard(bytes(broken)).ids()


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "SHARD", 2000)
    texts = ODD + ["the cat and the hat"] * 50
    documents(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in R.op7_tokens_rans(spark, str(tmp_path)).collect()}
    t = Tokenizer.from_file(public_tokenizers.path(R.TOKENIZER))
    start = 0
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (rows[k].start, rows[k].n_tokens) == (start, len(ids))
        assert rows[k].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_special_tokens_as_the_library_takes_them():
    t = Tokenizer.from_file(public_tokenizers.path(R.TOKENIZER))
    texts = ["<|endoftext|>", "a <|endoftext|> word.", "end.<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext", "plain words.", None, "plain words."]
    found = R.tokenizer(public_tokenizers.path(R.TOKENIZER)).ids(texts)
    assert [x.tolist() for x in found] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_plain_words_go_to_the_model_as_the_library_takes_them(tmp_path):
    path = public_tokenizers.path(R.TOKENIZER)
    t = Tokenizer.from_file(path)
    every = "".join(c for c in map(chr, range(0x250)) if R._LETTERS(c) and c != " ")
    words = [lead + every[k : k + n] for k in range(len(every) - 4) for n in (1, 4) for lead in ("", " ")] + [" antidisestablishmentarianism"] * 2
    assert all(R._LETTERS(w) for w in words) and not any(R._LETTERS(w) for w in ("", " ", "  a", "a b", "a1", "it's", " x.", "×", "a\n"))
    found = R.tokenizer(path)
    assert found.learn.__name__ == "learn"
    others = [" 12", "日本", " x.!", "%%%"]
    got = [np.frombuffer(x, found.kind).tolist() for x in found.learn(words + others + words[:3])]
    assert got == [t.encode(w, add_special_tokens=False).ids for w in words + others + words[:3]]
    # a tokenizer that does more to a word, or has words of its own, gets all units
    t.normalizer = normalizers.Lowercase()
    t.save(f"{tmp_path}/lower.json")
    t.normalizer = None
    t.add_tokens(["abc"])
    t.save(f"{tmp_path}/own.json")
    for name in ("lower", "own"):
        own = Tokenizer.from_file(f"{tmp_path}/{name}.json")
        texts = ["The Abc abc xabcx", "QUITE so"]
        assert [x.tolist() for x in R.tokenizer(f"{tmp_path}/{name}.json").ids(texts)] == [own.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_merge_apart_though_many_go_in_one_call(tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path(R.TOKENIZER))
    r = np.random.default_rng(7)
    letters = [*"thetionaingersoTHE", "é", "ÿ", "Ā", "ɏ"]
    new = list(dict.fromkeys(" " * int(r.integers(2)) + "".join(r.choice(letters, r.integers(1, 12))) for _ in range(3 * R.TOGETHER + 7)))
    found = R.tokenizer(None)
    assert found.learn.__name__ == "learn" and found.learn([]) == []
    for some in (new, new[: R.TOGETHER], new[:1]):
        assert [np.frombuffer(x, found.kind).tolist() for x in found.learn(some)] == [t.encode(u, add_special_tokens=False).ids for u in some]
    # where the bar is in another token, or whole words are looked up before they are merged, the library gets all units
    own = json.loads(t.to_str())
    own["model"]["vocab"]["ÿa"] = 50300
    own["model"]["merges"].append(["ÿ", "a"])
    (tmp_path / "bar.json").write_text(json.dumps(own))
    own = json.loads(t.to_str())
    own["model"]["ignore_merges"] = True
    (tmp_path / "ignore.json").write_text(json.dumps(own))
    for name in ("bar", "ignore"):
        assert R.tokenizer(f"{tmp_path}/{name}.json").learn.__name__ == "whole"


def test_random_texts_as_the_library_takes_them():
    t = Tokenizer.from_file(public_tokenizers.path(R.TOKENIZER))
    r = np.random.default_rng(5)
    parts = ["the", "don", "'s", "'", "***", ".,", "%%%", "é", "ÿ", "日本", "12", " ", " ", " ", "\n", "ing", "(", "x\u0301", "\t", "_"]
    texts = [*ODD, *("".join(r.choice(parts, r.integers(0, 30))) for _ in range(3000))]
    assert sum(W.spaced(x) for x in texts if x) > 100
    found = R.tokenizer(None).ids(texts)
    assert [x.tolist() for x in found] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_units_are_looked_up_once_for_many_texts():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    learned = []

    def learn(new):
        learned.extend(new)
        return [np.frombuffer(u.encode(), "u1").astype("<u4").tobytes() for u in new]

    cache = W.UnitCache(learn)
    cache.number = Counted()
    texts = ["one two***", "two one\ntwo***", None, "", "one***"] * 500
    found = cache.ids(texts)
    assert [bytes(x.tolist()).decode() for x in found] == [x or "" for x in texts]
    assert Counted.asked < 20
    # a word that ends in marks is put together from the word and the marks
    assert sorted(learned) == ["\n", " one", " two", "***", "one", "two"]
    assert cache.met[cache.number["one"]] == 500 and cache.met[cache.number["\n"]] == 500


def test_empty_table_repeated_and_null_ids(spark):
    docs = documents(spark, ["a b", "c", None])
    assert R.read_shards(R.write_shards(docs.where("false"))).count() == 0
    odd = spark.createDataFrame([(None, "x"), (1, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    rows = R.read_shards(R.write_shards(odd)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1] and [r.start for r in rows] == [0, 2, 4, 6]
