import hashlib

import numpy as np
import pytest
from fixtures import ODD, documents
from pyspark.sql import functions as F

from quern.llm import suffixes as S


def gone_bytes(texts, n=50):
    """(text's bytes, flags of removed ones) of each text, by a dictionary of all strings."""
    raw = [(t or "").encode() for t in texts]
    first = {}
    for k, t in enumerate(raw):
        for i in range(len(t) - n + 1):
            first.setdefault(t[i : i + n], k)
    for k, t in enumerate(raw):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < k:
                gone[i : i + n] = True
        yield t, gone


def kept_bytes(texts):
    return [bytes(b for b, g in zip(t, gone, strict=False) if not g) for t, gone in gone_bytes(texts)]


def brute(texts):
    """(place, bytes, removed, runs, kept's digest) of each text."""
    kept = kept_bytes(texts)
    return [(k, len(t), int(g.sum()), int((g[1:] & ~g[:-1]).sum() + g[0]), hashlib.sha256(kept[k]).hexdigest()) for k, (t, g) in enumerate(gone_bytes(texts))]


def corpus(seed):
    """Passages that start and end anywhere, copies with changes, repeats within a document, one letter runs."""
    r = np.random.default_rng(seed)
    letters = list("abcdeé ")
    text = lambda n: "".join(r.choice(letters, n))
    passages = [text(int(r.integers(40, 200))) for _ in range(12)] + ["ab" * 60, "z" * 130]
    out = []
    for _ in range(150):
        parts = []
        for _ in range(int(r.integers(1, 6))):
            p = passages[int(r.integers(len(passages)))]
            a = int(r.integers(0, 30))
            parts.append(p[a : len(p) - int(r.integers(0, 30))] if r.random() < 0.6 else text(int(r.integers(1, 150))))
        out.append("".join(parts))
    for _ in range(40):
        t = list(out[int(r.integers(len(out)))])
        for k in np.flatnonzero(r.random(len(t)) < 0.01):
            t[k] = str(r.choice(letters))
        out.append("".join(t))
    return out + [out[3], out[3], "x" * 1000, "x" * 60, out[5] * 4]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_is_brute_force(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(S, "BATCH", 500 if seed == 2 else S.BATCH)
    texts = corpus(seed) + ODD
    documents(spark, texts).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in S.op9_suffix_dedup(spark, str(tmp_path)).collect()) == brute(texts)


def test_nothing_is_broadcast(spark, tmp_path):
    texts = corpus(3)
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = S.op9_suffix_dedup(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == brute(texts)
    for df in (found, S.cut(docs), S.cut(docs.unionByName(docs))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("batch", [S.BATCH, 900, 60])
def test_difference_cover(monkeypatch, batch):
    monkeypatch.setattr(S, "BATCH", batch)
    for a in range(8):
        for b in range(8):
            assert any((a + s) % 8 in S.COVER and (b + s) % 8 in S.COVER for s in range(8))
    r = np.random.default_rng(4)
    base = [r.choice(list(b"ab"), 80).astype("u1").tobytes() for _ in range(4)]
    blocks = [b[int(r.integers(0, 12)) : 80 - int(r.integers(0, 12))] for b in base for _ in range(20)] + [b"a" * 50, b"a" * 80, b"b" * 49, b""]
    ids = r.permutation(len(blocks)).astype(np.int64)
    first = {}
    for i, b in zip(ids.tolist(), blocks, strict=True):
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    got = S.least_documents(blocks, ids)
    assert [g.tolist() for g in got] == [[first[b[k : k + 50]] for k in range(len(b) - 49)] for b in blocks]


def test_slabs(monkeypatch):
    r = np.random.default_rng(5)
    t = r.choice(list(b"abcd "), 5000).astype("u1").tobytes()
    whole = S.anchors([t])
    monkeypatch.setattr(S, "SLAB", 700)
    cut = S.anchors([b"short", t, b"x" * 60])
    covered = lambda a, k: sorted(w for o, lo, n in zip(a[0], a[3], a[4], strict=True) if o == k for w in range(lo, lo + n + 1))
    assert covered(whole, 0) == covered(cut, 1) == list(range(5000 - 49)) and covered(cut, 2) == list(range(11))


def test_pack():
    for a in ([], [5], [1, 2, 3], [7, 3, 9, -4], [0, 1 << 40, 5], [1 << 62, -(1 << 62)], [300, 0, 70_000]):
        assert S.unpack(S.pack(np.array(a, dtype=np.int64))).tolist() == a


def test_repeated_and_null_ids(spark):
    p = "this passage is longer than fifty bytes, so that it counts as one"
    docs = spark.createDataFrame([(2, "b" + p), (1, p), (2, "a" + p), (1, p), (None, p + "!"), (None, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.text and bytes(r.text).decode()): bytes(r.kept).decode() for r in S.spans(docs).collect()}
    assert rows == {(None, None): "", (None, p + "!"): p + "!", (1, p): "", (2, "a" + p): "a", (2, "b" + p): "b"}
    assert S.spans(docs).count() == 6


def test_cut_keeps_columns(spark):
    texts = corpus(6)[:40] + [None]
    docs = documents(spark, texts)
    out = S.cut(docs)
    assert out.schema == docs.schema and out.count() == len(texts)
    kept = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in S.spans(docs).collect()}
    assert {r.doc_id: r.text for r in out.collect()} == {k: (None if texts[k] is None else v) for k, v in kept.items()}
    assert S.cut(docs.where("false")).count() == 0 and S.spans(docs.where(F.lit(False))).count() == 0


def test_cut_with_clashing_names(spark):
    p = "this passage is longer than fifty bytes, so that it counts as one"
    names = ["suffix_key", "SUFFIX_begin", "id", "place", "begin", "end", "_id"]
    docs = spark.createDataFrame([(1, p, *"abcdefg"), (2, "x" + p, *"hijklmn")], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    assert sorted(tuple(r) for r in S.cut(docs).collect()) == [(1, p, *"abcdefg"), (2, "x", *"hijklmn")]
    twice = docs.unionByName(docs)
    assert sorted(tuple(r) for r in S.cut(twice).collect()) == sorted([(1, p, *"abcdefg"), (2, "x", *"hijklmn")] * 2)


def test_cut_repeated_and_null_ids(spark):
    p = "this passage is longer than fifty bytes, so that it counts as one"
    docs = spark.createDataFrame([(2, "b" + p), (1, p), (2, "a" + p), (1, p), (None, p + "!"), (None, None)], "doc_id long, text string")
    out = S.cut(docs)
    assert out.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(2, "b"), (1, ""), (2, "a"), (1, ""), (None, p + "!"), (None, None)], key=str)
