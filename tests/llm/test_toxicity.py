import zlib

import numpy as np
from fixtures import ODD, documents

from quern.llm import toxicity as T


def made(n, seed):
    """Clean words, and in every fourth text one word off a toxic stem."""
    r = np.random.default_rng(seed)
    stems = ["glorpish", "snarfel", "vexomun"]
    words = lambda k: ["".join(r.choice(list("aeionrst"), r.integers(2, 8))) for _ in range(k)]
    texts, labels = [], []
    for k in range(n):
        w = words(int(r.integers(5, 200)))
        if k % 4 == 0:
            w[int(r.integers(len(w)))] = str(r.choice(stems)) + "".join(r.choice(list("aeinst"), 2))
        texts.append(" ".join(w).encode())
        labels.append(int(k % 4 == 0))
    return texts, np.array(labels)


def test_bags_by_hand():
    text = b"Ab cde cde"
    window, bucket, first, windows = T.bags([text, b"", b" \n"])
    assert windows.tolist() == [1, 1, 1] and set(window.tolist()) == {0}
    want = set()
    for w in ("ab", "cde"):
        edged = f" {w} "
        want |= {(n, edged[k : k + n]) for n in T.GRAMS for k in range(len(edged) - n + 1) if n > 2 or " " not in edged[k : k + n]}
    assert len(bucket) == len(want)
    many = T.bags([b"x" * 3 + b" w%d" % k for k in range(5)] + [b" ".join(b"w%d" % k for k in range(100))])
    assert many[3].tolist() == [1] * 5 + [-(-100 // T.WINDOW)]


def test_unseen_misspellings_and_long_texts():
    texts, labels = made(1200, 1)
    model = T.fit(texts, labels)
    test, y = made(400, 2)
    assert ((model.score(test) >= 0.5) == y).mean() > 0.95
    clean = [t for t, k in zip(test, y, strict=True) if not k]
    long = b" ".join(clean)
    scores = model.score([long, long + b" glorpishoz " + long, b"", long + b" glorpixhes " + long])
    assert scores[0] < 0.5 < scores[1] and scores[2] < 0.5  # a form that wasn't seen, in a text that is long
    assert scores[3] > scores[0]  # one letter changed
    assert np.allclose(model.score(test), np.concatenate([model.score([t]) for t in test]))


def slow_odds(joint, text):
    """The most toxic window's softmax, gram by gram, with Python's integers."""
    words = text.decode("latin-1").translate({k: k + 32 for k in range(65, 91)}).split()
    best = None
    for lo in range(0, max(len(words), 1), T.WINDOW):
        rows = []
        for w in dict.fromkeys(words[lo : lo + T.WINDOW]):
            edged = f" {w} ".encode("latin-1")
            for n in T.GRAMS:
                for k in range(len(edged) - n + 1):
                    gram = edged[k : k + n]
                    if n > 2 or 32 not in gram:
                        h = 0
                        for c in gram:
                            h = (h * 0x100000001B3 + c + 1) % 2**64
                        rows.append(((h ^ n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - T.BITS))
        mean = sum((joint.table[r] for r in rows), np.zeros(joint.table.shape[1])) / (len(rows) + T.EASE)
        logit = joint.soft @ mean + joint.bias
        p = 1 / (1 + np.exp(logit[0] - logit[1]))
        best = p if best is None else max(best, p)
    return best


def test_scores_are_a_slow_softmax():
    texts, labels = made(300, 3)
    joint = T.joint(texts, labels, epochs=2)
    model = joint.collapsed()
    odd = [t for t in ((x or "").encode() for x in ODD)]
    for found in (texts[:40], odd):
        assert np.allclose(model.score(found), [slow_odds(joint, t) for t in found])


def test_long_training_texts_keep_all_windows():
    """A stem that is only in one window of very long texts is learned."""
    texts, labels = made(800, 5)
    clean = [t for t, k in zip(texts, labels, strict=True) if not k]
    r = np.random.default_rng(6)
    long = lambda k, stem: b" ".join([*(clean[int(i)] for i in r.integers(0, len(clean), 5)), b"%szug%s" % (stem, b"aeinst"[k % 6 : k % 6 + 1]), *(clean[int(i)] for i in r.integers(0, len(clean), 5))])
    for k in range(0, len(texts), 4):
        texts[k] = long(k, b"blatik") if labels[k] else texts[k]
    model = T.fit(texts, labels)
    found = [model.score([long(k, stem) for k in range(40)]) for stem in (b"blatik", b"")]
    assert (found[0][:, None] > found[1][None, :]).mean() > 0.9


def test_held_out_ranking_of_the_query(spark, sf):
    """Some 70 held-out labels, after a fit on 300 texts."""
    sf = sf.replace("0.001", "0.01")
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect()}
    tested = [(r.score, label[r.doc_id]) for r in T.op4_toxicity(spark, sf).collect() if r.held_out and r.doc_id in label]
    toxic, clean = (np.array([s for s, y in tested if y == k]) for k in (1, 0))
    assert len(toxic) and (toxic[:, None] > clean[None, :]).mean() > 0.8


def test_query(spark, sf):
    rows = T.op4_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len(rows) == len({r.doc_id for r in rows}) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_texts_and_missing_labels(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(k, None, k % 2) for k in range(len(ODD))] + [(3, None, None)], "doc_id long, quality int, toxic int")
    scored = T.score(docs, T.train(docs, labels))
    assert scored.count() == len(ODD) and scored.where("score is null or isnan(score)").count() == 0
    same = {r.doc_id: r.score for r in scored.collect()}
    assert same[0] == same[1] and same[16] == same[17] and same[18] == same[19]
    assert {r.score for r in T.score(docs, T.train(docs, labels.where("false"))).collect()} == {0.5}
    assert T.score(docs.where("false"), T.Model()).count() == 0
