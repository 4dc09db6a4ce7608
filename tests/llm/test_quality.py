import zlib

import numpy as np
import pyarrow.parquet as pq
from fixtures import ODD, documents
from pyspark.sql import functions as F

from quern.llm import quality as Q


def by_hand(text):
    words = text.split()
    x = text.encode()
    n = max(sum(b not in b" \t\n\x0b\x0c\r" for b in x), 1)
    lengths = [len(w.encode()) for w in words] or [0]
    return {
        "log_bytes": np.log1p(len(x)), "log_words": np.log1p(len(words)), "word_length": np.log1p(np.mean(lengths)), "word_length_spread": np.log1p(np.std(lengths)),
        "upper": np.sqrt(sum(65 <= b <= 90 for b in x) / n), "distinct_words": np.log1p(len(set(words))) - 0.9 * np.log1p(len(words)), "line_feeds": np.sqrt(x.count(10) / n),
    }


def test_statistics_by_hand():
    texts = ["The Cat sat.\nOn 12 MATS, the cat!", "x", "", "  a\t\tb  c\n", "é ü é"]
    rows = Q.describe([t.encode() for t in texts])
    for t, r in zip(texts, rows, strict=True):
        if t:
            for name, value in by_hand(t).items():
                assert abs(r[Q.STATISTICS.index(name)] - value) < 1e-9, (t, name)
        else:
            assert not r.any()
    alone = np.concatenate([Q.describe([t.encode()]) for t in texts])
    assert np.allclose(rows, alone)


def test_density_by_hand():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (300, 3)), r.normal(1, 2, (500, 3)) @ np.array([[1, 0.3, 0], [0, 1, 0], [0, 0.2, 1]])])
    y = np.r_[np.zeros(300, int), np.ones(500, int)]
    got = Q.fit(x, y).score(x)
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = (300 * own[0] + 500 * own[1]) / 800
    density = []
    for k in (0, 1):
        c = 0.95 * (0.8 * own[k] + 0.2 * pooled) + 0.05 * np.diag(np.diag(pooled) + 1e-6)
        d = x - x[y == k].mean(0)
        density.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(got, 1 / (1 + np.exp(density[0] - density[1])))


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = Q.op10_quality_qda(spark, sf).collect()
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    tested = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([p == y for p, y in tested]) > 0.95
    assert np.mean([p for p, y in tested if y]) > 0.97


def test_labels_held_out_are_not_used(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = Q.train(docs, labels)
    b = Q.train(docs, labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(a.mean, b.mean) and np.array_equal(a.whiten, b.whiten)


def test_odd_texts_and_missing_labels(spark):
    docs = documents(spark, ODD).withColumn("score", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.train(docs, none)
    rows = Q.score(docs, model).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}
    some = spark.createDataFrame([(k, k % 2, None) for k in range(len(ODD))] + [(1, None, 0), (2, 0, 0)], none.schema)
    scored = Q.score(docs, Q.train(docs, some))
    assert scored.count() == len(ODD) and scored.where("score is null or isnan(score)").count() == 0
    assert Q.keep(docs, some).columns == docs.columns
    assert Q.keep(docs.where("false"), some).count() == 0
