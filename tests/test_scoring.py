"""Rankings that are made inside tasks against the joins that many questions take, and what leaves a task."""

import numpy as np
import pytest

from quern.operators import retrieval as R
from quern.operators import scoring

WORDS = [f"w{k}" for k in range(40)] + ["Straße", "été"]


@pytest.fixture
def texts(spark):
    r = np.random.default_rng(7)
    chunks = [(f"chunk_{k:03d}", " ".join(r.choice(WORDS, r.integers(0, 30)))) for k in range(300)] + [(f"copy_{k:03d}", "w1 w2 w2") for k in range(50)]
    queries = [(k, " ".join(r.choice(WORDS, 5))) for k in range(6)] + [(6, "w1 w2 w1"), (7, ""), (8, "unheard")]
    return spark.createDataFrame(chunks, "chunk_id string, text string").repartition(3), spark.createDataFrame(queries, "query_id long, query string")


@pytest.mark.parametrize("limit", [3, 20, 400])
def test_tasks_rank_as_joins_do(texts, monkeypatch, limit):
    monkeypatch.setattr(scoring, "CELLS", 64)
    monkeypatch.setattr(scoring, "ADDED", 16)
    near = [{tuple(r) for r in df.collect()} for df in R.rankings(*texts, limit)]
    monkeypatch.setattr(R, "QUERY_ROWS", 0)
    joined = [{tuple(r) for r in f(*texts, limit).select(*c).collect()} for f, c in ((R.bm25, ["query_id", "chunk_id", "sparse", "rank"]), (R.dense, ["query_id", "chunk_id", "dense", "rank"]))]
    assert near == joined


def test_only_the_best_of_a_task_leave_it(texts):
    chunks, queries = texts
    for df in scoring.rankings(chunks, queries, 2, 256, 1.5, 0.75, ("bm25", "dense")):
        assert df.count() <= 2 * 7 * max(3, chunks.sparkSession.sparkContext.defaultParallelism)


def test_vectors_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CELLS", 64)
    monkeypatch.setattr(scoring, "BLOCK", 8)
    r = np.random.default_rng(3)
    rows = [(k, [float(x) for x in r.normal(size=4 if k % 9 else 3)]) for k in range(200)] + [(200 + k, [1.0, 0.0, 0.0, 0.0]) for k in range(30)] + [(300, [0.0] * 4), (301, None), (302, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in R.cosine_pairs(v, v.where("vec_id % 5 = 0"), 4).collect())
    want, given = [], {k: np.array(e, np.float32).astype(float) for k, e in rows if e and any(e)}
    for q in (k for k in given if k % 5 == 0):
        scored = [(-np.floor(1e6 * (given[q] @ e) / np.sqrt((given[q] @ given[q]) * (e @ e)) + 0.5) / 1e6, k) for k, e in given.items() if len(e) == len(given[q])]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(sorted(x for x in scored if x[0] < 0)[:4], 1)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3] for x in got], [x[3] for x in sorted(want)])


def test_samples_are_rows_of_sums_not_of_draws(spark):
    from quern.operators import evaluation as V

    d = spark.createDataFrame([(1, "s", f"c{k}", float(k % 3)) for k in range(50)], "g long, seed string, cluster string, delta double")
    c = d.selectExpr("g", "seed", "CAST(substr(cluster, 2) AS BIGINT) AS i", "delta AS _sum", "1L AS n")
    import hashlib

    got = {x.b: x.mean for x in V._sample_means(spark, c, ["g"], 250).collect()}
    want = {b: round(sum(int(hashlib.md5(f"s/{b}/{j}".encode()).hexdigest()[:8], 16) % 50 % 3 for j in range(50)) / 50, 9) for b in range(250)}
    assert got == want
    assert V.paired_intervals(spark, d, ["g"], 200).count() == 1
