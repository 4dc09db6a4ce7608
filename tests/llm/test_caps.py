import numpy as np
import pytest

from quern.llm import caps as K
from quern.llm.jaccard import merged

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n_links int"


def made(seed, clusters=60, d=64):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(clusters):
        c = r.normal(size=d)
        for _ in range(int(r.integers(1, 9))):
            v = c + r.normal(size=d) * r.choice([0.0, 0.1, 0.3, 0.45])
            rows.append((v * r.choice([1.0, 3.0])).astype(np.float32).tolist())
    rows += [rows[0]] * 30 + [None, [], [0.0] * d, [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0, 2.0], [2.0, 4.0], [1.0], [-1.0]]
    return [rows[k] for k in r.permutation(len(rows))]


def brute(rows):
    ok = [k for k, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    pairs = [(i, j) for x, i in enumerate(ok) for j in ok[:x] if len(rows[i]) == len(rows[j]) and np.dot(rows[i], rows[j]) / np.sqrt(np.dot(rows[i], rows[i]) * np.dot(rows[j], rows[j])) >= 0.9]
    return pairs


@pytest.mark.parametrize("tile", [1024, 20])
def test_links_are_those_of_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(K, "TILE", tile)
    rows = made(tile)
    pairs = brute(rows)
    df = spark.createDataFrame([(k, v, 0, "x", 7) for k, v in enumerate(rows)], SCHEMA)
    got = {r.vec_id: r for r in K.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    n = np.bincount(np.array(pairs).reshape(-1), minlength=len(rows))
    label = merged(len(rows), *np.array(pairs).T)
    found = sum(r.n_links for r in got.values())
    assert all(got[k].n_links <= n[k] for k in got) and found >= 0.98 * n.sum()
    same = [got[k].component_id == label[k] and got[k].kept == (label[k] == k) for k in got]
    assert np.mean(same) >= 0.97
    for k, v in enumerate(rows):
        if not v or None in v or not np.isfinite(v).all() or not any(v):
            assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)


def test_recall_of_filters_at_the_threshold():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = r.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * g
    for n, least in ((500, 0.99), (50_000, 0.98), (1_000_000, 0.95)):
        size = K.size_for(n)
        met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(K.decode(x, size), K.decode(y, size), strict=True)]
        assert np.mean(met) >= least


def test_decoding_lists_all_that_exceed():
    r = np.random.default_rng(2)
    x = r.normal(size=(50, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    size = 20
    rotation, first, second = K.code(10, size)
    y = x @ rotation
    whole = (y[:, :5] @ first.T)[:, :, None] + (y[:, 5:] @ second.T)[:, None, :]
    for k, found in enumerate(K.decode(x, size)):
        above = np.flatnonzero(whole[k].reshape(-1) >= K.threshold(10, size))
        assert set(above) <= set(found.tolist()) and len(found) >= min(K.LEAST, len(found))


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    pairs = brute([r.embedding for r in rows])
    n = np.bincount(np.array(pairs).reshape(-1), minlength=len(rows)) if pairs else np.zeros(len(rows), int)
    got = sorted(K.op3_cap_filters(spark, sf).collect())
    assert [r.vec_id for r in got] == [r.vec_id for r in rows] and [r.n_links for r in got] == n.tolist()


def test_empty_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 0, "", 0), (5, [1.0, 0.0], 0, "", 0), (5, [1.0, 0.0], 0, "", 0), (9, [2.0, 0.1], 0, "", 0)], SCHEMA)
    assert K.near_duplicates(df.where("false")).count() == 0
    got = K.near_duplicates(df).collect()
    assert len(got) == 4 and {r.component_id for r in got if r.vec_id == 9} == {5}
